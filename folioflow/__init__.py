"""Document analytics on Spark: text, layout and corpus operators as DataFrame functions."""
