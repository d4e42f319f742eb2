"""Texts of a page by six methods, from its words, lines and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

METHODS = ["standard", "whitespace", "dehyphenate", "blocks", "dict", "words"]


def dehyphenated(lines: Column) -> Column:
    """Lines as one text; a hyphen between letters at a line's end goes with the break."""
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?<=\p{L})-\n(?=\p{Ll})", "")


def extracted(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(page_id, method_ord, method, text): candidates for chosen_text() from lines (page_id, block_no, line_no, text) and spans (.., span_no, text).

    standard trims each line, whitespace keeps it, dehyphenate also joins hyphenated words, blocks joins the blocks' texts of more than two characters, dict the
    non-blank spans, and words the words if there are more than ten. Pages without a line have no candidate.
    """
    sorted_ = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    texts = lambda rows: F.transform(rows, lambda x: x["text"])
    blocks = lines.groupBy("page_id", "block_no").agg(sorted_("line_no", "text").alias("l"))
    blocks = blocks.withColumn("block", dehyphenated(texts(F.col("l"))))
    pages = blocks.groupBy("page_id").agg(F.flatten(F.transform(sorted_("block_no", "l"), lambda b: texts(b["l"]))).alias("l"), F.transform(sorted_("block_no", "block"), lambda b: b["block"]).alias("b"))
    runs = spans.where(T.strip("text") != "").groupBy("page_id").agg(F.array_join(texts(sorted_("block_no", "line_no", "span_no", "text")), " ").alias("dict"))
    whole = F.array_join("l", "\n")
    methods = [
        F.array_join(F.transform("l", T.strip), "\n"),
        whole,
        dehyphenated(F.col("l")),
        F.array_join(F.filter("b", lambda x: F.length(T.strip(x)) > 2), " "),
        F.coalesce("dict", F.lit("")),
        T.let(T.words(whole), lambda w: F.when(F.size(w) > 10, F.array_join(w, " ")).otherwise(F.lit(""))),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("method_ord"), F.lit(name).alias("method"), text.alias("text")) for k, (name, text) in enumerate(zip(METHODS, methods, strict=True))])
    return pages.join(runs, "page_id", "left").select("page_id", F.explode(rows).alias("m")).select("page_id", "m.*")
