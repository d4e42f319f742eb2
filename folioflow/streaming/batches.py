"""Resumable, incremental translation: the one flow that runs over pages as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.metrics import pending
from folioflow.sources.adapters import Translator, translate


def translate_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    translator: Translator,
    schema: str = "page_id long, unit_no int, source string",
    progress: Callable[[int, int], None] | None = None,
    files_a_batch: int = 64,
) -> StreamingQuery:
    """Translate parquet units under source into sink, until what is there now is done.

    Pages already in sink are skipped, so a stopped or failed run resumes where it was: each batch is written whole
    under its own number, and a batch that runs again replaces what it wrote. query.stop() cancels between batches; progress gets
    the batch's number and pages.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = _done(spark, sink, number)
        todo = batch if done is None else pending(batch, done)
        out = translate(todo, translator)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if progress:
            progress(number, spark.read.parquet(f"{sink}/batch={number}").select("page_id").distinct().count())

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(spark: SparkSession, sink: str, number: int) -> DataFrame | None:
    """Pages in earlier batches of the sink."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    found = spark.read.option("basePath", sink).schema("page_id long, batch int").parquet(sink)
    return found.where(F.col("batch") < number).select("page_id").distinct()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; a built-in form, for streams and tables alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
