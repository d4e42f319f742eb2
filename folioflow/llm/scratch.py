"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes of a plan that leave rows where a table's files have them.
BARE = ("Project", "Filter", "SubqueryAlias")
#: Rows of the Arrow batches that a Python worker holds, unless the session asks for fewer. Spark bounds a batch by bytes too (arrow.maxBytesPerBatch, 64 MiB).
BATCH_ROWS, ROWS = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, but on one machine only: others wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, so a lost executor costs
    no recomputation. The table goes when the session's file systems close."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioflow/{uuid.uuid4().hex}"
    rows = int(spark.conf.get(ROWS))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(ROWS, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ROWS, str(rows))
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def place(df: DataFrame) -> tuple[Column, Column]:
    """The part of df that holds a row and its place in the part: sorted by both, rows come in the order in which df was written.

    Parts of a Parquet table are its files, by number (a scan reads them in another order, by size); those of any other plan are its partitions.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in BARE:
        node = node.children().head()
    part = lambda number, path: F.struct(number.alias("number"), F.length(path).alias("chars"), path.alias("path"))
    if node.getClass().getSimpleName() == "LogicalRelation" and node.toString().rstrip().endswith(" parquet"):
        file = df.metadataColumn("_metadata")
        number = F.regexp_extract(file["file_path"], r"part-(\d+)[^/]*$", 1).try_cast("long")
        return part(F.coalesce(number, F.lit(-1)), file["file_path"]), file["row_index"]
    row = F.monotonically_increasing_id()
    return part(F.shiftright(row, 33), F.lit("")), row.bitwiseAND(F.lit((1 << 33) - 1))
