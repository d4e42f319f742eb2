"""Headings, paragraphs and tables of markdown, as rows, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as T


def elements(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, elem_no, type, level, text, raw). Blank lines end paragraphs and tables; separator rows and images go."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).withColumn("line", T.strip("line"))
    kind = (
        F.when(F.col("line") == "", "blank")
        .when(F.col("line").rlike(r"^\|[\s\-:|]+\|$"), "separator")
        .when(F.startswith("line", F.lit("|")), "table")
        .when(F.col("line").rlike(r"^#{1,6}\s+.+"), "heading")
        .when(F.startswith("line", F.lit("![")), "image")
        .otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind)
    # a separator belongs to its table, an image leaves its surroundings as they are but ends a table
    lines = lines.withColumn("side", F.when(F.col("kind").isin("separator", "table"), "table").otherwise(F.col("kind")))
    order = Window.partitionBy(key).orderBy("n")
    before = F.lag("side").over(order)
    text_before = F.last(F.when(F.col("side") != "image", F.col("side")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("side") == "heading", True).when(F.col("side") == "table", before.isNull() | (before != "table")).when(F.col("side") == "paragraph", text_before.isNull() | (text_before != "paragraph")).otherwise(False)
    lines = lines.withColumn("starts", starts)
    lines = lines.withColumn("island", F.sum(F.col("starts").cast("long")).over(order)).where(F.col("kind").isin("table", "heading", "paragraph"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    found = lines.groupBy(key, "island", F.col("side").alias("type")).agg(F.min("n").alias("n"), ordered.alias("lines"))
    first = F.element_at("lines", 1)
    heading = F.col("type") == "heading"
    level = F.when(heading, F.length(F.regexp_extract(first, r"^(#{1,6})\s", 1))).otherwise(0)
    body = F.when(heading, T.strip(F.regexp_extract(first, r"^#{1,6}\s+(.+)", 1))).when(F.col("type") == "table", F.array_join("lines", "\n")).otherwise(F.array_join("lines", " "))
    place = (F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).cast("long")
    return found.select(key, place.alias("elem_no"), "type", level.cast("long").alias("level"), body.alias("text"), F.array_join("lines", "\n").alias("raw"))


def table_cells(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, elem_no, r, c, cell) of table elements."""
    rows = found.where("type = 'table'").select(key, "elem_no", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    return rows.select(key, "elem_no", F.col("r").cast("long").alias("r"), F.posexplode(T.cells("line")).alias("c", "cell")).withColumn("c", F.col("c").cast("long"))


def translated_elements(found: DataFrame) -> DataFrame:
    """Tables cell by cell, other texts of two characters or more at once; blank results keep the original."""
    new = F.when(F.col("type") == "table", T.translated_table("text")).when(F.length(T.strip("text")) >= 2, T.translated(F.col("text"))).otherwise(F.col("text"))
    return found.withColumn("translated", F.when(T.strip(new) == "", F.col("text")).otherwise(new))


def element_html(extra: Column | None = None) -> Column:
    """HTML of an element; extra space before it counts above 5 points."""
    style = F.lit("") if extra is None else F.when(extra > 5, F.concat(F.lit(' style="margin-top:'), extra.cast("int").cast("string"), F.lit('pt"'))).otherwise(F.lit(""))
    tag = F.when(F.col("type") == "heading", F.concat(F.lit("h"), F.least(F.col("level"), F.lit(6)).cast("string"))).otherwise(F.lit("p"))
    return F.when(F.col("type") == "table", T.table_html("text")).otherwise(F.concat(F.lit("<"), tag, style, F.lit(">"), T.escape("text"), F.lit("</"), tag, F.lit(">")))


def elements_html(found: DataFrame, key: str = "doc_id") -> DataFrame:
    shown = found.where(T.strip("text") != "").withColumn("html", element_html())
    return shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "html"))), lambda x: x["html"]), "\n").alias("html"))


def heading_scale(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in config.HEADING_SCALES.items()], F.lit(config.SMALLER_HEADINGS))
