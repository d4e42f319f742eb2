"""Formatting of spans and lines, and runs of equal format.

Spans are rows (page_id, block_no, line_no, span_no, text, x0, y0, x1, y1, size, font, color, flags, origin_y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as T

LINE = ["page_id", "block_no", "line_no"]


def with_defaults(spans: DataFrame) -> DataFrame:
    """Missing values as a text layer's readers take them."""
    return spans.fillna({"size": 11.0, "font": "", "color": 0, "flags": 0, "text": ""})


def has_flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bit)) != 0


def named_flags(spans: DataFrame) -> DataFrame:
    """Adds bold, italic, mono and serif, by flag bits and the font's name."""
    name = F.lower("font")
    has = lambda names: name.rlike("|".join(n.lower() for n in names))
    return spans.withColumns(
        {"bold": has_flag(16) | F.contains(name, F.lit("bold")), "italic": has_flag(2) | F.contains(name, F.lit("italic")), "mono": has(config.MONO_NAMES), "serif": has(config.SERIF_NAMES)}
    )


def flags(spans: DataFrame) -> DataFrame:
    """Adds superscript and subscript too: by the line's mean size and baseline, where all three are above 0, or by the name."""
    name = F.lower("font")
    line = Window.partitionBy(*LINE)
    mean = F.avg("size").over(line)
    base = F.coalesce(F.avg(F.when(F.col("size") >= 0.8 * mean, F.col("origin_y"))).over(line), F.avg("origin_y").over(line))
    placed = (mean > 0) & (F.col("size") < 0.8 * mean) & (base > 0) & (F.col("origin_y") > 0)
    rise = base - F.col("origin_y")
    return named_flags(spans).withColumns(
        {
            "superscript": has_flag(1) | (placed & (rise > 0.3 * F.col("size"))) | F.contains(name, F.lit("sup")),
            "subscript": (placed & (-rise > 0.2 * F.col("size"))) | (F.contains(name, F.lit("sub")) & ~F.contains(name, F.lit("subhead"))),
        }
    )


def line_means(spans: DataFrame) -> DataFrame:
    """avg_size and baseline of each line: the mean origin of spans of at least 0.8 of its mean size."""
    known = spans.withColumn("avg_size", F.avg("size").over(Window.partitionBy(*LINE)))
    tall = F.col("size") >= 0.8 * F.col("avg_size")
    return known.groupBy(*LINE).agg(F.first("avg_size").alias("avg_size"), F.coalesce(F.avg(F.when(tall, F.col("origin_y"))), F.avg("origin_y")).alias("baseline"))


def line_style(spans: DataFrame) -> DataFrame:
    """Size weighted by characters, dominant color (first seen of equals), majority bold, italic and serif, any mono.

    Sums are taken by color, then over a line's colors, so lines are shuffled once and hold a row a color.
    """
    s = named_flags(spans).withColumn("chars", F.length("text"))
    part = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("chars"))), F.lit(0)).alias(c)
    colors = s.groupBy(*LINE, "color").agg(
        F.sum("chars").alias("n"), (-F.min("span_no")).alias("first"), F.sum(F.col("size") * F.col("chars")).alias("weighed"), F.sum("size").alias("sizes"),
        F.count("size").alias("sized"), part("bold"), part("italic"), part("serif"), F.bool_or("mono").alias("mono"),
    )
    n = F.sum("n")
    most = lambda c: (2 * F.sum(c) > n).alias(c)
    return colors.groupBy(*LINE).agg(
        F.when(n > 0, F.sum("weighed") / F.nullif(n, F.lit(0))).otherwise(F.coalesce(F.try_divide(F.sum("sizes"), F.sum("sized")), F.lit(11.0))).alias("avg_size"),
        most("bold"), most("italic"), most("serif"), F.bool_or("mono").alias("mono"), F.max_by("color", F.struct("n", "first")).alias("color"),
    )


def joined(spans: DataFrame) -> DataFrame:
    """Text of each line: a space where the gap to the span before is 0.3 of its size or more."""
    order = Window.partitionBy(*LINE).orderBy("span_no")
    gap = F.col("x0") - F.lag("x1").over(order)
    piece = F.concat(F.when(gap >= 0.3 * F.lag("size").over(order), F.lit(" ")).otherwise(F.lit("")), F.col("text"))
    return _concat(spans.withColumn("piece", piece), LINE, "text")


def _concat(pieces: DataFrame, keys: list[str], name: str, *more: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("span_no", "piece")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias(name), *more)


def format_key() -> Column:
    return F.struct("bold", "italic", F.bround("size", 1).alias("size"), "color", F.left("font", F.lit(10)).alias("font"))


def runs(spans: DataFrame) -> DataFrame:
    """(line keys, run_no, text, bold, italic, n_spans): consecutive spans of one format, spaced by their gaps."""
    s = named_flags(spans).withColumn("key", format_key())
    order = Window.partitionBy(*LINE).orderBy("span_no")
    before = F.lag("key").over(order)
    s = s.withColumn("new", before.isNull() | ~before.eqNullSafe(F.col("key")))
    s = s.withColumn("run_no", F.sum(F.col("new").cast("long")).over(order) - 1)
    wide = F.col("x0") - F.lag("x1").over(order) >= 0.3 * F.lag("size").over(order)
    edge = F.coalesce(F.lag("text").over(order), F.lit("")).rlike(r"(?U)\s$") | F.col("text").rlike(r"^(?U)\s")
    s = s.withColumn("piece", F.concat(F.when(~F.col("new") & wide & ~edge, F.lit(" ")).otherwise(F.lit("")), F.col("text")))
    return _concat(s, [*LINE, "run_no", "bold", "italic"], "text", F.count("*").alias("n_spans"))


def merged_runs(found: DataFrame) -> DataFrame:
    """Neighbouring runs of equal bold and italic as one, joined by a space."""
    order = Window.partitionBy(*LINE).orderBy("run_no")
    same = F.lag(F.struct("bold", "italic")).over(order).eqNullSafe(F.struct("bold", "italic"))
    s = found.withColumn("part", F.sum((~same).cast("long")).over(order) - 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"])
    return s.groupBy(*LINE, "part", "bold", "italic").agg(F.array_join(ordered, " ").alias("text"))


def html_tags() -> tuple[Column, Column]:
    """Opening and closing tags of a span's flags."""
    tags = [("superscript", "sup"), ("subscript", "sub"), ("bold", "b"), ("italic", "i")]
    show = lambda pattern, some: F.concat_ws("", *[F.when(F.col(c), F.lit(pattern.format(t))) for c, t in some])
    return show("<{}>", tags), show("</{}>", tags[::-1])


def css_rgb(red: Column, green: Column, blue: Column) -> Column:
    """rgb() of channels from 0 to 1, each cut to a whole number of 255."""
    whole = lambda x: (x * 255).cast("int").cast("string")
    return F.concat(F.lit("rgb("), F.concat_ws(", ", whole(red), whole(green), whole(blue)), F.lit(")"))


def channels(color: Column) -> list[Column]:
    """Red, green and blue from 0 to 1 of a packed color."""
    return [F.shiftright(color, n).bitwiseAND(F.lit(255)) / 255.0 for n in (16, 8, 0)]


def css_style() -> Column:
    """Inline style of a span's flags and color."""
    return F.concat_ws("; ", F.when(F.col("bold"), F.lit("font-weight: bold")), F.when(F.col("italic"), F.lit("font-style: italic")), F.concat(F.lit("color: "), css_rgb(*channels(F.col("color")))))


def rotation(cos: Column, sin: Column) -> Column:
    """Degrees, by quarters, of a line direction whose y grows downward."""
    return F.pmod(F.bround(F.degrees(F.atan2(-sin, cos)) / 90) * 90, F.lit(360)).cast("int")
