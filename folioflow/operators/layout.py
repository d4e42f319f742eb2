"""Pages: scans, paragraphs, blocks, columns, tables, geometry.

Every relation carries its ordinals; windows share the partition key page_id, so one exchange serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as T


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda n, x: n + of(x))


def _area(i: Column) -> Column:
    return (i["x1"] - i["x0"]) * (i["y1"] - i["y0"])


def scanned(pages: DataFrame, audit: bool = False) -> DataFrame:
    """Adds coverage, scanned and reason to pages (width, height, images, text). The audit variant weighs images by their sum."""
    page = F.col("width") * F.col("height")
    coverage = T.ratio(_sum(F.col("images"), _area), page)
    large = coverage > 0.5 if audit else F.exists("images", lambda i: _area(i) > 0.5 * page)
    n = F.size(T.words("text"))
    chars = F.length(T.strip("text")) if audit else F.length("text")
    reason = (
        F.when(page <= 0, F.lit(None))
        .when(large & (n < 10), "large image, few words")
        .when((coverage > 0.7) & (n < 20), "images, few words")
        .when(coverage > 0.9, "images")
        .when((chars < 5) & (F.size("images") >= 1), "image without text")
    )
    return pages.withColumn("coverage", coverage).withColumn("reason", reason).withColumn("scanned", F.col("reason").isNotNull())


def heading_levels(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, size, level): a document's size with most characters is its body's (the larger of equals); larger ones are levels from 1, four at most."""
    sizes = lines.groupBy(doc, F.bround("size").cast("long").alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    whole = Window.partitionBy(doc)
    sizes = sizes.withColumn("body", F.max_by("size", F.struct("chars", "size")).over(whole)).where("size > body")
    return sizes.withColumn("level", F.row_number().over(whole.orderBy(F.desc("size"))).cast("long")).where("level <= 4").select(doc, "size", "level")


def with_headings(lines: DataFrame, levels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines with the level of their size in their document; 0 is body text."""
    found = levels.select(F.col(doc).alias("__doc"), F.col("size").alias("__size"), "level")  # four rows a document at most
    same = (F.col(doc) == F.col("__doc")) & (F.bround("size").cast("long") == F.col("__size"))
    return lines.join(found, same, "left").drop("__doc", "__size").withColumn("level", F.coalesce("level", F.lit(0)))


def ends_sentence(c: Column, marks: str, longer: int, capitals: int) -> Column:
    """The last word is followed by a mark and is longer than `longer`, or all capitals and longer than `capitals`."""
    t = T.strip(c)
    last = F.regexp_replace(F.regexp_extract(F.right(t, F.lit(128)), f"([^{T.SPACE}]+)$", 1), f"[{marks}]+$", "")  # a longer word is long enough
    upper = (F.upper(last) == last) & (F.lower(last) != last)
    return t.rlike(f"[{marks}]$") & ((F.length(last) > longer) | (upper & (F.length(last) > capitals)))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Adds group_no within (page_id, block_no) to lines (line_no, text, y0, y1, size, bold, level)."""
    order = Window.partitionBy("page_id", "block_no").orderBy("line_no")
    before = lambda c: F.lag(c).over(order)
    gap, size = F.col("y0") - before("y1"), (before("size") + F.col("size")) / 2
    breaks = (
        (ends_sentence(before("text"), ".!?:", 2, 0) & (gap > 0.8 * size))
        | (before("level") != F.col("level"))
        | ((F.col("level") == 0) & (before("bold") != F.col("bold")))
        | T.is_list_item("text")
        | (gap > 1.5 * size)
    )
    starts = F.when(before("line_no").isNull(), 0).otherwise(F.coalesce(breaks, F.lit(False)).cast("int"))
    return lines.withColumn("__starts", starts).withColumn("group_no", F.sum("__starts").over(order).cast("long")).drop("__starts")


def is_metadata(c: Column) -> Column:
    t = F.rtrim(c)
    named = F.lower(t).rlike("|".join(config.METADATA))
    return (named | t.rlike(r"\b(19|20)\d{2}\b\s*$")) & (F.length(t) < 60)


def is_footnote(text: Column, size: Column, y: Column, height: Column) -> Column:
    number = F.regexp_extract(T.strip(text), r"^(\d{1,2})\s", 1)
    value = F.coalesce(F.try_to_number(number, F.lit("99")).cast("int"), F.lit(0))
    return value.between(1, 99) & ((size < config.FOOTNOTE_FONT) | (y > config.FOOTNOTES * height))


def blocks(found: DataFrame, overlap: bool = True, titles: str | None = None, zones: bool = True) -> DataFrame:
    """Adds group_no to blocks (page_id, block_no, text, x0, y0, x1, y1, size, bold, height); titles names a boolean column of title-like texts."""
    order = Window.partitionBy("page_id").orderBy("block_no")
    before = lambda c: F.lag(c).over(order)
    size_ratio = F.coalesce(F.try_divide("size", before("size")), F.lit(1.0))
    header, footer = config.HEADER * F.col("height"), config.FOOTER * F.col("height")
    in_header, was_header = F.col("y0") < header, before("y1") < header
    in_footer, was_footer = F.col("y0") > footer, before("y0") > footer
    shared = F.greatest(F.lit(0.0), F.least("x1", before("x1")) - F.greatest("x0", before("x0")))
    narrow = F.greatest(F.lit(1.0), F.least(F.col("x1") - F.col("x0"), before("x1") - before("x0")))
    apart = [
        ends_sentence(before("text"), ".!?", 3, 1),
        is_metadata(before("text")),
        (size_ratio > 1.15) | (size_ratio < 0.85),
        before("bold") != F.col("bold"),
        is_footnote(F.col("text"), F.col("size"), F.col("y0"), F.col("height")),
        T.is_list_item("text"),
        F.col("y0") - before("y1") > before("size") + F.col("size"),
    ]
    if titles:
        apart.append(F.col(titles))
    if zones:
        apart.append((in_header != was_header) | (in_footer != was_footer))
    if overlap:
        apart.append(shared / narrow < 0.30)
    breaks = F.lit(False)
    for x in apart:
        breaks = breaks | F.coalesce(x, F.lit(False))
    starts = F.when(before("block_no").isNull(), 0).otherwise(breaks.cast("int"))
    return found.withColumn("__starts", starts).withColumn("group_no", F.sum("__starts").over(order).cast("long")).drop("__starts")


def bbox(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def alignment(lines: DataFrame, width: float, diagnostic: bool = False) -> DataFrame:
    """(page_id, alignment, left_margin, right_margin); margins are most common edges, the first seen of equals.

    Lines of 30 characters count, and three are needed; the diagnostic variant takes all lines, measures around the margin and
    knows a third label.
    """
    some = lines if diagnostic else lines.where(F.length(T.strip("text")) >= 30)
    some = some.withColumn("left", F.bround("x0")).withColumn("right", F.bround("x1")).withColumn("seen", F.struct("block_no", "line_no"))

    def mode(edge: str, name: str) -> DataFrame:
        counts = some.groupBy("page_id", edge).agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
        ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "seen")))
        return ranked.where("k = 1").select("page_id", F.col(edge).alias(name))

    margins = mode("left", "left_margin").join(mode("right", "right_margin"), "page_id")
    around = F.col("right_margin") if diagnostic else F.avg("right").over(Window.partitionBy("page_id"))
    joined = some.join(margins, "page_id").withColumn("off", F.pow(F.col("right") - around, F.lit(2)))
    stats = joined.groupBy("page_id", "left_margin", "right_margin").agg(
        F.sqrt(F.avg("off")).alias("spread"), F.count("*").alias("n"), F.count_if(F.abs(F.col("right") - F.col("right_margin")) < 15).alias("close")
    )
    if diagnostic:
        label = F.when(F.col("spread") < 10, "justify").when(F.col("spread") < 30, "mixed").otherwise("left")
    else:
        label = F.when((F.col("n") >= 3) & ((F.col("spread") < 10) | ((F.col("spread") < 25) & (F.col("close") > 0.6 * F.col("n")))), "justify").otherwise("left")
    none = F.struct(F.lit("left").alias("alignment"), F.lit(0.0).alias("left_margin"), F.lit(float(width)).alias("right_margin"))
    found = stats.select("page_id", F.struct(label.alias("alignment"), "left_margin", "right_margin").alias("s"))
    return lines.select("page_id").distinct().join(found, "page_id", "left").select("page_id", F.coalesce("s", none).alias("s")).select("page_id", "s.*")


# columns


def content(found: DataFrame) -> DataFrame:
    """Content blocks (page_id, type, x0, x1, ...) of pages that have three, with the page's width; and only those narrower than 70 %."""
    some = found.where(F.col("type").isin(config.CONTENT_TYPES))
    return some.withColumn("__n", F.count("*").over(Window.partitionBy("page_id"))).where("__n >= 3 and width >= 100").drop("__n")


def _narrow(found: DataFrame) -> DataFrame:
    some = content(found).where(F.col("x1") - F.col("x0") < 0.7 * F.col("width"))
    return some.withColumn("__n", F.count("*").over(Window.partitionBy("page_id"))).where("__n >= 3").drop("__n")


def columns_by_gap(found: DataFrame, bin_width: float = 5.0) -> DataFrame:
    """(page_id, col_no, x0, x1): covered ranges of 5 point bins between gaps; pages with 2 to 6 valid columns."""
    some = _narrow(found)
    last = F.floor(F.col("width") / bin_width) + 1
    bins = some.select("page_id", "width", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("x0") / bin_width)), F.least(last, F.floor(F.col("x1") / bin_width)))).alias("bin")).distinct()
    gap = F.greatest(F.lit(2).cast("long"), F.floor(F.greatest(0.02 * F.col("width"), F.lit(15.0)) / bin_width))
    order = Window.partitionBy("page_id").orderBy("bin")
    bins = bins.withColumn("new", (F.col("bin") - F.lag("bin").over(order) - 1 >= gap).cast("int"))
    bins = bins.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    ranges = bins.groupBy("page_id", "width", "island").agg((F.min("bin") * bin_width).alias("c0"), ((F.max("bin") + 1) * bin_width).alias("c1"))
    middle = some.select("page_id", ((F.col("x0") + F.col("x1")) / 2).alias("middle"))
    inside = F.col("middle").between(F.col("c0") - bin_width, F.col("c1") + bin_width)
    counted = ranges.join(middle, "page_id").groupBy("page_id", "width", "c0", "c1").agg(F.count_if(inside).alias("n"))
    valid = counted.where("n >= 2 or (n >= 1 and (c1 - c0) / width >= 0.25)")
    return _numbered(valid)


def _numbered(valid: DataFrame) -> DataFrame:
    page = Window.partitionBy("page_id")
    out = valid.withColumn("__n", F.count("*").over(page)).where(F.col("__n").between(2, 6))
    return out.select("page_id", (F.row_number().over(page.orderBy("c0")) - 1).cast("long").alias("col_no"), F.col("c0").alias("x0"), F.col("c1").alias("x1"))


def columns_by_center(found: DataFrame) -> DataFrame:
    """(page_id, col_no, x0, x1): clusters of block centers; pages on which neighbours overlap by more than 15 % have none."""
    some = _narrow(found).withColumn("middle", (F.col("x0") + F.col("x1")) / 2)
    order = Window.partitionBy("page_id").orderBy("middle", "x0", "x1")
    far = F.col("middle") - F.lag("middle").over(order) > F.greatest(0.08 * F.col("width"), F.lit(50.0))
    some = some.withColumn("cluster", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(order))
    page = Window.partitionBy("page_id")
    some = some.withColumn("clusters", F.max("cluster").over(page) + 1).where(F.col("clusters").between(2, 6))
    found_ = some.groupBy("page_id", "width", "cluster").agg(F.count("*").alias("n"), F.min("x0").alias("c0"), F.max("x1").alias("c1"))
    valid = found_.where("n >= 2 and c1 - c0 >= 0.08 * width")
    by = page.orderBy("cluster")
    width = F.col("c1") - F.col("c0")
    clash = F.lag("c1").over(by) - F.col("c0") > 0.15 * F.least(F.lag(width).over(by), width)
    valid = valid.withColumn("clash", F.coalesce(clash, F.lit(False))).withColumn("clash", F.bool_or("clash").over(page)).where(~F.col("clash"))
    return _numbered(valid)


def assigned(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds col_no: the column that a box (page_id, box_no, x0, x1) overlaps most, the first of equals; 0 without overlap."""
    c = columns.select("page_id", "col_no", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    shared = F.greatest(F.lit(0.0), F.least("x1", "c1") - F.greatest("x0", "c0"))
    best = boxes.select("page_id", "box_no", "x0", "x1").join(c, "page_id").withColumn("shared", shared)
    best = best.groupBy("page_id", "box_no").agg(F.max_by("col_no", F.struct("shared", -F.col("col_no"))).alias("col_no"))
    return boxes.join(best, ["page_id", "box_no"], "left").withColumn("col_no", F.coalesce("col_no", F.lit(0)))


def without_tables(found: DataFrame, tables: DataFrame, most: float = 0.5) -> DataFrame:
    """Blocks of which no table (page_id, x0, y0, x1, y1) covers more than that share of the area."""
    t = tables.select(F.col("page_id").alias("t_page"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    w = F.least("x1", "t_x1") - F.greatest("x0", "t_x0")
    h = F.least("y1", "t_y1") - F.greatest("y0", "t_y0")
    covered = (w > 0) & (h > 0) & (w * h > most * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return found.join(t, (F.col("page_id") == F.col("t_page")) & covered, "left_anti")


def in_table(found: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with in_table: whether a table's box meets theirs, by however little; touching edges don't."""
    t = tables.groupBy("page_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("__tables"))  # those of one page
    meets = lambda r: (F.col("x0") < r["x1"]) & (F.col("x1") > r["x0"]) & (F.col("y0") < r["y1"]) & (F.col("y1") > r["y0"])
    return found.join(t, "page_id", "left").withColumn("in_table", F.coalesce(F.exists("__tables", meets), F.lit(False))).drop("__tables")


def hints(found: DataFrame) -> DataFrame:
    """(page_id, centered, sparse, y_min, y_max, avg_center) of content blocks (width, height of the page)."""
    some = found.where(F.col("type").isin(config.CONTENT_TYPES))
    center = (F.col("x0") + F.col("x1")) / 2 / F.col("width")
    s = some.groupBy("page_id", "height").agg(
        F.avg(center).alias("avg_center"), F.bool_and((center > 0.15) & (center < 0.85)).alias("inside"), F.min("y0").alias("y_min"),
        F.max("y1").alias("y_max"), F.sum(F.col("y1") - F.col("y0")).alias("tall"), F.count("*").alias("n"),
    )
    return s.select("page_id", (F.col("inside") & F.col("avg_center").between(0.40, 0.60)).alias("centered"), ((F.col("n") <= 8) & (F.col("tall") < 0.30 * F.col("height"))).alias("sparse"), "y_min", "y_max", "avg_center")


def column_rects(columns: Column, width: Column, n: Column, gap: Column) -> Column:
    """Detected ranges, or an even split with a gap."""
    each = (width - gap * (n - 1)) / n
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * (each + gap)).alias("x0"), (i * (each + gap) + each).alias("x1")))
    return F.when(F.size(columns) > 0, columns).otherwise(even)


def sparse_gaps(found: DataFrame) -> DataFrame:
    """Adds gap: space above a content block (page_id, block_no, y0, y1, n_elements, room) of a sparse page, by its order from the top.

    Gaps of more than 10 points between neighbours give 10 points at least, in proportion to room (the height of the text area) over the blocks' span. Pages of one
    block, or whose elements and blocks differ in number by more than 2, have none.
    """
    page = Window.partitionBy("page_id")
    span = F.max("y1").over(page) - F.min("y0").over(page)
    blocks = F.count("*").over(page)
    gap = F.col("y0") - F.lag("y1").over(page.orderBy("y0", "block_no"))
    some = (blocks >= 2) & (F.abs(F.col("n_elements") - blocks) <= 2) & (span > 0) & (gap > 10)
    return found.withColumn("gap", F.when(some, F.greatest(F.lit(10.0), F.col("room") * T.ratio(gap, span))).otherwise(F.lit(0.0)))


def density(chars: Column, n_elements: Column, sparse: Column) -> Column:
    """dense, sparse or normal: the row of a re-set page's tables of margins and spacing."""
    return F.when((chars > 2000) | (n_elements > 20), F.lit("dense")).when(sparse, F.lit("sparse")).otherwise(F.lit("normal"))


def _by_density(kind: Column, value) -> Column:
    return F.when(kind == "dense", value("dense")).when(kind == "sparse", value("sparse")).otherwise(value("normal"))


def text_area(kind: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1): the page without its margins; 20 points at the sides where less than 100 would be left."""
    margin = lambda k, whole: _by_density(kind, lambda d: F.greatest(F.lit(float(config.MARGINS[d][k][0])), whole * config.MARGINS[d][k][1]))
    sides = margin(0, width)
    sides = F.when(width - 2 * sides < 100, F.lit(20.0)).otherwise(sides)
    return F.struct(sides.alias("x0"), margin(1, height).alias("y0"), (width - sides).alias("x1"), (height - margin(2, height)).alias("y1"))


def spacing(kind: Column, body: Column) -> Column:
    """struct(paragraph, above, below, line_height): points around paragraphs, above and below headings, at a body size."""
    part = lambda k: _by_density(kind, lambda d: F.lit(config.SPACING[d][k]))
    return F.struct((body * part(0)).alias("paragraph"), (body * part(1)).alias("above"), (body * part(2)).alias("below"), part(3).alias("line_height"))


def sparse_area(y0: Column, y1: Column, first: Column, last: Column, height: Column, shown: Column) -> Column:
    """struct(y0, y1): the text area of a sparse page, moved to where content was: first and last are its bounds on a page of `height`, shown is the new page's height."""
    start, end = first / height, last / height
    top = shown * start * 0.85
    new_y0 = F.when((start > 0.10) & (top > y0) & (top < shown * 0.5), top).otherwise(y0)
    bottom = shown * end * 1.10
    return T.let(new_y0, lambda y: F.struct(y.alias("y0"), F.when((end < 0.85) & (bottom > y + 100), bottom).otherwise(y1).alias("y1")))


def body_size(width: Column, sparse: Column) -> Column:
    """Body size of a re-set page by the width of its text area, larger where sparse."""
    plain = F.greatest(F.lit(8.0), F.least(F.lit(11.0), width / 50))
    return F.when(sparse, F.greatest(plain, F.least(F.lit(14.0), width / 35))).otherwise(plain)


def box_fit(chars: Column, width: Column, size: Column, room: Column) -> Column:
    """struct(height, fits): height of a paragraph's box, from its estimated lines, within the room left; it fits if one and a half lines do."""
    a_line = F.greatest(F.lit(1), (width / (size * 0.5)).cast("int"))
    lines = F.greatest(F.lit(1.0), chars / a_line + 1)
    height = F.least(lines * size * 1.3 * 1.5, room)
    return F.struct(height.alias("height"), (height >= size * 1.5).alias("fits"))


def truncated(c: Column, width: Column, size: Column) -> Column:
    """Text cut to what a box of that width holds, by the estimate of 0.45 of the size a character, the last three of them dots."""
    most = F.floor(width / (size * 0.45)).cast("int")
    kept = F.when(most >= 3, most - 3).otherwise(F.greatest(F.length(c) + most - 3, F.lit(0)))  # fewer than three count from the end
    return F.when(F.length(c) > most, F.concat(F.left(c, kept), F.lit("..."))).otherwise(c)


def cell_grid(tables: DataFrame, padding: float = 2.0) -> DataFrame:
    """(table_id, r, c, x0, y0, x1, y1, size) of the equal cells of tables (table_id, x0, y0, x1, y1, n_rows, n_cols); tables without rows or columns have none."""
    some = tables.where("n_rows > 0 and n_cols > 0")
    tall, wide = (F.col("y1") - F.col("y0")) / F.col("n_rows"), (F.col("x1") - F.col("x0")) / F.col("n_cols")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    cells = some.withColumns({"tall": tall, "wide": wide}).withColumn("r", each("n_rows")).withColumn("c", each("n_cols"))
    edge = lambda start, step, k, off: F.col(start) + (F.col(k) + off) * F.col(step)
    return cells.select(
        "table_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), (edge("x0", "wide", "c", 0) + padding).alias("x0"), (edge("y0", "tall", "r", 0) + padding).alias("y0"),
        (edge("x0", "wide", "c", 1) - padding).alias("x1"), (edge("y0", "tall", "r", 1) - padding).alias("y1"), F.least(F.lit(10.0), F.greatest(F.lit(6.0), F.col("tall") * 0.5)).alias("size"),
    )


def paragraph_boxes(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, group_no, x0, y0, x1, y1) of groups of lines (page_id, block_no, group_no, box): the union of the line boxes.

    A group of one block (page_id, block_no, y0, y1) takes that block's y0 and y1 if the block is taller.
    """
    union = lines.groupBy("page_id", "group_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("block_no").alias("block_no"), F.max("block_no").alias("last"))
    own = blocks.select("page_id", "block_no", F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    both = union.join(own, ["page_id", "block_no"], "left")
    taller = (F.col("block_no") == F.col("last")) & (F.col("b1") - F.col("b0") > F.col("y1") - F.col("y0"))
    pick = lambda own_, old: F.when(taller, F.col(own_)).otherwise(F.col(old)).alias(old)
    return both.select("page_id", "group_no", "x0", pick("b0", "y0"), "x1", pick("b1", "y1"))


def scale_floor(size: Column, y: Column, height: Column) -> Column:
    return F.when((size < 11) | (y > 0.7 * height), F.lit(0.4)).otherwise(F.lit(0.5))


def ocr_scale(dpi: Column, target: float) -> Column:
    return F.when((dpi < target) | (dpi > 2 * target), target / dpi).otherwise(F.lit(1.0))


def fitted(width: Column, height: Column, most: int = 3000, least: int = 300) -> Column:
    """Pixel size after shrinking to `most` and padding to `least`."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    shrunk = lambda x: F.greatest(F.floor(x * scale).cast("int"), F.lit(least))
    return F.struct(shrunk(width).alias("width"), shrunk(height).alias("height"))


def text_width(chars: Column, size: Column, factor: float = 0.52) -> Column:
    return chars * size * factor


def indent(x0: Column, left_margin: Column) -> Column:
    return F.greatest(F.lit(0.0), x0 - left_margin)
