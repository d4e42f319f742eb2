"""Roll-ups of audits, benchmarks and translations, and what reports show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def preservation(pages: DataFrame, links_share: float = 1.0, low: float = 0.8, high: float = 1.3) -> DataFrame:
    """Adds links_ok, images_ok, has_text and y_ok to pages (links_before, links_after, images_before, images_after, text, y_ratio).

    The hybrid report asks for links_share = 0.8 and low = 0.7; null counts are 0, a null text has none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pages.withColumns(
        {
            "links_ok": n("links_after") >= n("links_before") * links_share,
            "images_ok": n("images_after") >= n("images_before"),
            "has_text": F.coalesce(F.length(T.strip("text")), F.lit(0)) > 50,
            "y_ok": F.coalesce(F.col("y_ratio").between(low, high), F.lit(False)),
        }
    )


def preservation_summary(flagged: DataFrame) -> DataFrame:
    flags = ["links_ok", "images_ok", "has_text", "y_ok"]
    return flagged.agg(F.count("*").alias("pages"), *[F.count_if(c).alias(c) for c in flags])


def audited(elements: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chars, elements, headings, paragraphs, tables, words, issues) of texts (key, text) and their elements; issues as an array, empty if all is well."""
    of = lambda kind: F.count_if(F.col("type") == kind)
    found = elements.groupBy(key).agg(F.count("*").alias("elements"), of("heading").alias("headings"), of("paragraph").alias("paragraphs"), of("table").alias("tables"), F.sum(T.n_words("text").cast("long")).alias("words"))
    names = ["elements", "headings", "paragraphs", "tables", "words"]
    both = texts.select(key, F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.coalesce(T.cjk("text"), F.lit(0)).alias("__cjk")).join(found, key, "left").fillna(0, names)
    issues = F.array_compact(
        F.array(
            F.when((F.col("words") < 5) & (F.col("chars") > 20), "LOW_WORDS"),
            F.when((F.col("headings") == 0) & (F.col("paragraphs") == 0), "NO_CONTENT"),
            F.when(F.col("chars") < 20, "EMPTY"),
            F.when(F.col("__cjk") > 5, "CJK_CHARS"),
        )
    )
    return both.select(key, "chars", *names, issues.alias("issues"))


def audit_summary(results: DataFrame) -> DataFrame:
    """Pages, how many are well, have issues or failed (error not null), and the sums of their elements and words."""
    failed, flawed = F.col("error").isNotNull(), F.coalesce(F.size("issues"), F.lit(0)) > 0
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("elements", "headings", "paragraphs", "tables", "words")]
    return results.agg(F.count("*").alias("pages"), F.count_if(~failed & ~flawed).alias("ok"), F.count_if(flawed).alias("with_issues"), F.count_if(failed).alias("errors"), *sums)


def type_histogram(blocks: DataFrame) -> DataFrame:
    """(page_id, type, n); blocks without a type are unknown."""
    return blocks.groupBy("page_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def element_count(paragraphs: Column | str, preprocessed: Column | str) -> Column:
    """Paragraph blocks, and the spans of preprocessed blocks (lines of spans with a type) that aren't discarded."""
    kept = lambda line: F.size(F.filter(line["spans"], lambda s: ~s["type"].eqNullSafe("discarded")))
    of_block = lambda block: F.aggregate(block["lines"], F.lit(0), lambda n, line: n + kept(line))
    size = lambda c: F.coalesce(F.size(T.col(c)), F.lit(0))
    return size(paragraphs) + F.coalesce(F.aggregate(T.col(preprocessed), F.lit(0), lambda n, block: n + of_block(block)), F.lit(0))


def ocr_summary(pages: DataFrame) -> DataFrame:
    """Of page records (doc_id, seconds, confidence, recall): documents, pages, pooled seconds a page, mean confidence, and mean recall of pages that have one."""
    return pages.agg(
        F.count_distinct("doc_id").alias("docs"), F.count("*").alias("pages"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
        F.try_divide(F.sum("seconds"), F.count("*")).alias("seconds_per_page"), F.avg("confidence").alias("mean_confidence"), F.avg("recall").alias("mean_recall"),
    )


def throughput(pages: DataFrame) -> DataFrame:
    """Pages, seconds, and seconds a page; 0 without pages."""
    total = F.coalesce(F.sum("seconds"), F.lit(0.0))
    return pages.agg(F.count("*").alias("pages"), total.alias("seconds"), (total / F.greatest(F.count("*"), F.lit(1))).alias("seconds_per_page"))


def page_issues(page: Column) -> Column:
    """What a page (tables, links, lists: counts; typographic, overlap: flags) has, in the report's words."""
    at = F.concat(F.lit(" (page "), page.cast("string"), F.lit(")"))
    some = lambda c, what: F.when(F.col(c) > 0, F.concat(F.lit("Has "), F.col(c).cast("string"), F.lit(f" {what}"), at))
    flags = [F.when(F.col("typographic"), F.concat(F.lit("Has typographic chars"), at)), F.when(F.col("overlap"), F.concat(F.lit("Table-text overlap"), at))]
    return F.array_compact(F.array(some("tables", "tables"), some("links", "links"), some("lists", "list items"), *flags))


def document_issues(pages: DataFrame) -> DataFrame:
    """(doc_id, issues) of documents with issues: those of their pages, in order."""
    found = pages.select("doc_id", "page", page_issues(F.col("page")).alias("issues")).where(F.size("issues") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("page", "issues")))
    return found.groupBy("doc_id").agg(F.flatten(F.transform(ordered, lambda x: x["issues"])).alias("issues"))


def preview(c: Column | str, most: int, line: str = " ") -> Column:
    """The first characters of a text, its line breaks replaced, with dots if there are more."""
    c = T.col(c)
    return F.concat(F.replace(F.left(c, F.lit(most)), F.lit("\n"), F.lit(line)), F.when(F.length(c) > most, F.lit("...")).otherwise(F.lit("")))


def element_previews(elements: DataFrame, rows: int = 6, chars: int = 75, key: str = "doc_id") -> DataFrame:
    """(key, elem_no, preview, more): a text's first elements, by type and level, and how many more there are."""
    rest = F.greatest(F.count("*").over(Window.partitionBy(key)) - rows, F.lit(0))
    shown = F.concat(F.lit("["), F.upper(F.left("type", F.lit(1))), F.col("level").cast("string"), F.lit("] "), preview("text", chars))
    return elements.withColumn("more", rest).where(F.col("elem_no") < rows).select(key, "elem_no", shown.alias("preview"), "more")


def table_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a report as lines (value): columns joined by ' | ', nulls as a dash; to be written as text."""
    return df.select(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), " | ").alias("value"))


def saved_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """The translated pages (doc_id, page, ...), those of done, in order of document and page; a sink writes them so."""
    return pages.join(done.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").orderBy("doc_id", "page")
