"""Measures of pages, documents and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as T


def page_metrics(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines, words, characters, font range, small fonts and overlaps of each page.

    A line overlaps if it begins more than the tolerance above the end of the line before it in its block.
    """
    before = F.lag("y1").over(Window.partitionBy("page_id", "block_no").orderBy("line_no"))
    some = lines.withColumn("overlaps", F.coalesce((before > 0) & (F.col("y0") < before - tolerance), F.lit(False)))
    return some.groupBy("page_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.size(T.words("text")).cast("long")).alias("n_words"), F.sum(F.length("text").cast("long")).alias("n_chars"),
        F.min("size").alias("min_font"), F.max("size").alias("max_font"), F.count_if(F.col("size") < config.SMALL_FONT).alias("under_7"), F.count_if("overlaps").alias("overlaps"),
    )


def percent(part: Column, whole: Column) -> Column:
    return 100 * T.ratio(part, whole)


def corpus_summary(pages: DataFrame) -> DataFrame:
    """From page metrics with doc and seconds: shares are means of the documents' means, time is pooled."""
    docs = pages.groupBy("doc").agg(
        F.avg(percent(F.col("overlaps"), F.col("n_lines"))).alias("overlap"), F.avg(percent(F.col("under_7"), F.col("n_lines"))).alias("small"), F.sum("seconds").alias("seconds"), F.count("*").alias("n_pages")
    )
    return docs.agg(
        F.count("*").alias("docs"), F.sum("n_pages").alias("pages"), F.avg("overlap").alias("mean_overlap"), F.avg("small").alias("mean_small"),
        T.ratio(F.sum("seconds"), F.sum("n_pages")).alias("seconds_per_page"), F.count_if(F.col("overlap") < 10).alias("docs_ok"),
    )


def recall(text: Column | str, keywords: Column) -> Column:
    """struct(total, found, recall, band, missing) of an array of keywords within a text, without case; missing ones in order, joined by ';'."""

    def counted(lost: Column) -> Column:
        total = F.size(keywords).cast("long")
        found = total - F.size(lost)
        share = T.ratio(found, total)
        band = F.when(share >= 0.9, "good").when(share >= 0.7, "fair").otherwise("poor")
        return F.struct(total.alias("total"), found.alias("found"), share.alias("recall"), band.alias("band"), F.array_join(F.array_sort(lost), ";").alias("missing"))

    lower = F.lower(T.col(text))
    return T.let(F.filter(keywords, lambda k: ~F.coalesce(F.contains(lower, F.lower(k)), F.lit(False))), counted)


def keyword_recall(texts: DataFrame, keywords: list[str] | DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total, found, recall, band, missing) of texts (key, text): the same keywords for all, or those of rows (key, keyword), gathered by key so that a text moves once."""
    if isinstance(keywords, DataFrame):
        texts = texts.select(key, "text").join(keywords.groupBy(key).agg(F.collect_list("keyword").alias("__keywords")), key)
        wanted = F.col("__keywords")
    else:
        wanted = F.array(*map(F.lit, keywords))
    return texts.select(key, recall("text", wanted).alias("r")).select(key, "r.*")


def y_span(lines: DataFrame, name: str, blocks: bool = False) -> DataFrame:
    """Height between the first and last non-blank line's tops (of blocks: from top to bottom), and their number."""
    low = F.max("y1" if blocks else "y0")
    return lines.where(T.strip("text") != "").groupBy("page_id").agg((low - F.min("y0")).alias(f"{name}_span"), F.count("*").alias(f"{name}_n"))


def preserved(before: DataFrame, after: DataFrame, low: float = 0.8, high: float = 1.3, blocks: bool = False) -> DataFrame:
    """(page_id, ratio, ok): whether a page keeps its vertical extent."""
    both = y_span(before, "before", blocks).join(y_span(after, "after", blocks), "page_id")
    both = both.withColumn("ratio", T.ratio(F.col("after_span"), F.col("before_span")))
    return both.select("page_id", "ratio", F.col("ratio").between(low, high).alias("ok"))


def audit_flags(c: Column) -> Column:
    n, chars = F.size(T.words(c)), F.length(T.strip(c))
    return F.concat_ws(",", F.when((n < 5) & (chars > 20), "LOW_WORDS"), F.when(chars == 0, "NO_CONTENT"), F.when(chars < 20, "EMPTY"), F.when(T.cjk(c) > 5, "CJK"))


def completeness(output: Column, calls: Column) -> Column:
    """none, incomplete or complete, by the mock translator's marks."""
    marks = T.count(output, r"\[TR\] ")
    return F.when(marks == 0, "none").when(marks < calls, "incomplete").otherwise("complete")


def ocr_page_record(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(
        {"chars": F.length(text), "words": F.size(T.words(text)), "lines": T.count(text, "\n") + 1, "confidence": T.ocr_confidence(text)}
    )


def mean_confidence(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("confidence"), F.count("*").alias("boxes"))


def column_sides(words: DataFrame, middle: Column) -> DataFrame:
    """Words left and right of the middle; more than three on each side make two columns."""
    out = words.groupBy("page_id").agg(F.count_if(F.col("x1") < middle).alias("left"), F.count_if(F.col("x0") > middle).alias("right"))
    return out.withColumn("two_columns", (F.col("left") > 3) & (F.col("right") > 3))


def compared(before: DataFrame, after: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Blocks, lines, characters, mean size and vertical extent of each page before and after, with ratios; with media (page_id, links_before, links_after), links lost."""
    def stats(x: DataFrame, tag: str) -> DataFrame:
        return x.groupBy("page_id").agg(
            F.count_distinct("block_no").alias(f"{tag}_blocks"), F.count("*").alias(f"{tag}_lines"), F.sum(F.length("text").cast("long")).alias(f"{tag}_chars"),
            F.bround(F.avg("size"), 1).alias(f"{tag}_size"), F.bround(F.max("y0") - F.min("y0"), 1).alias(f"{tag}_y_span"),
        )

    both = stats(before, "old").join(stats(after, "new"), "page_id", "full")
    share = lambda name: F.bround(T.ratio(F.col(f"new_{name}"), F.col(f"old_{name}")), 2).alias(f"{name}_ratio")
    if media is not None:
        both = both.join(media.select("page_id", (F.col("links_before") - F.col("links_after")).alias("links_lost")), "page_id", "left")
    return both.select("*", share("chars"), share("y_span"), share("size"))


def representative_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, audit, body) of docs (doc_id, pages: an array of page numbers): the first page and, beyond three, the third; and the page nearest the third."""
    p = F.array_sort("pages")
    audit = F.when(F.size(p) > 3, F.array(F.get(p, F.lit(0)), F.get(p, F.lit(2)))).otherwise(F.slice(p, 1, 1))
    return docs.select("doc_id", audit.alias("audit"), F.coalesce(F.get(p, F.lit(2)), F.get(p, F.lit(1)), F.get(p, F.lit(0))).alias("body"))


def first_pages(pages: DataFrame, most: int, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """The first pages of each document; fewer where it has fewer."""
    return pages.withColumn("__k", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("__k") <= most).drop("__k")


def page_at(pages: Column, number: Column) -> Column:
    """The page with a number from 0 of an array of pages; an error if there is none."""
    inside = (number >= 0) & (number < F.size(pages))
    return F.when(inside, F.get(pages, number)).otherwise(F.raise_error(F.concat(F.lit("no page "), number.cast("string"), F.lit(" of "), F.size(pages).cast("string"))))


def chosen_text(candidates: DataFrame) -> DataFrame:
    """Text of each page from candidates (page_id, method_ord, method, text, ocr_text).

    The first method whose quality exceeds 0.8 wins, else the best; texts of ten characters or fewer are no candidates. OCR
    replaces a poor result if it is better or has half as many words again.
    """
    some = candidates.withColumn("quality", T.quality("text")).withColumns({"q": F.col("quality.score"), "n": F.col("quality.words")}).drop("quality")
    usable = F.length(T.strip("text")) > 10
    good = F.when(usable & (F.col("q") > config.GOOD_QUALITY), -F.col("method_ord"))
    rank = F.struct(usable.alias("u"), F.coalesce(good, F.lit(-1_000_000)).alias("g"), "q", (-F.col("method_ord")).alias("o"))
    best = some.groupBy("page_id").agg(F.max_by(F.struct("method", "text", "q", "n", usable.alias("usable")), rank).alias("b"), F.max("ocr_text").alias("ocr"))
    best = best.select("page_id", "b.*", "ocr", T.quality("ocr").alias("o")).withColumns({"ocr_q": F.col("o.score"), "ocr_n": F.col("o.words")}).drop("o")
    fair = F.col("usable") & ((F.col("q") > config.GOOD_QUALITY) | ((F.col("q") >= config.FAIR_QUALITY) & (F.col("n") >= config.FAIR_WORDS)))
    q, n = F.when(F.col("usable"), F.col("q")).otherwise(F.lit(0.0)), F.when(F.col("usable"), F.col("n")).otherwise(F.lit(0))
    ocr = F.col("ocr").isNotNull() & ((F.col("ocr_q") > q) | (F.col("ocr_n") > 1.5 * n))
    method = F.when(fair, F.col("method")).when(ocr, F.lit("ocr")).when(F.col("usable"), F.col("method")).otherwise(F.lit("none"))
    return best.select("page_id", method.alias("method"), F.when(method == "ocr", F.col("ocr")).when(method == "none", F.lit("[no text]")).otherwise(F.col("text")).alias("text"))


def sampled_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page): all pages of short documents, else four; docs have n_pages."""
    n = F.col("n_pages")
    some = F.when(n <= 4, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(1), F.lit(3), F.floor(n / 2).cast("int"), F.least(n, F.lit(20))))
    return docs.where("n_pages >= 1").select("doc_id", "n_pages", F.explode(some).alias("page")).where("page <= n_pages").select("doc_id", "page")


def pending(pages: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.join(done, key, "left_anti")
