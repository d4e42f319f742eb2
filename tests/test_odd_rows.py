"""Operators on nulls, empty texts, ties, repeated rows, empty tables and clashing columns; the docstrings say what each gives."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import elements as E
from folioflow.operators import extraction, folds, layout, metrics, reports, spans
from folioflow.operators.sentences import sentence_counts, sentences

LONG = "word " * 30_000 + "end."


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\u00a0 "), (4, "One. Two!"), (4, "One. Two!"), (5, LONG), (None, "| a |\n|---|\n# h"), (6, "1. x - y\n-\n\x00é😀")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(1, 0, 0, "A line of text that is long enough to count.", 72.0, 500.0, 10.0, 22.0, 11.0, True), (1, 0, 1, None, None, None, None, None, None, None), (1, 0, 1, "", 72.0, 72.0, 30.0, 41.0, 11.0, False),
            (1, 1, 0, "tie", 72.0, 90.0, 10.0, 22.0, 11.0, True), (None, 0, 0, "no page", 1.0, 2.0, 3.0, 4.0, 5.0, False), (2, 0, 0, "zero", 0.0, 0.0, 0.0, 0.0, 0.0, False), (1, 2, 0, "Title", 72.0, 90.0, 1.0, 9.0, 20.0, True)]
    schema = "page_id long, block_no long, line_no long, text string, x0 double, x1 double, y0 double, y1 double, size double, bold boolean"
    return spark.createDataFrame(rows, schema).withColumns({"doc_id": F.col("page_id"), "height": F.lit(842.0), "width": F.lit(595.0), "flags": F.lit(0), "font": F.lit("Times"), "color": F.lit(0)})


FUNCTIONS = {
    "quality": lambda c: T.quality(c), "confidence": lambda c: T.ocr_confidence(c), "tidy": lambda c: T.tidy(c), "cleaned": lambda c: T.cleaned_ocr(c), "white": lambda c: T.normalize_whitespace(c),
    "artifacts": lambda c: T.without_artifacts(c), "markdown": lambda c: T.strip_markdown(c), "kind": lambda c: T.list_kind(c), "prefix": lambda c: T.translated_after_prefix(c), "escape": lambda c: T.escape_quotes(c),
    "tags": lambda c: T.strip_tags(c), "cells": lambda c: T.cells(c), "table": lambda c: T.table_html(c), "urls": lambda c: T.protect_urls(c), "terms": lambda c: T.protect_terms(c, ["a", "e"]),
    "title": lambda c: T.title_like(c), "capitals": lambda c: T.capital_sentences(c), "simple": lambda c: T.simple_html(c), "spread": lambda c: T.distributed(F.col(c), F.lit(3)), "page": lambda c: folds.normalized_for_page(c),
    "post": lambda c: folds.post_processed(c), "flags": lambda c: metrics.audit_flags(F.col(c)), "recall": lambda c: metrics.recall(c, F.array(F.lit("one"), F.lit("x"))), "preview": lambda c: reports.preview(c, 5),
    "cut": lambda c: layout.truncated(F.col(c), F.lit(10.0), F.lit(8.0)),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_functions(spark, texts, name):
    got = texts.select(FUNCTIONS[name]("text").alias("x"))
    assert got.count() == texts.count() and got.collect()
    assert texts.limit(0).select(FUNCTIONS[name]("text").alias("x")).collect() == []


def test_null_and_blank_texts(spark, texts):
    got = {r.doc_id: r for r in texts.where("doc_id < 4").select("doc_id", T.quality("text").alias("q"), T.ocr_confidence("text").alias("c"), metrics.recall("text", F.array(F.lit("k"))).alias("r")).collect()}
    assert all((r.q.score, r.q.issues, r.q.words, r.c, r.r.found, r.r.recall) == (0.0, "empty_or_too_short", 0, 0.0, 0, 0.0) for r in got.values())


def test_sentences_of_odd_texts(texts):
    got = [(r.doc_id, r.sentence[:5]) for r in sentences(texts).collect()]
    assert sorted(x for x in got if x[0] == 4) == [(4, "One."), (4, "One."), (4, "Two!"), (4, "Two!")] and not {1, 2, 3} & {d for d, _ in got} and (5, "word ") in got
    counts = sentence_counts(texts.withColumn("n", F.lit("x")), "lang").collect()
    assert len(counts) == 1 and counts[0].n == len(got) and sentence_counts(texts.limit(0), "lang").count() == 0


PAGES = {
    "levels": lambda x: layout.heading_levels(x), "paragraphs": lambda x: layout.paragraphs(layout.with_headings(x, layout.heading_levels(x))), "blocks": lambda x: layout.blocks(x),
    "alignment": lambda x: layout.alignment(x, 595), "metrics": lambda x: metrics.page_metrics(x, 1), "compared": lambda x: metrics.compared(x, x), "preserved": lambda x: metrics.preserved(x, x),
    "boxes": lambda x: layout.paragraph_boxes(x.withColumn("group_no", F.col("line_no")), x), "gaps": lambda x: layout.sparse_gaps(x.withColumns({"n_elements": F.lit(2), "room": F.lit(700.0)})),
    "tables": lambda x: layout.in_table(x, x), "excluded": lambda x: layout.without_tables(x, x), "sides": lambda x: metrics.column_sides(x, F.lit(300.0)),
    "style": lambda x: spans.line_style(spans.with_defaults(x.withColumn("span_no", F.lit(0)))), "runs": lambda x: spans.runs(spans.with_defaults(x.withColumn("span_no", F.lit(0)))),
    "methods": lambda x: extraction.extracted(x, x.withColumn("span_no", F.lit(0))),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(lines, name):
    got = PAGES[name](lines).collect()
    assert got and PAGES[name](lines.limit(0)).collect() == []
    more = lines.withColumns({"gap": F.lit("x"), "k": F.lit("x"), "n": F.lit("x"), "piece": F.lit("x")}) if name not in ("gaps",) else lines
    names = PAGES[name](lines).columns
    assert sorted(map(str, PAGES[name](more).select(*names).collect())) == sorted(map(str, got))


def test_folds_of_odd_boxes(spark):
    rows = [(1, 0, "b", 5.0, 9.0, 0.0, 4.0, 100.0), (1, 1, "a", 5.0, 9.0, 0.0, 4.0, 100.0), (1, 1, "a", 5.0, 9.0, 0.0, 4.0, 100.0), (2, 0, "", 0.0, 0.0, 0.0, 0.0, 0.0)]
    boxes = spark.createDataFrame(rows, "page_id long, box_no long, txt string, x_min double, x_max double, y_min double, y_max double, width double")
    assert {r.page_id: r.text for r in folds.reading_order(boxes).collect()} == {1: "b a a", 2: ""}
    assert folds.anchored_rows(boxes).count() == 4 and folds.columns_by_ocr_gaps(boxes).count() == 2
    assert folds.reading_order(boxes.limit(0)).count() == folds.columns_by_ocr_gaps(boxes.limit(0)).count() == 0


def test_reports_of_nothing(spark, texts):
    records = spark.createDataFrame([], "doc_id long, seconds double, confidence double, recall double")
    assert tuple(reports.ocr_summary(records).first()) == (0, 0, 0.0, None, None, None) and tuple(reports.throughput(records).first()) == (0, 0.0, 0.0)
    got = reports.audited(E.elements(texts.where("doc_id is not null")), texts).collect()
    assert len(got) == texts.count() and {r.doc_id: r.issues for r in got}[1] == ["NO_CONTENT", "EMPTY"]
    assert reports.audit_summary(reports.audited(E.elements(texts.limit(0)), texts.limit(0)).withColumn("error", F.lit(None).cast("string"))).first().pages == 0
