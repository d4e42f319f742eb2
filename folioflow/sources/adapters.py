"""Interfaces for what needs other engines: translation, OCR, PDF. Only the marking translator is shipped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as T
from folioflow.operators import folds, layout


class Translator(Protocol):
    """Translates a batch of texts; one instance lives in each worker."""

    def translate(self, texts: list[str]) -> list[str]: ...


class MarkTranslator:
    """Marks what was asked for, as tests need it."""

    def translate(self, texts: list[str]) -> list[str]:
        return [f"[TR] {t}" for t in texts]


class IdentityTranslator:
    def translate(self, texts: list[str]) -> list[str]:
        return list(texts)


class Recognizer(Protocol):
    """Reads text off a page's image: (text, confidence); mode is text or table."""

    def is_available(self) -> bool: ...

    def recognize_text(self, image: bytes, mode: str = "text") -> tuple[str, float]: ...


class LayoutReader(Protocol):
    """Markdown of a page of a PDF file, with its blocks and size."""

    def extract_page_markdown(self, pdf: bytes, page_num: int) -> tuple[str, dict]: ...


class Renderer(Protocol):
    """Draws a page of a PDF file: (PNG bytes, width, height)."""

    def render(self, pdf: bytes, page_num: int, zoom: float) -> tuple[bytes, int, int]: ...


class ImageTools(Protocol):
    """What OCR wants done to a page's image."""

    def size(self, image: bytes) -> tuple[int, int]: ...

    def prepare(self, image: bytes, crop_below: int, width: int, height: int, pad: int, contrast: float, sharpness: float) -> bytes: ...


class ColumnFinder(Protocol):
    """Columns of a native page: (x0, x1) from the left, of its blocks (x0, y0, x1, y1)."""

    def columns(self, blocks: list[tuple[float, float, float, float]], width: float) -> list[tuple[float, float]]: ...


def might_contain_table(text: str) -> bool:
    """As functions.text.might_contain_table, for a worker that has just read the text."""
    return text.count("|") > 4 or "\t" in text or sum("   " in line.strip() for line in text.split("\n")) > 3


def recognized_page(engine: Recognizer, image: bytes, tables: bool = True) -> str:
    """A page's text; where it may hold a table it is read again as one, which counts if the engine is surer of it."""
    text, sure = engine.recognize_text(image, "text")
    if text and tables and might_contain_table(text):
        again, surer = engine.recognize_text(image, "table")
        if again and surer > sure:
            return again
    return text or ""


def model_pair(source: str, target: str) -> tuple[str, str]:
    """A language pair that models exist for: one of the two is English; others raise ValueError."""
    codes = set(config.LANGUAGES.values())
    if not {source, target} <= codes or source == target or "en" not in (source, target):
        raise ValueError(f"no model from {source} to {target}")
    return source, target


_loaded: dict[object, Translator] = {}
MOST_LOADED = 4


def translator_of(source: str, target: str, load: Callable[[str, str], Translator]) -> Translator:
    """A worker's translator of a language pair."""
    pair = model_pair(source, target)
    return cached(pair, lambda: load(*pair))


def cached(key: object, load: Callable[[], Translator]) -> Translator:
    """A worker's model of a key; the least recently used one makes room for a fifth."""
    found = _loaded.pop(key, None) or load()
    _loaded[key] = found
    while len(_loaded) > MOST_LOADED:
        _loaded.pop(next(iter(_loaded)))
    return found


def translate(units: DataFrame, translator: Translator) -> DataFrame:
    """units (page_id, unit_no, source) with translated. Texts of under two characters stay as they are, a blank or failed result is the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("source").to_pylist()
            asked = [k for k, t in enumerate(source) if t and len(t.strip()) >= 2]
            try:
                said = translator.translate([source[k] for k in asked])
            except Exception:
                said = [source[k] for k in asked]
            out = list(source)
            for k, t in zip(asked, said, strict=True):
                out[k] = t if t and t.strip() else source[k]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("unit_no"), batch.column("source"), pa.array(out, pa.string())], ["page_id", "unit_no", "source", "translated"])

    return units.select(F.col("page_id").cast("long"), F.col("unit_no").cast("int"), "source").mapInArrow(run, "page_id long, unit_no int, source string, translated string")


def list_files(spark: SparkSession, paths: list[str], pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(path, length) of files of that name under any of the folders, each once, in order; folders may overlap."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = [reader.load(p).select("path", "length") for p in paths]
    return reduce(DataFrame.unionByName, found).distinct().orderBy("path")


class Unreadable(RuntimeError):
    """A file that the parser can't open; names it."""


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """One row a page of the PDF files under path: path, page_no (from 0) and what parse gives for it, as JSON. A file that can't be parsed fails the query with its name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # a file at a time
                try:
                    pages = [json.dumps(page) for page in parse(content.as_py())]
                except Exception as wrong:
                    raise Unreadable(f"{name}: {wrong}") from wrong
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pages)), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.string())], ["path", "page_no", "page"])

    return files.mapInArrow(run, "path string, page_no int, page string")


def render_pages(pages: DataFrame, renderer: Renderer, zoom: float = 2.0) -> DataFrame:
    """(page_id, image, width, height) of pages (page_id, image: struct(pdf, page_no)); nulls where drawing fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, page in zip(batch.column(0), batch.column(1), strict=True):  # an image at a time
                try:
                    drawn = renderer.render(page["pdf"].as_py(), page["page_no"].as_py(), zoom)
                except Exception:
                    drawn = (None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), *(pa.array([v], k) for v, k in zip(drawn, (pa.binary(), pa.int32(), pa.int32()), strict=True))], ["page_id", "image", "width", "height"])

    return pages.select(F.col("page_id").cast("long"), "image").mapInArrow(run, "page_id long, image binary, width int, height int")


def side_by_side(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, before, after): rendered pages of an original and its translation, for a viewer or a writer; pages that both have."""
    return before.select("page_id", F.col("image").alias("before")).join(after.select("page_id", F.col("image").alias("after")), "page_id")


def prepared_images(images: DataFrame, tools: ImageTools, most: int = 3000, least: int = 300, crop_below: int = 240, contrast: float = 1.3, sharpness: float = 1.5) -> DataFrame:
    """(page_id, image) of rendered pages made ready for OCR: cropped, shrunk to `most` and padded to `least` pixels (layout.fitted()), with more contrast and sharpness; unchanged where the tools fail.

    Where OCR then finds nothing, callers render at three quarters of the resolution and try again.
    """

    def one(image: bytes) -> bytes:
        try:
            width, height = tools.size(image)
            scale = min(1.0, most / max(width, height))
            return tools.prepare(image, crop_below, max(int(width * scale), 1), max(int(height * scale), 1), least, contrast, sharpness)
        except Exception:
            return image

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, image in zip(batch.column(0), batch.column(1), strict=True):
                value = image.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), pa.array([None if value is None else one(value)], pa.binary())], ["page_id", "image"])

    return images.select(F.col("page_id").cast("long"), "image").mapInArrow(run, "page_id long, image binary")


def native_columns(blocks: DataFrame, finder: ColumnFinder | None = None) -> DataFrame:
    """(page_id, col_no, x0, x1) of blocks (page_id, type, x0, y0, x1, y1, width) by an engine's column finder; without one, by gaps (layout.columns_by_gap())."""
    if finder is None:
        return layout.columns_by_gap(blocks)
    boxes = F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1")))
    pages = blocks.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(boxes.alias("boxes"), F.max("width").cast("double").alias("width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, some, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = finder.columns([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in some], width)
                rows += [(key, k, float(x0), float(x1)) for k, (x0, x1) in enumerate(found)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["page_id", "col_no", "x0", "x1"])

    return pages.mapInArrow(run, "page_id long, col_no long, x0 double, x1 double")


def read_scans(pages: DataFrame, engine: Recognizer, tables: bool = True) -> DataFrame:
    """(page_id, text) of page images (page_id, image); null where the engine isn't there, fails or finds nothing."""

    def one(image: bytes | None) -> str | None:
        try:
            return (recognized_page(engine, image, tables) or None) if image is not None and engine.is_available() else None
        except Exception:
            return None

    return _mapped(pages.select("page_id", "image"), one)


def read_layouts(pages: DataFrame, engine: LayoutReader) -> DataFrame:
    """(page_id, text): markdown of pages (page_id, image: struct(pdf, page_no)); null where the engine fails or gives fewer than 5 characters."""

    def one(page: dict | None) -> str | None:
        try:
            found = engine.extract_page_markdown(page["pdf"], page["page_no"])[0] if page else None
        except Exception:
            return None
        return found if found and len(found.strip()) >= config.SHORTEST_MARKDOWN else None

    return _mapped(pages.select("page_id", "image"), one)


def _mapped(rows: DataFrame, one: Callable[[object], str | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x.as_py()) for x in batch.column(1)], pa.string())], ["page_id", "text"])

    return rows.select(F.col("page_id").cast("long"), "image").mapInArrow(run, "page_id long, text string")


def fallback(pages: DataFrame, layout: DataFrame, ocr: DataFrame) -> DataFrame:
    """(page_id, source, text) of pages (page_id, text): markdown of the layout reader where there are 5 characters, else OCR output cleaned, else the page unchanged.

    layout and ocr are (page_id, text) with a row a page at most, or none where an engine isn't there or failed.
    """
    cleaned = folds.post_processed("ocr_text")
    long = lambda c, least: F.when(F.length(T.strip(c)) >= least, F.col(c))
    both = pages.select("page_id", "text").join(layout.select("page_id", F.col("text").alias("markdown")), "page_id", "left")
    both = both.join(ocr.select("page_id", F.col("text").alias("ocr_text")), "page_id", "left")
    both = both.withColumn("markdown", long("markdown", config.SHORTEST_MARKDOWN)).withColumn("cleaned", cleaned).withColumn("cleaned", long("cleaned", config.SHORTEST_OCR))
    source = F.when(F.col("markdown").isNotNull(), F.lit("layout")).when(F.col("cleaned").isNotNull(), F.lit("ocr")).otherwise(F.lit("unchanged"))
    return both.select("page_id", source.alias("source"), F.coalesce("markdown", "cleaned", "text").alias("text"))


def read_ocr_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, pages, seconds, text) of text dumps, whose pages begin with `--- Pagina k/n ---` and `Tempo: s`."""
    return parse_ocr_dumps(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def parse_ocr_dumps(files: DataFrame) -> DataFrame:
    """The same of rows (path, value). What precedes the first page goes; a page without a time has null seconds."""
    header = r"--- Pagina (\d+)/(\d+) ---"
    found = files.select("path", F.regexp_extract_all("value", F.lit(header), 1).alias("k"), F.regexp_extract_all("value", F.lit(header), 2).alias("n"), F.slice(F.split("value", header), 2, 1_000_000).alias("body"))
    rows = found.select("path", F.explode(F.arrays_zip("k", "n", "body")).alias("p"))
    time = r"^\s*Tempo:\s*([0-9.]+)\s*s\s*"
    return rows.select(
        "path", F.col("p.k").cast("int").alias("page_no"), F.col("p.n").cast("int").alias("pages"), F.regexp_extract("p.body", time, 1).try_cast("double").alias("seconds"),
        T.strip(F.regexp_replace("p.body", time, "")).alias("text"),
    )


def write_report(lines: DataFrame, path: str) -> None:
    """Lines (value) as text files."""
    lines.select("value").write.mode("overwrite").text(path)
