"""Operators that carry state from row to row: line repair, alignment, mapping, rows of boxes, reading order.

Each works on the rows of one document or page, Arrow batch by Arrow batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from folioflow import config
from folioflow.functions import text as T


def repair(value: str) -> str:
    """Lines stripped; one that ends in a hyphen takes the first word of the next, which may leave that blank: a new paragraph."""
    out: list[str] = []
    rest = value.split("\n")[::-1]
    while rest:
        line = rest.pop().strip()
        if line.endswith("-") and rest and (follow := rest[-1].strip()):
            head, *tail = follow.split(None, 1)
            line, rest[-1] = line[:-1] + head, tail[0] if tail else ""
        out.append(line)
    return "\n".join(out)


@pandas_udf(StringType())
def fix_line_breaks(s: pd.Series) -> pd.Series:
    return s.map(repair, na_action="ignore")


def post_processed(c: Column | str, rules: list[tuple[str, str]] | None = None) -> Column:
    """OCR output cleaned: rules (config.OCR_RULES unless others are given), tidying, line repair, artifacts, white space."""
    return T.normalize_whitespace(T.without_artifacts(fix_line_breaks(T.cleaned_ocr(c, rules))))


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalized_for_translation(c: Column | str) -> Column:
    return T.mapped(nfkc(T.col(c)), config.QUOTES | config.DASHES)


def normalized_for_page(c: Column | str, ocr: bool = True) -> Column:
    """Ligatures and special spaces as plain characters; of OCR output quotes and dashes too."""
    return T.mapped(nfkc(T.col(c)), config.PAGE_QUOTES | config.PAGE_DASHES) if ocr else nfkc(T.col(c))


def align_sentences(sentences: Column | str, lines: Column) -> Column:
    """Sentences over lines, as an array: merged where there are more of them, else their words spread; no lines give one, no sentences blank ones.

    Where sentences outnumber lines, an end is the rounded share of lines before it: shares of more than one never round to the same end.
    """
    s = T.col(sentences)
    n = F.size(s)
    end = lambda k: F.when(k >= lines, n).otherwise(F.bround(k * (n / lines)).cast("int"))
    merged = F.transform(F.sequence(F.lit(1), lines), lambda k: F.array_join(F.slice(s, end(k - 1) + 1, end(k) - end(k - 1)), " "))
    blank = F.array_repeat(F.lit(""), lines)
    found = F.when(n == 0, blank).when(n == lines, s).when(n < lines, T.distributed(F.array_join(s, " "), lines)).otherwise(merged)
    return F.when(lines > 0, found).when(n > 0, F.array(F.array_join(s, " "))).otherwise(F.array().cast("array<string>"))


def _tagged(words: list[str], bold: bool, italic: bool) -> str:
    inner = " ".join(words).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for flag, tag in ((italic, "i"), (bold, "b")):
        inner = f"<{tag}>{inner}</{tag}>" if flag else inner
    return inner


def same_word(a: str, b: str) -> bool:
    """Equal, sharing a beginning, or one inside the other."""
    return bool(a and b) and (b.startswith(a[:4]) or a in b or b in a)


Format = tuple[bool, bool]


def rendered(words: list[str], formats: dict[int, Format], joins: Callable[[int], bool]) -> str:
    """Words with the tags of their formats (those without one are plain); neighbours share tags where joins says so of the second."""
    runs: list[tuple[Format, list[str]]] = []
    for i, w in enumerate(words):
        if runs and joins(i):
            runs[-1][1].append(w)
        else:
            runs.append((formats.get(i, (False, False)), [w]))
    return " ".join(_tagged(some, *f) for f, some in runs)


def matched(wanted: list[tuple[str, Format]], words: list[str]) -> dict[int, Format]:
    """Place of a word for each wanted text, in turn, with its format: the first similar word that is still free."""
    bare = [w.lower().strip(".,;:!?\"'()-") for w in words]
    taken: dict[int, Format] = {}
    for text, how in wanted:
        places = (i for i, w in enumerate(bare) if i not in taken and same_word(text.lower().strip(), w))
        if (place := next(places, -1)) >= 0:
            taken[place] = how
    return taken


def keyword_map(segments: list[tuple[str, bool, bool]], translated: str) -> str | None:
    """Formats of short bold or italic segments on similar words; null if none fits."""
    words = translated.split()
    found = matched([(t, (b, i)) for t, b, i in segments if (b or i) and len(t.split()) <= 3], words)
    return rendered(words, found, lambda k: k not in found and k - 1 not in found) if found else None


def shares(counts: list[int], total: int) -> list[int]:
    """Words for each segment: proportional, one at least while they last, the rest to the last."""
    out, given, whole = [], 0, sum(counts)
    for k, n in enumerate(counts):
        left = len(counts) - k - 1
        out.append(total - given if not left else min(max(1, round(n / whole * total)), total - given - left))
        given += out[-1]
    return out


def proportional_map(segments: list[tuple[str, bool, bool]], translated: str) -> str:
    counts, words = [len(t.split()) for t, _, _ in segments], translated.split()
    if not sum(counts) or not words:
        return translated
    owner = [k for k, n in enumerate(shares(counts, len(words))) for _ in range(n)][: len(words)]
    return rendered(words, {i: segments[k][1:] for i, k in enumerate(owner)}, lambda i: owner[i] == owner[i - 1])


def formatted(segments: list[tuple[str, bool, bool]], translated: str) -> str:
    """Formats of the original's segments on a translation."""
    if not any(b or i for _, b, i in segments):
        return translated
    if len(segments) == 1:
        return _tagged(translated.split(), *segments[0][1:])
    found = keyword_map(segments, translated)
    return proportional_map(segments, translated) if found is None else found


def _mapper(f):
    def run(segments: pd.Series, translated: pd.Series) -> pd.Series:
        return pd.Series([f([(s["text"], s["bold"], s["italic"]) for s in some], t) for some, t in zip(segments, translated, strict=True)], dtype=object)

    return pandas_udf(run, StringType())


keyword_format_map, proportional_format_map, format_map = _mapper(keyword_map), _mapper(proportional_map), _mapper(formatted)


def visual_rows(ys: list[float], threshold: float) -> list[int]:
    """Row of each box in order of y: a new one where y is further than the threshold from the row's first."""
    out, anchor = [], None
    for y in ys:
        if anchor is None or abs(y - anchor) > threshold:
            anchor = y
            out.append(out[-1] + 1 if out else 0)
        else:
            out.append(out[-1])
    return out


@dataclass
class Boxes:
    """Boxes of a page, by the height of their middle, then from the left."""

    page: int
    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    number: np.ndarray
    texts: list[str]
    tall: float
    width: float

    def some(self, keep: np.ndarray) -> Boxes:
        at = np.flatnonzero(keep)
        return Boxes(self.page, self.y[at], self.x0[at], self.x1[at], self.number[at], [self.texts[k] for k in at.tolist()], self.tall, self.width)


def page_boxes(table: pa.Table) -> Iterator[Boxes]:
    """Pages of rows (page_id, box_no, txt, x_min, x_max, y_min, y_max, width) of whole pages."""
    page, number, x0, x1, low, high, width = (table[c].to_numpy() for c in ("page_id", "box_no", "x_min", "x_max", "y_min", "y_max", "width"))
    texts = table["txt"].to_pylist()
    y = (low + high) / 2
    order = np.lexsort((number, x0, y, page))
    at = np.concatenate([[0], np.flatnonzero(np.diff(page[order])) + 1, [len(order)]]).tolist()
    for a, b in zip(at, at[1:], strict=False):
        k = order[a:b]
        yield Boxes(int(page[k[0]]), y[k], x0[k], x1[k], number[k], [texts[i] for i in k.tolist()], float((high[k] - low[k]).mean()), float(width[k[0]]))


def gap_columns(boxes: Boxes) -> list[tuple[float, float]]:
    """Columns of a page by gaps that recur over its rows; one column if there are none."""
    width, tall = boxes.width, boxes.tall
    one = [(0.0, width)]
    if not len(boxes.y) or width <= 0:
        return one
    row = np.array(visual_rows(boxes.y.tolist(), 0.5 * tall))
    several = int((np.bincount(row) >= 2).sum())
    if row[-1] + 1 < 3 or several < 3:
        return one
    order = np.lexsort((boxes.number, boxes.x0, row))
    left, right, row = boxes.x0[order][1:], boxes.x1[order][:-1], row[order]
    wide = (row[1:] == row[:-1]) & (left - right >= 1.5 * tall)
    slot = width / 200
    histogram = np.bincount(((right + left)[wide] / 2 / slot).astype(int).clip(0, 199), minlength=200)
    peaks = np.flatnonzero(np.convolve(histogram, np.ones(5), "same") >= max(3, int(0.25 * several)))
    if not len(peaks):
        return one
    middles = [(p[0] + p[-1]) / 2 * slot for p in np.split(peaks, np.flatnonzero(np.diff(peaks) > 6) + 1)]
    bounds = [0.0, *(b for b in middles if 0.05 * width < b < 0.95 * width), width]
    merged: list[tuple[float, float]] = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 0.08 * width and merged:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    enough = max(3, 0.05 * len(boxes.y))
    held = [(a, b) for a, b in merged if ((boxes.x0 >= a - tall) & (boxes.x1 <= b + tall)).sum() >= enough]
    return held if len(held) > 1 and len(merged) > 1 else one


def _text_rows(boxes: Boxes) -> list[tuple[float, str]]:
    """Height and text of each visual row."""
    rows: list[tuple[float, list[tuple[float, int, str]]]] = []
    ys = boxes.y.tolist()
    for k, y, *box in zip(visual_rows(ys, 0.5 * boxes.tall), ys, boxes.x0.tolist(), boxes.number.tolist(), boxes.texts, strict=True):
        if k == len(rows):
            rows.append((y, []))
        rows[k][1].append(tuple(box))
    return [(y, " ".join(t for _, _, t in sorted(row))) for y, row in rows]


def _with_gaps(rows: list[tuple[float, str]], tall: float) -> list[str]:
    out: list[str] = []
    for k, (y, t) in enumerate(rows):
        out += [""] if k and y - rows[k - 1][0] > 1.5 * tall else []
        out.append(t)
    return out


def ordered_text(boxes: Boxes) -> str:
    """A page's text in reading order: full-width rows above, columns in turn, full-width rows below."""
    tall, columns = boxes.tall, gap_columns(boxes)
    if len(columns) < 2:
        return "\n".join(_with_gaps(_text_rows(boxes), tall))
    full = boxes.x1 - boxes.x0 > 0.7 * boxes.width
    across, inner = _text_rows(boxes.some(full)), boxes.some(~full)
    home = np.argmax([(np.minimum(inner.x1, b) - np.maximum(inner.x0, a)).clip(0) for a, b in columns], axis=0)
    parts = [p for k in range(len(columns)) if (p := _text_rows(inner.some(home == k)))]
    tops, ends = [p[0][0] for p in parts], [p[-1][0] for p in parts]
    head = [t for y, t in across if not tops or y < min(tops) - tall]
    foot = [t for y, t in across if ends and y > max(ends) + tall]
    return "\n\n".join("\n".join(p) for p in [head, *(_with_gaps(p, tall) for p in parts), foot] if p)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _by_page(boxes: DataFrame, of_page: Callable[[Boxes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that of_page makes of each page, from Arrow batches of many pages; a page whose rows go on in the next batch waits for them."""
    columns = ["page_id", "box_no", "txt", "x_min", "x_max", "y_min", "y_max", "width"]
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in schema.split(", "))])

    def made(table: pa.Table) -> pa.RecordBatch:
        rows = [row for page in page_boxes(table) for row in of_page(page)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            page = batch.column(0).to_numpy()
            first = int(np.searchsorted(page, page[-1]))  # of the last page, which may go on
            if first or (held and held[-1].column(0)[-1].as_py() != page[0]):
                yield made(pa.Table.from_batches([*held, batch.slice(0, first)]))
                held = []
            held.append(batch.slice(first))
        if held:
            yield made(pa.Table.from_batches(held))

    some = boxes.select(F.col("page_id").cast("long").alias("page_id"), *columns[1:])
    return some.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(run, schema)


def columns_by_ocr_gaps(boxes: DataFrame) -> DataFrame:
    """(page_id, col_no, x0, x1) of boxes (page_id, box_no, txt, x_min, x_max, y_min, y_max, width)."""
    return _by_page(boxes, lambda b: ((b.page, k, x0, x1) for k, (x0, x1) in enumerate(gap_columns(b))), "page_id long, col_no long, x0 double, x1 double")


def reading_order(boxes: DataFrame) -> DataFrame:
    """(page_id, text) of the same boxes."""
    return _by_page(boxes, lambda b: iter([(b.page, ordered_text(b))]), "page_id long, text string")


def packed(sentences: list[str], most: int = 1500) -> list[str]:
    """Sentences in chunks joined by spaces; one that would take the sum of their lengths beyond `most` begins the next chunk, which leaves an empty chunk where the first is that long."""
    out: list[str] = []
    now: list[str] = []
    for s in sentences:
        if sum(map(len, now)) + len(s) > most:
            out.append(" ".join(now))
            now = []
        now.append(s)
    return [*out, " ".join(now)] if now else out


@pandas_udf(ArrayType(StringType()))
def packed_sentences(sentences: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([packed(list(s), int(n)) for s, n in zip(sentences, most, strict=True)], dtype=object)


def anchored_rows(boxes: DataFrame) -> DataFrame:
    """(page_id, box_no, row): visual rows, by distance from each row's first box."""

    def of_page(b: Boxes) -> Iterator[tuple]:
        return ((b.page, n, r) for n, r in zip(b.number.tolist(), visual_rows(b.y.tolist(), 0.5 * b.tall), strict=True))

    return _by_page(boxes, of_page, "page_id long, box_no long, row long")
