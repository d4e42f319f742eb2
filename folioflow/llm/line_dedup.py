"""Shared passages, removed from the later document by patience diff.

A line is known by the hash of its words. The shortest runs of lines that reach MIN_BLOCK_WORDS words, from
each line on and back from each line, are anchors: every shared passage that is long enough consists of
such runs. Each anchor pairs a document with the first document that has it. So the pairs grow with the lines, never with
the square of a run's holders, however many share it. The two documents' line hashes, all
of them, are then aligned by patience diff, and aligned common blocks go from the later one. What that
leaves, as its lines occur more than once or stand in another order, is matched exactly by the same runs.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import text
from folioflow.llm.scratch import saved

#: Smaller blocks stay: they agree by chance.
MIN_BLOCK_WORDS = 10


def line_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line with a word: row, number within the row (blank ones count), key, words; and lines of each row."""
    w = text.words(raw, at, text.SPACE)
    hashed = text.hashes(raw, w.start, w.end, False)
    breaks = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    number = breaks[w.start] - breaks[at[w.row]]
    new = np.ones(len(hashed), bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(hashed)]]))
    place = np.arange(len(hashed)) - np.repeat(first, count)
    key = np.add.reduceat(text.mix(hashed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first) if len(first) else np.zeros(0, np.uint64)
    return w.row[first], number[first], text.mix(key + count.astype(np.uint64)), count, breaks[at[1:]] - breaks[at[:-1]] + (at[1:] > at[:-1])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text.flat(batch.column("text"))
        for i, j in text.chunks(at):
            row, number, key, count, n = line_spans(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            cut = np.searchsorted(row, np.arange(j - i + 1)).tolist()
            packed = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)] for x in (key, number.astype(np.int32), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "n_lines", "keys", "numbers", "words"])


def runs(keys: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first line, line after the last and joint key of the shortest runs of MIN_BLOCK_WORDS words that begin or end at each line.

    Document k has lines at[k] to at[k + 1].
    """
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    line = np.arange(len(keys))
    doc = np.searchsorted(at, line, "right") - 1
    end = np.searchsorted(upto, upto[:-1] + MIN_BLOCK_WORDS)
    start = np.searchsorted(upto, upto[1:] - MIN_BLOCK_WORDS, "right") - 1
    on, back = end <= at[doc + 1], start >= at[doc]
    found = np.unique(np.concatenate([line[on] << 8 | (end - line)[on], start[back] << 8 | (line + 1 - start)[back]]))
    first, count = found >> 8, found & 255  # each line has a word, so a run has MIN_BLOCK_WORDS lines at most
    joint = np.zeros(len(found), np.uint64)
    for k in range(int(count.max(initial=0))):
        more = count > k
        joint[more] = text.mix(joint[more] + keys.view(np.uint64)[first[more] + k] + np.uint64(k + 1))
    return doc[first], first, first + count, text.mix(joint + count.astype(np.uint64)).view(np.int64)


def _joined(values: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind), np.concatenate([[0], np.cumsum([len(v) // size for v in values], dtype=np.int64)])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, at = _joined(batch.column("keys").to_pylist(), np.int64)
        row, _, _, key = runs(keys, _joined(batch.column("words").to_pylist(), np.int32)[0], at)
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row)), pa.array(key)], ["doc", "key"])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b) of equal lines: common ends, then unique common lines in longest common order, again between them."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        common = [(where[x], j) for j, x in enumerate(b[b0:b1], b0) if x in where]
        if not common:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(common)
        for k, (i, _) in enumerate(common):
            n = bisect.bisect_left(tails, i)
            back[k] = ends[n - 1] if n else -1
            tails[n : n + 1], ends[n : n + 1] = [i], [k]
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        chain.reverse()
        # each anchor begins a piece, whose common beginning it then is
        starts = [(a0, b0), *chain]
        for (i, j), (i2, j2) in zip(starts, [*chain, (a1, b1)], strict=True):
            stack.append((i, i2, j, j2))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], words: list[int], least: int = MIN_BLOCK_WORDS) -> list[int]:
    """Indices in b of aligned runs that have at least `least` words."""
    out, run, last = [], [], None
    for i, j in [*pairs, (-1, -1)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= least:
                out += run
            run = []
        run.append(j)
        last = (i, j)
    return out


def common_runs(ka: np.ndarray, at_a: np.ndarray, kb: np.ndarray, words: np.ndarray, at_b: np.ndarray, words_a: np.ndarray) -> np.ndarray:
    """Whether each line of kb lies in a run of MIN_BLOCK_WORDS words that its counterpart has anywhere. Piece k of kb, from at_b[k] on, has piece k of ka as counterpart."""
    pair_a, _, _, key_a = runs(ka, words_a, at_a)
    pair_b, start, end, key_b = runs(kb, words, at_b)
    spread = lambda pair, key: text.mix(key.view(np.uint64) + text.mix(pair.astype(np.uint64) + np.uint64(1)))
    hit = np.isin(spread(pair_b, key_b), spread(pair_a, key_a))
    cover = np.zeros(len(kb) + 1, np.int64)
    np.add.at(cover, start[hit], 1)
    np.add.at(cover, end[hit], -1)
    return np.cumsum(cover)[:-1] > 0


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (ka, at_a), (kb, at_b) = (_joined(batch.column(c).to_pylist(), np.int64) for c in ("ka", "kb"))
        wa, wb, numbers = (_joined(batch.column(c).to_pylist(), np.int32)[0] for c in ("wa", "words", "numbers"))
        gone = common_runs(ka, at_a, kb, wb, at_b, wa)
        docs, owners, cut = [], [], []
        for k, (doc, owner) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("owner").to_pylist(), strict=True)):
            here = slice(at_b[k], at_b[k + 1])
            mine = gone[here]
            mine[blocks(patience(ka[at_a[k] : at_a[k + 1]].tolist(), kb[here].tolist()), wb[here].tolist())] = True
            if mine.any():
                docs.append(doc)
                owners.append(owner)
                cut.append(numbers[here][mine].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(owners, pa.int64()), pa.array(cut, pa.list_(pa.int32()))], ["doc", "owner", "cut"])


def shared_lines(docs: DataFrame) -> DataFrame:
    r"""One row a document: doc_id, n_lines, removed (numbers of the lines to delete, from 0), owners (ids of the earlier documents that hold them).

    Lines end at \n; a null or empty text has none, blank ones are never removed, and lines are equal if their words are,
    with case. The earlier document is that of the smaller id. A later copy loses everything that is long enough,
    wherever and however often it or the earlier document has it; what only one document repeats stays. Rows that repeat
    an id count as one document, with the lines of the row whose packed line hashes are greatest, whatever the order of rows, and each gets a row. Null ids are never changed. Extra columns are not read;
    an empty table gives an empty result.
    """
    lines = saved(docs.select("doc_id", "text").mapInArrow(_lines, "doc_id long, n_lines long, keys binary, numbers binary, words binary"))
    once = lines.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("keys", "numbers", "words")).alias("s")).select(F.col("doc_id").alias("doc"), "s.*")
    once = saved(once)
    anchors = saved(once.select("doc", "keys", "words").mapInArrow(_anchors, "doc long, key long"))
    held = anchors.groupBy("key").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("key", "owner")
    pairs = anchors.join(held, "key").where("owner < doc").select("owner", "doc").distinct()
    both = pairs.join(once.select("doc", F.col("keys").alias("kb"), "numbers", "words"), "doc")
    both = both.join(once.select(F.col("doc").alias("owner"), F.col("keys").alias("ka"), F.col("words").alias("wa")), "owner")
    cut = both.mapInArrow(_aligned, "doc long, owner long, cut array<int>")
    cut = cut.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("removed"), F.array_sort(F.collect_set("owner")).alias("owners"))
    out = lines.select("doc_id", "n_lines").join(cut.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("owners", F.array().cast("array<long>")).alias("owners"))


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """The documents with those lines deleted; all other lines keep their order, and all columns stay."""
    cut = "removed"
    while cut in docs.columns:
        cut += "_"
    found = shared_lines(docs).where(F.size("removed") > 0).groupBy("doc_id").agg(F.first("removed").alias(cut))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(cut), i))
    out = docs.join(found, "doc_id", "left")
    return out.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
