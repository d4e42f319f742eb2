"""Token counts of whole texts by a two-tier, map-side lookup.

Pieces of the vocabulary hold spaces only in front, so no merge crosses the
border before a run of spaces or beside a newline: a text's count is the sum of
its pre-tokens' counts. One pass over all texts finds frequent pre-tokens from
bounded summaries of each task; their lengths go out as one compact hash table.
The second pass looks all pre-tokens of a chunk up at once, and encodes those
the table misses through a bounded cache in each worker. No pre-token is
shuffled; texts with unusual spacing are cut by a regular expression instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import text

SPACE_OR_LINE = np.zeros(256, bool)
SPACE_OR_LINE[[0x20, 0x0A]] = True
#: Rows of the broadcast table, summary rows of a task, and entries a worker keeps.
TABLE, SUMMARY, CACHE = 1 << 17, 1 << 12, 1 << 18
_SEGMENT = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
_AFTER_LINE = np.uint64(0xA5A5A5A5A5A5A5A5)

_workers: dict[str, Counter] = {}


class Counter:
    """Counts tokens of pre-tokens with one loaded model."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        self.line = len(self.encode("\n"))  # the prefix's space and the newline
        self.per_line = len(self.encode("a\n")) - len(self.encode("a"))
        self.lengths: dict[int, int] = {}
        self.segments: dict[str, int] = {}

    @classmethod
    def of(cls, model: str) -> Counter:
        if model not in _workers:
            _workers[model] = cls(model)
        return _workers[model]

    def plain(self, words: list[str], after_line: list[bool]) -> list[int]:
        """Tokens of words after one space (or at the text's beginning), or after a newline."""
        found = self.encode(["\n" + w if a else w for w, a in zip(words, after_line, strict=True)], num_threads=1)
        return [len(x) - self.line * a for x, a in zip(found, after_line, strict=True)]

    def whole(self, value: str) -> int:
        """Tokens of a text, segment by segment."""
        if not value:
            return 0
        total = 0
        for s in _SEGMENT.findall("▁" + value.replace(" ", "▁")):
            n = self.segments.get(s)
            if n is None:
                if len(self.segments) >= CACHE:
                    self.segments.clear()
                n = len(self.encode(s[1:])) if s[0] == "▁" and len(s) > 1 else len(self.encode("\n" + s)) - self.line
                self.segments[s] = n
            total += n
        return total


def _pretokens(raw: np.ndarray, at: np.ndarray) -> tuple[text.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words between spaces and newlines, which follow a newline, their keys, and rows whose spacing needs the slow way."""
    w = text.words(raw, at, SPACE_OR_LINE)
    before = np.where(w.start > 0, raw[np.maximum(w.start - 1, 0)], 0)
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[at] = True
    after_line = (before == 0x0A) & ~fresh[w.start]
    keys = text.hashes(raw, w.start, w.end, False) ^ np.where(after_line, _AFTER_LINE, np.uint64(0))
    separator = SPACE_OR_LINE[raw]
    n = len(raw)
    odd = np.zeros(n, bool)
    if n:
        before_is = np.concatenate([[True], separator[:-1]]) | fresh[:-1]
        after_is = np.concatenate([separator[1:], [True]]) | fresh[1:]
        odd = (raw == 0x20) & (before_is | after_is) | (raw == 0x0A) & fresh[:-1]
    total = np.concatenate([[0], np.cumsum(odd)])
    return w, after_line, keys, np.flatnonzero(total[at[1:]] > total[at[:-1]])


def _column(batch: pa.RecordBatch) -> pa.Array:
    column = batch.column("text")
    return pc.replace_substring(column, "▁", " ")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, list] = {}
    for batch in batches:
        raw, at = text.flat(_column(batch))
        for i, j in text.chunks(at):
            part, bounds = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            w, line, keys, _ = _pretokens(part, bounds)
            found, where, n = np.unique(keys, return_index=True, return_counts=True)
            for f, p, c in zip(found[n > 1].tolist(), where[n > 1].tolist(), n[n > 1].tolist(), strict=True):
                have = count.get(f)
                if have:
                    have[1] += c
                else:
                    count[f] = [bool(line[p]), c, part[w.start[p] : w.end[p]].tobytes().decode()]
            if len(count) > 16 * SUMMARY:
                count = dict(sorted(count.items(), key=lambda x: -x[1][1])[: 4 * SUMMARY])
    top = sorted(count.items(), key=lambda x: -x[1][1])[:SUMMARY]
    keys = np.array([k for k, _ in top], np.uint64).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([v[0] for _, v in top], pa.bool_()), pa.array([v[2] for _, v in top], pa.string()), pa.array([v[1] for _, v in top], pa.int64())], ["key", "after_line", "word", "n"])


def frequent(docs: DataFrame) -> DataFrame:
    """The TABLE most frequent pre-tokens by the tasks' bounded summaries: key, after_line, word, n."""
    rows = docs.select("text").mapInArrow(_summary, "key long, after_line boolean, word string, n long")
    rows = rows.groupBy("key").agg(F.min("after_line").alias("after_line"), F.min("word").alias("word"), F.sum("n").alias("n"))
    return rows.where(F.length("word") <= 64).orderBy(F.desc("n"), "key").limit(TABLE)


def table(keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing: slots of keys and lengths, and how many slots a search may need."""
    size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
    slots, values = np.zeros(size, np.uint64), np.zeros(size, np.uint16)
    left, step = np.arange(len(keys)), 0
    while len(left):
        at = ((keys[left] >> np.uint64(20)) + np.uint64(step)) % np.uint64(size)
        free = slots[at] == 0
        slots[at[free]] = keys[left][free]
        won = slots[at] == keys[left]
        values[at[won]] = lengths[left][won]
        left, step = left[~won], step + 1
    return slots, values, step


def look_up(tab: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """Length of each key, or -1."""
    slots, values, steps = tab
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    for step in range(steps):
        at = ((keys[left] >> np.uint64(20)) + np.uint64(step)) % np.uint64(len(slots))
        hit = slots[at] == keys[left]
        out[left[hit]] = values[at[hit]]
        left = left[~hit & (slots[at] != 0)]
        if not len(left):
            break
    return out


def _count(model: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, tab = Counter.of(model), shared.value
        for batch in batches:
            raw, at = text.flat(_column(batch))
            original = text.flat(batch.column("text"))[1]
            total = np.zeros(batch.num_rows, np.int64)
            for i, j in text.chunks(at):
                part, bounds = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                w, line, keys, odd = _pretokens(part, bounds)
                n = look_up(tab, keys)
                miss = np.flatnonzero(n < 0)
                if len(miss):
                    found, where, back = np.unique(keys[miss], return_index=True, return_inverse=True)
                    have = [counter.lengths.get(k, -1) for k in found.tolist()]
                    new = [x for x, v in enumerate(have) if v < 0]
                    at_word = miss[where[new]]
                    strings = [part[s:e].tobytes().decode() for s, e in zip(w.start[at_word].tolist(), w.end[at_word].tolist(), strict=True)]
                    if len(counter.lengths) + len(new) > CACHE:
                        counter.lengths.clear()
                    for x, v in zip(new, counter.plain(strings, line[at_word].tolist()), strict=True):
                        have[x] = v
                        if len(counter.lengths) < CACHE:
                            counter.lengths[int(found[x])] = v
                    n[miss] = np.array(have, np.int64)[back]
                sums = np.concatenate([[0], np.cumsum(n)])
                lines = np.concatenate([[0], np.cumsum(part == 0x0A)])
                total[i:j] = sums[w.first[1:]] - sums[w.first[:-1]] + counter.per_line * (lines[bounds[1:]] - lines[bounds[:-1]])
                for r in odd.tolist():
                    total[i + r] = counter.whole(part[bounds[r] : bounds[r + 1]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(original)), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    Counts are those of the model's library without begin, end or added tokens. A null text counts as
    empty: 0 bytes and 0 tokens. Ids, repeated or null, pass as they are; extra columns are not read;
    an empty table gives an empty result. The model file must be at the same path on all machines.
    """
    rows = frequent(docs).collect()  # TABLE rows at most
    keys = np.array([r.key for r in rows], np.int64).astype(np.uint64)
    lengths = np.array(Counter.of(model).plain([r.word for r in rows], [r.after_line for r in rows]), np.int64)
    fits = (lengths < 1 << 16) & (keys != 0)
    shared = docs.sparkSession.sparkContext.broadcast(table(keys[fits], lengths[fits]))
    out = docs.select("doc_id", "text").mapInArrow(_count(model, shared), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
