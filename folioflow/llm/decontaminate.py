"""Benchmark passages in training texts, by a generalised suffix automaton.

The automaton accepts every run of words of every item. Reading a document's
words through it gives, at each word, the longest run ending there that some
item has. Only stretches whose neighbouring words also stand together in an
item are read that way; a vectorised look-up of word pairs finds them, and it
can lose none. Automata are broadcast in blocks of at most BLOCK_WORDS item words, one block a pass. Between passes texts
and findings go to the shared folder, so the driver and a worker hold one automaton at a time, however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import text
from folioflow.llm.scratch import saved

WINDOW, BLOCK_WORDS = 10, 200_000
FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<long>"


class Automaton:
    """Suffix automaton of items, each a list of word hashes; windows are of `window` words, or a whole shorter item."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            state = 0
            for n, word in enumerate(words, 1):
                state = self.next[state][word]
                if n >= window:
                    self.items.setdefault(self.at_length(state, window), set()).add(item)
            if len(words) < window:
                self.short.setdefault(self.at_length(state, len(words)), []).append((len(words), item))
        self.least = min([window, *(len(w) for _, w in items)])
        self.words = np.unique(np.array([w for _, x in items for w in x], np.uint64))
        code = {w: k for k, w in enumerate(self.words.tolist())}
        self.pairs = np.unique(np.array([code[a] * len(code) + code[b] for _, x in items for a, b in zip(x, x[1:], strict=False)], np.int64))

    def _extend(self, last: int, word: int) -> int:
        follow = self.next[last].get(word)
        if follow is not None:
            return follow if self.length[follow] == self.length[last] + 1 else self._split(last, word, follow)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(-1)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def at_length(self, state: int, n: int) -> int:
        """The state of the last n words of what the state stands for."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stretches(self, hashed: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that can hold a window: all others have a pair that no item has."""
        if not len(hashed) or not len(self.words):
            return []
        code = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        known = self.words[code] == hashed
        if self.least == 1 or not len(self.pairs):
            joined = known[:-1] & known[1:] & (row[:-1] == row[1:])
        else:
            pair = code[:-1] * len(self.words) + code[1:]
            both = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
            at = np.minimum(np.searchsorted(self.pairs, pair[both]), len(self.pairs) - 1)
            joined = np.zeros(len(hashed) - 1, bool)
            joined[both[self.pairs[at] == pair[both]]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2] + 1
        fits = end - begin >= self.least
        out = list(zip(begin[fits].tolist(), end[fits].tolist(), strict=True))
        if self.least == 1:
            inside = np.zeros(len(hashed), bool)
            for a, b in out:
                inside[a:b] = True
            out += [(i, i + 1) for i in np.flatnonzero(known & ~inside).tolist()]
        return out

    def read(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, n, items): the n words before end lie in occurrences of windows of these items."""
        state = n = 0
        for end, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state = self.next[state].get(word, 0)
            n = n + 1 if state else 0
            if n >= self.window:
                yield end, n, self.items[self.at_length(state, self.window)]
            s, most = state, n
            while s > 0 and self.short:
                for size, item in self.short.get(s, ()):
                    if size <= most:
                        yield end, size, {item}
                s = self.link[s]
                most = self.length[s]


def _scan(shared, keep_text: bool):
    """Adds an automaton's findings to each row: (rest..., text, n_words, n_hit, spans, items) -> the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            raw, at = text.flat(batch.column("text"))
            n_words, n_hit, spans, items = [], [], [], []
            again = "spans" in batch.schema.names
            for i, j in text.chunks(at):
                part, bounds = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                w = text.words(part, bounds, text.PUNCT)
                hashed = text.hashes(part, w.start, w.end, True)
                hit = np.zeros(len(hashed) + 1, np.int32)
                found: dict[int, set[int]] = {}
                for a, b in automaton.stretches(hashed, w.row):
                    for end, n, some in automaton.read(hashed[a:b].tolist()):
                        hit[a + end - n] += 1
                        hit[a + end] -= 1
                        found.setdefault(int(w.row[a]), set()).update(some)
                if again:
                    for r in range(j - i):
                        for s in batch.column("spans")[i + r].as_py():
                            hit[w.first[r] + s["start"]] += 1
                            hit[w.first[r] + s["end"]] -= 1
                        if more := batch.column("items")[i + r].as_py():
                            found.setdefault(r, set()).update(more)
                inside = np.cumsum(hit)[:-1] > 0
                edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
                row_edge = np.zeros(len(hashed) + 1, bool)
                row_edge[w.first] = True
                begin = np.flatnonzero((edge[:-1] == 1) | (row_edge[:-1] & inside))
                stop = np.flatnonzero((edge[1:] == -1) | (row_edge[1:] & inside)) + 1
                own = [[] for _ in range(j - i)]
                for b, e in zip(begin.tolist(), stop.tolist(), strict=True):
                    r = int(w.row[b])
                    own[r].append({"start": b - int(w.first[r]), "end": e - int(w.first[r])})
                sums = np.concatenate([[0], np.cumsum(inside)])
                n_words += np.diff(w.first).tolist()
                n_hit += (sums[w.first[1:]] - sums[w.first[:-1]]).tolist()
                spans += own
                items += [sorted(found.get(r, ())) for r in range(j - i)]
            names = [n for n in batch.schema.names if n not in ("n_words", "n_hit", "spans", "items") and (keep_text or n != "text")]
            span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.int64()))], [*names, "n_words", "n_hit", "spans", "items"])

    return run


def item_words(values: list[str | None]) -> list[list[int]]:
    """Word hashes of item texts."""
    raw, at = text.flat(pa.array(values, pa.string()))
    w = text.words(raw, at, text.PUNCT)
    hashed = text.hashes(raw, w.start, w.end, True).tolist()
    return [hashed[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def automata(benchmark: DataFrame, window: int = WINDOW) -> Iterator[tuple[Automaton, bool]]:
    """Automata of blocks of the items (item_id, text), of about BLOCK_WORDS words each; and whether it is the last."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // (2 * BLOCK_WORDS)))  # a word and its separator take two bytes at least
    items = benchmark.where("item_id is not null").select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))
    if blocks > 1:  # sorted, so that reading a block skips the others
        items = saved(items.repartitionByRange("block").sortWithinPartitions("block"))
    for k in range(blocks):
        rows = items.where(F.col("block") == k).select("item_id", "text").collect()
        yield Automaton([(r.item_id, w) for r, w in zip(rows, item_words([r.text for r in rows]), strict=True)], window), k + 1 == blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, n_words, n_hit, spans (word ranges, end exclusive) and items (ids, ascending).

    A word is hit if it lies inside an occurrence of `window` consecutive words of an item, or of a whole item
    of fewer words. Null or empty texts and items have no words; an empty benchmark hits nothing; items without an
    id are not used, repeated ones count once by id; repeated documents each keep a row. Extra columns are not read.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *keep).schema)
    return _scanned(docs.select("doc_id", *keep, "text"), benchmark, window, schema, False)


def _scanned(out: DataFrame, benchmark: DataFrame, window: int, schema: str, keep_text: bool) -> DataFrame:
    """Rows (of schema, and text) with the findings of all automata, one a pass."""
    for automaton, last in automata(benchmark, window):
        shared = out.sparkSession.sparkContext.broadcast(automaton)
        held = keep_text or not last
        out = out.mapInArrow(_scan(shared, held), f"{schema}{', text string' * held}, {FOUND}")
        if not last:
            out = saved(out)
            shared.destroy()
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans."""
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        hit = np.asarray(batch.column("n_hit")) > 0
        new = []
        for r in np.flatnonzero(hit).tolist():
            raw, at = text.flat(texts.slice(r, 1))
            w = text.words(raw, at, text.PUNCT)
            kept, last = [], 0
            for s in spans[r].as_py():
                kept.append(raw[last : w.start[s["start"]]].tobytes())
                last = int(w.end[s["end"] - 1])
            new.append(b"".join([*kept, raw[last:].tobytes()]).decode())
        if new:
            texts = pc.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type))
        names = [n for n in batch.schema.names if n not in ("n_words", "n_hit", "spans", "items")]
        yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in names], names)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5) -> DataFrame:
    """The documents without the passages found; those with a larger share of hit words than most_coverage go.

    All columns are kept, whatever their names; n_chars (where there is one) is counted anew; null texts stay null.
    """
    rest = [c for c in docs.columns if c != "text"]
    out = docs.select(F.struct(*rest).alias("rest"), "text")
    rest_schema = f"rest {out.schema['rest'].dataType.simpleString()}"
    schema = f"{rest_schema}, text string"
    out = _scanned(out, benchmark, window, rest_schema, True)
    out = out.where(F.col("n_hit") <= most_coverage * F.col("n_words")).mapInArrow(_cut, schema).select("rest.*", "text")
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
