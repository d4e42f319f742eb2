r"""Near-duplicate documents by SetSketch registers.

A register is the exponentially spaced, truncated minimum of one hash over a
document's shingles: a byte, mergeable by maximum, equal in two documents with
a probability that follows their Jaccard similarity. Six registers make a band;
documents that agree on a band share a bucket. The work then is

1. one Python pass over the texts: set size, digest of the set, registers;
2. one representative for each distinct set (copies are never paired);
3. in each bucket, one leader: the member whose buckets are fullest. Every other
   member keeps the leader to which the joint likelihood of both registers
   gives the highest similarity, so there is one pair a document at most;
4. those pairs are confirmed on full sets, and give first components;
5. in buckets whose members are still in several components, members outside the largest
   one are compared with all others on registers, in blocks. Members of different components that
   agree on LEAST_SAME registers are compared on full
   sets by an inverted index, and return the missing links only as a
   spanning forest. So a pair that shares a bucket is either connected or was
   compared, and no step emits the pairs of a group.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import text
from folioflow.llm.components import components
from folioflow.llm.scratch import saved

WORDS, PERCENT = 5, 85
BAND, BANDS = 6, 26
REGISTERS = BAND * BANDS
BASE, RATE = 1.2, 20.0
#: Five standard deviations of the estimate below the threshold.
LEAST_ESTIMATE = 0.70
#: Documents of a bucket that are compared at once, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 1 << 25
#: Registers on which two documents agree to be compared on full sets. At the threshold they agree on one with a probability of 0.862, so on fewer with one of 5e-9.
LEAST_SAME = 107
_seed = np.random.default_rng(88172645463325252)
_MUL = _seed.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seed.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(least: np.ndarray) -> np.ndarray:
    """Register values (bytes) of the least 64-bit hashes."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-50)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of sets of na and nb elements with registers a and b (rows)."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, found = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, 101):
        j = step * top
        more, less = p(u - v * j), p(v - u * j)
        log = above * np.log(more) + below * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))
        found, best = np.where(log > best, j, found), np.maximum(best, log)
    return found


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, its distinct shingle hashes in order of row and hash, and where each row's begin."""
    raw, at = text.flat(column)
    for i, j in text.chunks(at):
        part, bounds = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        w = text.words(part, bounds, text.SPACE)
        h, row = text.shingles(text.hashes(part, w.start, w.end, True), w.first, WORDS)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield i, j, h, np.searchsorted(row, np.arange(j - i + 1))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        ids = batch.column(0)
        for i, j, h, first in _sets(batch.column(1)):
            size = np.diff(first)
            full = np.flatnonzero(size)
            regs = np.zeros((j - i, REGISTERS), np.uint8)
            if len(full):
                least = np.empty((len(full), REGISTERS), np.uint64)
                for r in range(REGISTERS):
                    least[:, r] = np.minimum.reduceat(h * _MUL[r] + _ADD[r], first[:-1][full])
                regs[full] = registers(least)
            digests = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), registers (binary) of each document."""
    return docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, registers binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, BAND).astype(np.int64)
        key = np.broadcast_to(np.arange(BANDS), regs.shape[:2]).copy()
        for i in range(BAND):
            key = key * 256 + regs[:, :, i]
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids)], ["bucket", "doc"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        j = estimate(a, b, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("doc"), pa.array(j)], ["leader", "doc", "j"])


def _in_filter(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = (text.mix(ids.astype(np.uint64)) % np.uint64(len(bits) * 8)).astype(np.int64)
    return np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)


def _filtered_sets(wanted) -> object:
    """Set bytes of the documents whose id is in the filter (a superset of those wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            keep = _in_filter(batch.column(0).to_numpy(), bits)
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            for i, j, h, first in _sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], ["doc", "set"])

    return run


def _filtered(wanted) -> object:
    """Rows whose first column is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            yield batch.take(pa.array(_in_filter(batch.column(0).to_numpy(), bits)))

    return run


def _bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            slot = (text.mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(size * 8)).astype(np.int64)
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].astype(np.int64))], ["at", "bits"])

    return run


def _marked(ids: DataFrame, size: int):
    """A broadcast filter of size bytes that lets these ids (a column of longs) through, and few others while there are at most as many as it has bytes."""
    marks = ids.distinct().mapInArrow(_bits(size), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()  # size rows at most
    bits = np.zeros(size, np.uint8)
    for at, x in marks:
        bits[at] = x
    return ids.sparkSession.sparkContext.broadcast(bits.tobytes())


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(linked(both, len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("leader")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def linked(both: int, na: int, nb: int) -> bool:
    return 100 * both >= PERCENT * (na + nb - both)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of rows, which come sorted by keys, and where each group begins, the end last."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
        if held is None:
            return
        held = held.combine_chunks()
        columns = [held[k].to_numpy() for k in keys]
        begins = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1).tolist()]
        if batch is None:
            yield held, [*begins, held.num_rows]
        elif len(begins) > 1:
            yield held.slice(0, begins[-1]), begins
            held = held.slice(begins[-1])


GROUP = ["bucket", "i", "k"]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part in a pair of different components, of which one is foreign (not of the bucket's main component), alike in their registers.

    A pair is looked at only in the first band on which it agrees.
    """
    for table, begins in _whole_groups(batches, GROUP):
        regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        foreign, size, root, doc = (table[c].to_numpy() for c in ("foreign", "n_shingles", "root", "doc"))
        band = table["bucket"].to_numpy() >> (8 * BAND)
        used = np.zeros(len(doc), bool)
        for begin, end in zip(begins, begins[1:], strict=False):
            own = np.arange(begin, end)
            a, b = own[foreign[begin:end]], own[~foreign[begin:end]]
            step = max(1, (1 << 16) // max(1, len(b)))
            for at in range(0, len(a), step):
                some = a[at : at + step, None]
                fits = (root[some] != root[b]) & (100 * np.minimum(size[some], size[b]) >= PERCENT * np.maximum(size[some], size[b]))
                x, y = np.nonzero(fits)
                x, y = some[x, 0], b[y]
                same = regs[x] == regs[y]
                alike = (same.sum(1) >= LEAST_SAME) & ~same.reshape(-1, BANDS, BAND)[:, : band[begin]].all(2).any(1)
                used[x[alike]] = used[y[alike]] = True
        yield table.select([*GROUP, "doc", "root"]).filter(pa.array(used)).combine_chunks().to_batches()[0] if used.any() else pa.RecordBatch.from_pylist([], table.select([*GROUP, "doc", "root"]).schema)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join components among the rows of each block."""
    for table, begins in _whole_groups(batches, GROUP):
        doc, root = table["doc"].to_numpy(), table["root"].to_numpy()
        found: list[tuple[int, int]] = []
        for begin, end in zip(begins, begins[1:], strict=False):
            sets = [np.frombuffer(x, np.uint64) for x in table["set"].slice(begin, end - begin).to_pylist()]
            seen: dict[tuple[int, bytes], int] = {}
            for k, s in enumerate(sets):  # a row in both roles comes twice
                seen.setdefault((int(doc[begin + k]), s.tobytes()), k)
            kept = list(seen.values())
            found += joining([sets[k] for k in kept], [int(root[begin + k]) for k in kept])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def joining(sets: list[np.ndarray], comp: list[int]) -> list[tuple[int, int]]:
    """Pairs of components that linked sets join, as a forest: an inverted index gives every intersection."""
    size = np.array([len(x) for x in sets])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    main = Counter(comp).most_common(1)[0][0]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    term = np.zeros(len(flat), np.int64)
    term[order] = np.cumsum(np.concatenate([[0], (np.diff(flat[order]) != 0)]))
    begin = np.concatenate([[0], np.cumsum(np.bincount(term))])
    owners, first = owner[order], np.concatenate([[0], np.cumsum(size)])
    out = []
    for i, root in enumerate(comp):
        if root == main:
            continue
        mine = term[first[i] : first[i + 1]]
        both = np.bincount(np.concatenate([owners[begin[t] : begin[t + 1]] for t in mine.tolist()]), minlength=len(sets))
        for j in np.flatnonzero(100 * both >= PERCENT * (size[i] + size - both)).tolist():
            a, b = top(root), top(comp[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((root, comp[j]))
    return out


def _in_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _open_pairs(rooted: DataFrame) -> DataFrame:
    """(bucket, i, k, doc, root): rows to compare on full sets, by bucket, block i of foreign rows and block k of all its rows.

    Rows of the main component don't meet each other, so a bucket's rows are copied once for each block of foreign ones.
    """
    parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum(8 * F.col("n_shingles")).alias("bytes"))
    main = F.max_by("root", F.struct("n", (-F.col("root")).alias("r")))
    whole = parts.groupBy("bucket").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1))
    share = (F.col("n") - F.col("most")) / F.col("n")
    whole = whole.select("bucket", "main", blocks(F.col("n"), F.col("bytes")).alias("all"), blocks(share * F.col("n"), share * F.col("bytes")).alias("some"))
    rows = rooted.join(whole, "bucket").withColumn("h", F.xxhash64("doc"))
    at = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    kept = ["bucket", "doc", "root", "n_shingles", "registers"]
    foreign = rows.where("root <> main").select(*kept, F.lit(True).alias("foreign"), at("some").alias("i"), each("all").alias("k"))
    every = rows.select(*kept, F.lit(False).alias("foreign"), at("all").alias("k"), each("some").alias("i")).select(foreign.columns)
    return saved(_in_groups(foreign.union(every)).mapInArrow(_candidates, "bucket long, i int, k int, doc long, root long"))


def near_duplicates(docs: DataFrame, filter_bytes: int = 1 << 20) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of distinct 5-word shingles (A-Z lower-cased; a text of fewer words is one shingle)
    have 100 * intersection >= 85 * union are linked; component_id is the least doc_id reachable. Texts that
    are null or without a word have no shingle and stand alone. Rows that repeat a doc_id are one node with the links of all their texts. Two documents
    at the threshold miss each other in all 26 bands with a probability of 5e-6, and less above it.

    Empty tables give empty results; extra columns are not read. filter_bytes bounds the broadcast id filters: beyond what one
    can tell apart it only lets more sets through.
    """
    base = saved(sketches(docs))
    reps = base.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min_by(F.struct("n_shingles", "registers"), "doc_id").alias("s")).select("digest", "doc", "s.*")
    reps = saved(reps)
    bands = reps.select("doc", "registers").mapInArrow(_bands, "bucket long, doc long")
    full = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(bands.join(full, "bucket"))
    fame = members.groupBy("doc").agg(F.sum("n").alias("fame"))
    members = saved(members.join(fame, "doc"))
    lead = members.groupBy("bucket").agg((-F.max(F.struct("fame", (-F.col("doc")).alias("d")))["d"]).alias("leader"))
    pairs = members.join(lead, "bucket").where("leader <> doc").select("leader", "doc").distinct()
    slim = reps.select("doc", F.col("n_shingles").alias("n"), "registers")
    pairs = (
        pairs.join(slim.select("doc", F.col("n").alias("na"), F.col("registers").alias("ra")), "doc")
        .join(slim.select(F.col("doc").alias("leader"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "leader")
        .mapInArrow(_estimated, "leader long, doc long, j double")
        .where(F.col("j") >= LEAST_ESTIMATE)
        .groupBy("doc")
        .agg((-F.max(F.struct("j", (-F.col("leader")).alias("l")))["l"]).alias("leader"))
    )
    pairs = saved(pairs)
    # sets are moved only where a filter of the ids that a join needs lets them through; the joins are exact
    wanted = _marked(members.select("doc"), filter_bytes)
    sets = saved(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_filtered_sets(wanted), "doc long, set binary"))
    some = lambda ids: sets.mapInArrow(_filtered(_marked(ids, filter_bytes)), "doc long, set binary")
    first = (
        pairs.join(some(pairs.select("leader")).select(F.col("doc").alias("leader"), F.col("set").alias("sb")), "leader")
        .join(some(pairs.select("doc")).select("doc", F.col("set").alias("sa")), "doc")
        .mapInArrow(_confirmed, "a long, b long")
    )
    root = components(first)
    rooted = members.select("bucket", "doc").join(root.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    rooted = saved(rooted.join(open_, "bucket").join(reps.select("doc", "n_shingles", "registers"), "doc"))
    alike = _open_pairs(rooted)
    more = _in_groups(alike.join(some(alike.select("doc")), "doc")).mapInArrow(_block_links, "a long, b long")
    merged = components(more)
    final = root.join(merged.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left")
    # a node of the later components is a root of the first ones, so it has no row there
    final = final.select("node", F.coalesce("over", "root").alias("root")).union(merged.select("node", "root"))
    least = reps.select("digest", "doc").join(final, F.col("node") == F.col("doc"), "left").select("digest", F.coalesce("root", "doc").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "digest").join(least, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's; of rows that repeat an id, one stays. Rows without an id go."""
    keep = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
