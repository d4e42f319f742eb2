"""Mixtures of sources to target weights by Pfair scheduling.

Each source is a task of weight w. Its block j (from 1) is released at slot
floor((j - 1) / w) and due at slot ceil(j / w); in every slot the released block
of the earliest deadline is taken. After any number of slots a source is less
than one block away from its share. Weights are exact fractions and windows
follow from block numbers, so nothing drifts however long the mixture is. One
task works the schedule out, a row a block, and rows find their block's slot by a join.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.scratch import saved
from folioflow.llm.sharding import size_of

#: Bytes of a block at least, and blocks of a schedule at most: beyond 256 GiB blocks grow instead of the one task that plans them.
BLOCK_BYTES, MOST_BLOCKS = 1 << 16, 1 << 22
#: Rows of all sources whose places are summed in one task, on average; of one source, its share of them.
NUMBERED = 4096
#: Blocks of a schedule in an Arrow batch.
PLANNED = 1 << 14
#: No source makes up more than this share of the mixture, unless all do.
MOST_SHARE = 0.25
#: The block number of the row of a plan that says how many bytes of a source are scheduled.
END = -1


def parts(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The same weights as whole numbers, exactly."""
    exact = {k: Fraction(v) for k, v in weights.items()}
    bottom = math.lcm(*(v.denominator for v in exact.values()))
    return {k: int(v * bottom) for k, v in exact.items()}


def slots(shares: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int]]:
    """(source, block from 0, slot) of so many blocks of each source, by earliest deadline; slots in which no block is released stay empty."""
    period, slot = sum(shares.values()), 0
    waiting = [(0, str(k), k, 1) for k in shares if blocks[k] > 0]  # release, name, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, str | None, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, name, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // shares[k]), name, k, j))
        _, name, k, j = heapq.heappop(ready)
        yield k, j - 1, slot
        if j < blocks[k]:
            heapq.heappush(waiting, (j * period // shares[k], name, k, j + 1))
        slot += 1


def schedule(shares: dict[str | None, int]) -> list[tuple[str | None, int, int]]:
    """One period."""
    return list(slots(shares, shares))


def at_top(largest: list[tuple[str | None, int]], total: int, most: Fraction) -> list[str | None]:
    """Sources that natural shares would put above `most`, after what is above has gone to the others; largest ones come first."""
    out: list[str | None] = []
    rest = total
    for source, size in largest:
        if size * (1 - most * len(out)) <= most * rest:
            break
        out.append(source)
        rest -= size
    return out


def capped(sizes: dict[str | None, int], top: list[str | None], most: Fraction) -> dict[str | None, int]:
    """Shares as whole numbers: `most` for each source at the top, the rest to the others in proportion to their sizes."""
    rest = sum(v for k, v in sizes.items() if k not in top)
    return {k: most.numerator * rest if k in top else v * (most.denominator - most.numerator * len(top)) for k, v in sizes.items()}


def _planned(weights: dict[str | None, float] | None, top: list[str | None], most: Fraction, block_bytes: int):
    """(s, j, slot) of every block, from rows (source, bytes); and (s, END, bytes scheduled) of every source that has weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[str | None, int] = {}
        for batch in batches:
            sizes.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if weights is None:
            shares = capped(sizes, top, most)
        else:
            shares = parts({k: w for k, w in weights.items() if w > 0 and k in sizes})
        horizon = min((Fraction(sizes[k], n) for k, n in shares.items()), default=Fraction(0))  # bytes of the mixture for a part of weight
        ends = ((k, END, math.ceil(horizon * n)) for k, n in shares.items())
        # a row begins before the source's end, so no block does after it
        rows = itertools.chain(ends, slots(shares, {k: -(-sizes[k] // block_bytes) for k in shares}))
        while part := list(itertools.islice(rows, PLANNED)):
            source, block, slot = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(slot, pa.int64())], ["s", "j", "slot"])

    return run


def mixture(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int | None = None, most: float = MOST_SHARE) -> DataFrame:
    """doc_id, source, block, slot and scheduled of each row.

    A source's rows, in an order that depends on doc_id alone, fill blocks of block_bytes (BLOCK_BYTES, or as many as keep the
    schedule within MOST_BLOCKS, unless given). Sorted by slot they are the
    mixture, in which each source keeps to its weight within a block until it ends. scheduled is true up to the
    point at which the first source ends, and false for rows beyond it: they are the surplus of sources that have
    more than their weight. Without weights, natural shares hold, none above `most`; sources whose
    weight is missing or 0 are never scheduled and have no slot. Any number of sources is possible: the task that works the schedule
    out holds one entry for each. A null source is a source; a null text has one byte, the separator
    that every row counts; rows that repeat an id come in an arbitrary order; an empty table gives an empty result.
    """
    slim = saved(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64(F.coalesce("doc_id", F.lit(-1))).alias("h")))
    tasks = max(1, -(-slim.count() // NUMBERED))
    slim = slim.withColumn("task", F.floor(F.col("h") / (2.0**64 / tasks)))  # in the order of h
    cells = saved(slim.groupBy("source", "task").agg(F.sum("size").alias("bytes")))
    sizes = saved(cells.groupBy("source").agg(F.sum("bytes").alias("bytes")))
    all_ = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    block_bytes = block_bytes or max(BLOCK_BYTES, -(-all_.bytes // MOST_BLOCKS))
    share = max(Fraction(most).limit_denominator(1000), Fraction(1, max(1, all_.n)))
    largest = [(r.source, r.bytes) for r in sizes.orderBy(F.desc("bytes"), "source").limit(int(1 / share) + 1).collect()] if weights is None and share * max(1, all_.n) > 1 else []
    plan = saved(sizes.coalesce(1).mapInArrow(_planned(weights, at_top(largest, all_.bytes, share), share, block_bytes), "s string, j long, slot long"))
    ends = plan.where(F.col("j") == END).select(F.col("s").alias("e"), F.col("slot").alias("end"))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    cells = cells.join(ends, F.col("source").eqNullSafe(F.col("e")), "left").select(F.col("source").alias("s"), F.col("task").alias("t"), "before", "end")
    inside = Window.partitionBy("source", "task").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = slim.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t"))).drop("s", "t")
    out = out.withColumn("first", F.col("at") + F.col("before")).drop("at")
    out = out.withColumn("block", F.floor(F.col("first") / block_bytes))
    out = out.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("j")), "left")
    return out.select("doc_id", "source", "block", "slot", F.coalesce(F.col("first") < F.col("end"), F.lit(False)).alias("scheduled"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int | None = None) -> DataFrame:
    """Documents, whole and in the order of their slots, by ranges of slots over the output's files.

    Without weights every row stays: natural shares hold, so all sources end together, and rows without an id come last.
    Weights that are given cut to the scheduled documents, and rows without an id go.
    """
    slot = "slot"
    while slot in docs.columns:
        slot += "_"
    whole = weights is None
    plan = mixture(docs, weights, block_bytes, 1.0)
    plan = plan.where(F.lit(whole) | F.col("scheduled")).groupBy("doc_id").agg(F.min("slot").alias(slot))
    out = docs.join(plan, "doc_id", "left" if whole else "inner").withColumn(slot, F.coalesce(slot, F.lit((1 << 63) - 1)))
    return out.repartitionByRange(slot, "doc_id").sortWithinPartitions(slot, "doc_id").select(*docs.columns)
