"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Rows with equal texts are an indivisible group. Groups larger than a bundle's
fair share stand alone (there can be at most BUNDLES of them); all others are
put into BUNDLES hash bundles. So whatever the corpus size, one small task
differences at most twice BUNDLES numbers: it repeatedly combines the two partial
partitions of largest spread, one in ascending and one in descending order. The
result is small enough to broadcast, and rows find their shard without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.scratch import place, saved

BUNDLES = 8192
#: Rows numbered in one task.
NUMBERED = 20_000


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size."""
    if not sizes:
        return []
    sums: dict[int, list[int]] = {}
    parts: dict[int, tuple[int, int, list[int]]] = {}
    heap = []
    for i, s in enumerate(sizes):
        sums[i] = [s] + [0] * (shards - 1)
        heap.append((-s, i))
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        down = sums.pop(a)  # descending
        up = sums.pop(b)[::-1]
        total = [x + y for x, y in zip(down, up, strict=True)]
        order = sorted(range(shards), key=lambda k: -total[k])
        least = total[order[-1]]
        sums[new] = [total[k] - least for k in order]
        parts[new] = (a, b, order)
        heapq.heappush(heap, (-sums[new][0], new))
        new += 1
    shard_of = [0] * len(sizes)
    stack = [(heap[0][1], list(range(shards)))]
    while stack:  # the place of each of a part's subsets in the final order
        node, place = stack.pop()
        if node < len(sizes):
            shard_of[node] = place[0]
            continue
        a, b, order = parts[node]
        of = [0] * shards
        for k, subset in enumerate(order):
            of[subset] = place[k]
        stack += [(a, of), (b, of[::-1])]
    return shard_of


def _plan(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"unit": [], "size": []}), *batches], ignore_index=True).sort_values("unit", ignore_index=True)
        found = differencing(got["size"].astype("int64").tolist(), shards)
        yield pd.DataFrame({"unit": got["unit"].astype(str), "shard": pd.Series(found, dtype="int32")})

    return run


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _bundle(key: Column) -> Column:
    return F.concat(F.lit("bundle "), F.pmod(F.xxhash64(key), F.lit(BUNDLES)).cast("string"))


def plan(sized: DataFrame, shards: int) -> DataFrame:
    """(unit, shard) of rows (key, size): a unit is a key of its own or a bundle."""
    groups = saved(sized.groupBy("key").agg(F.sum("size").alias("size")))
    fair = F.lit((groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n) / BUNDLES)
    units = groups.select(F.when(F.col("size") > fair, F.col("key")).otherwise(_bundle(F.col("key"))).alias("unit"), "size")
    units = units.groupBy("unit").agg(F.sum("size").alias("size"))
    return saved(units.coalesce(1).mapInPandas(_plan(shards), "unit string, shard int"))


def _shards(df: DataFrame, shards: int) -> DataFrame:
    """df (key, size, ...) with its shard."""
    found = plan(df.select("key", "size"), shards)
    own = F.broadcast(found.where(~F.col("unit").startswith("bundle ")).select(F.col("unit").alias("key"), F.col("shard").alias("own")))
    bundles = F.broadcast(found.where(F.col("unit").startswith("bundle ")).select(F.col("unit").alias("bundle"), F.col("shard").alias("common")))
    df = df.join(own, "key", "left").withColumn("bundle", _bundle(F.col("key"))).join(bundles, "bundle", "left")
    return df.withColumn("shard", F.coalesce("own", "common")).drop("own", "common", "bundle")


def numbered(df: DataFrame, group: str, order: list[str], name: str, task: Column | None = None) -> DataFrame:
    """df with `name`, the row's place in its group from 0, counted over many tasks: by task, which bounds the rows that are sorted at once, then by order.

    Without a task rows are dealt by hashes of their order, and places follow no order as a whole.
    """
    if task is None:
        tasks = max(1, -(-df.count() // NUMBERED))
        task = F.pmod(F.xxhash64(*order), F.lit(tasks))
    df = df.withColumn("__task", task)
    counts = df.groupBy(group, "__task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    nth = F.row_number().over(Window.partitionBy(group, "__task").orderBy(*order)) - 1
    return df.withColumn(name, nth).join(counts, [group, "__task"]).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__task", "__before")


def sharded(docs: DataFrame, shards: int = 16, in_order: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; equal texts share a shard.

    size is the UTF-8 bytes of the text plus 1; a null text counts as an empty one, and shares its group. A
    group that is larger than a fair shard makes its shard the largest. slot numbers a shard's rows from 0 without gaps,
    in no meaningful order, or in_order: as the rows follow each other in docs (scratch.place). Repeated rows each have a slot. Empty tables give empty results; extra columns are not read.
    """
    t = F.coalesce("text", F.lit(""))
    at = [c.alias(name) for c, name in zip(place(docs), ("part", "at"), strict=True)] if in_order else []
    slim = docs.select("doc_id", F.md5(t).alias("key"), size_of(F.col("text")).alias("size"), F.crc32(t).alias("text_crc32"), *at)
    out = saved(_shards(saved(slim), shards))
    if in_order:
        out = numbered(out, "shard", ["at"], "slot", F.struct("part", F.floor(F.col("at") / NUMBERED).alias("chunk")))
    else:
        out = numbered(out, "shard", ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
