"""Toxic texts by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

Features say whether an n-gram of characters occurs within a word and its borders. Each is scaled by the
log ratio of its rates in toxic and other texts of the training rows; a regularised logistic regression is fitted to those.
Both classes of training rows are bounded by TRAINING each, taken by a hash of the id, so the fit takes the same
time at every corpus size. Whole texts are scored in one vectorised pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import text
from folioflow.llm.scratch import saved

GRAMS = (3, 4, 5, 6, 7)
BITS = 20
#: Training rows of each class, and features, at most.
TRAINING, FEATURES = 6000, 2048
SMOOTHING, L2, STEPS = 1.0, 1e-4, 400
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[0xC0:0xDF] += 32
_LOWER[0xD7] = 0xD7
_LOWER[[c for c in range(0x80) if not chr(c).isalnum()]] = 32


@dataclass
class Model:
    slots: np.ndarray  # hash slots of the features, ascending
    weights: np.ndarray
    bias: float


def grams(raw: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct n-grams of each row; only those whose slot is flagged in wanted, if given."""
    lead = text.LEADS[raw]
    begin = np.concatenate([[0], np.cumsum(lead)])[at] + np.arange(len(at))  # a border follows each row
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.full(len(points) + len(at), 32, np.uint32)  # and one precedes the first
    row = np.repeat(np.arange(len(at) - 1), np.diff(begin) - 1)
    chars[1 + np.arange(len(points)) + row] = np.where(points < 256, _LOWER[np.minimum(points, 255)], points)
    border = chars == 32
    borders = np.concatenate([[0], np.cumsum(border)])
    owner = np.full(len(chars), max(len(at) - 2, 0))
    owner[1 : 1 + len(points) + len(at) - 1] = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    owner[0] = 0
    value = chars.astype(np.uint64)
    found = []
    hashed = value.copy()
    for n in range(2, GRAMS[-1] + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * np.uint64(0x100000001B3) + value[n - 1 :]
        if n not in GRAMS:
            continue
        slot = ((hashed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        fits = borders[n - 1 : n - 1 + m] == borders[1 : 1 + m]  # no border inside
        if wanted is not None:
            fits &= wanted[slot]
        pick = np.flatnonzero(fits)
        # the last character of a gram is in its row, or the border after it
        found.append((owner[np.minimum(pick + 1, len(chars) - 1)].astype(np.int64) << BITS) | slot[pick].astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        raw, at = text.flat(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j in text.chunks(at):
            row, slot = grams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            for k in (0, 1):
                counts[k] += np.bincount(slot[toxic[i:j][row] == k], minlength=1 << BITS).astype(np.int32)
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[1][used]), pa.array(counts[0][used])], ["slot", "pos", "neg"])


def _flags(slots: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[slots] = True
    return out


def _present(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        flags = _flags(slots)
        for batch in batches:
            raw, at = text.flat(batch.column("text"))
            for i, j in text.chunks(at):
                row, slot = grams(raw[at[i] : at[j]], at[i : j + 1] - at[i], flags)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                place = np.searchsorted(slots, slot).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array([place[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["toxic", "present"])

    return run


def _fit(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient descent over sparse rows: the features that each has, at their scale; and the bias."""
    size = np.array([len(r) for r in rows], int)
    feature = np.concatenate([*rows, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(rows)), size)
    weight = weight / weight.sum()
    n = len(scale)
    ahead_of = lambda w: np.bincount(row, (w[:n] * scale)[feature], len(rows)) + w[n]
    back_of = lambda v: np.append(np.bincount(feature, v[row], n) * scale, v.sum())
    v = np.ones(n + 1)
    for _ in range(20):  # largest curvature
        v = back_of(weight * ahead_of(v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * float(v @ back_of(weight * ahead_of(v))) + L2)
    w, ahead, t = np.zeros(n + 1), np.zeros(n + 1), 1.0
    shrink = np.full(n + 1, L2)
    shrink[n] = 0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(ahead_of(ahead), -30, 30)))
        step = ahead - rate * (back_of(weight * (p - y)) + shrink * ahead)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = step + (t - 1) / t2 * (step - w), step, t2
    return w[:n], float(w[n])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to labels (doc_id, toxic) of rows that aren't held out. Without both classes, or documents of both, the model gives everything their rate."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = saved(known)
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    p = min(max(share, 1e-6), 1 - 1e-6)
    rate_alone = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    if not 0 < share < 1:
        return rate_alone
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING) for k in (0, 1)]
    chosen = F.broadcast(saved(some[0].union(some[1])))  # 2 * TRAINING rows at most
    rows = saved(docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text"))
    counts = rows.mapInArrow(_frequencies, "slot long, pos int, neg int").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return rate_alone
    rate = lambda c, n: (F.col(c) + SMOOTHING) / (n + 2 * SMOOTHING)
    ratio = F.log(rate("pos", pos) / rate("neg", neg))
    # how much the feature tells about the class: difference of rates times log ratio
    scored = counts.withColumn("r", ratio).withColumn("gain", (rate("pos", pos) - rate("neg", neg)) * F.col("r"))
    best = sorted((r.slot, r.r) for r in scored.orderBy(F.desc("gain"), "slot").limit(FEATURES).collect())
    slots, ratios = np.array([s for s, _ in best], np.int64), np.array([r for _, r in best])
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    sample = rows.mapInArrow(_present(shared), "toxic int, present binary").collect()
    y = np.array([r.toxic for r in sample], float)
    natural = np.where(y == 1, total[1] / max(1, pos), total[0] / max(1, neg))
    w, bias = _fit([np.frombuffer(r.present, np.int32) for r in sample], ratios, y, natural)
    return Model(slots, w * ratios, bias)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        flags = _flags(model.slots)
        for batch in batches:
            raw, at = text.flat(batch.column("text"))
            out = np.full(batch.num_rows, model.bias)
            for i, j in text.chunks(at) if len(model.slots) else ():
                row, slot = grams(raw[at[i] : at[j]], at[i : j + 1] - at[i], flags)
                out[i:j] += np.bincount(row, model.weights[np.searchsorted(model.slots, slot)], j - i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5) of every whole text.

    Nothing but the text enters a score. Null and empty texts have no n-gram and get the score of the bias; repeated
    rows get equal scores; extra columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
