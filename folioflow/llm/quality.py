"""Quality rules with thresholds that follow each language and source.

Features of every text come from one vectorised pass. Their distribution in
each (language, source) is kept as a quantile sketch of logarithmic buckets:
a count per bucket, so sketches merge by adding counts, first within tasks,
then across them, and up from source to language to corpus. A feature's limit is drawn from the
sketch alone: where a feature varies among all texts, the median plus a multiple of the spread of the lower half, which junk
cannot move until it is half of a source; where most texts have none of it (capitals in Chinese, say), from the upper quantile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import text
from folioflow.llm.scratch import saved

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
#: ASCII characters that print but are neither letters nor digits.
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Relative accuracy of a sketch's quantiles is half of this; values below TINY count as 0.
STEP, TINY = 0.02, 1e-4
#: Features as ratios of counts, and whether all texts vary in them (else most texts have none).
FEATURES: dict[str, tuple[str, str, bool]] = {
    "marks": ("n_marks", "word_chars", True),
    "upper": ("n_upper", "word_chars", True),
    "word_length": ("word_chars", "n_words", True),
    "dup_lines": ("n_dup_lines", "n_lines", False),
    "repeats": ("n_repeat_words", "n_words", False),
}
VARIED = [name for name, (_, _, varies) in FEATURES.items() if varies]
#: A limit is MID's quantile and SPREADS times its distance to LOW's; where that says nothing, TAILS times HIGH's distance from MID's above it.
MID, LOW, HIGH = 0.5, 0.1, 0.995
SPREADS, TAILS = 8.0, 2.0
#: A group whose texts are alike (copies, say) has at least this part of the distance that the next coarser group has, in features in which all texts vary.
LEAST_PART = 0.5
#: No limit of repeats reaches the base rule.
MOST_REPEATS = 0.98 * MAX_REPEAT_PERCENT / 100
#: A group of n texts weighs n / (n + PRIOR) in its limit, the next coarser group the rest.
PRIOR = 100


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text.flat(batch.column("text"))
        out = np.zeros((len(COUNTS), batch.num_rows), np.int64)
        for i, j in text.chunks(at):
            out[:, i:j] = _counts(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *map(pa.array, out)], [*rest, *COUNTS])


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _twice(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (row, value), and whether each in that order equals the one before."""
    order = np.lexsort((value, row))
    same = np.zeros(len(order), bool)
    same[1:] = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
    return order, same


def _counts(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    w = text.words(raw, at, text.SPACE)
    in_word = ~text.SPACE[raw]
    hashed = text.hashes(raw, w.start, w.end, False)
    win, first = text.windows(hashed, w.first, 3)
    order, same = _twice(w.row[first], win)
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(cover, first[order[twice]], 1)
    np.add.at(cover, first[order[twice]] + 3, -1)
    # lines end at newlines and at the row's end
    ends = np.zeros(len(raw) + 1, bool)
    ends[at[1:]] = True
    ends[:-1] |= raw == 0x0A
    end = np.flatnonzero(ends)
    start = np.concatenate([[0], end[:-1] + (raw[np.minimum(end[:-1], len(raw) - 1)] == 0x0A)]) if len(raw) else end[:0]
    end = end[: len(start)]
    start = np.minimum(start, end)
    row = np.searchsorted(at, start, "right") - 1
    words = np.concatenate([[0], np.cumsum(in_word)])
    full = words[end] > words[start]
    start, end, row = start[full], end[full], row[full]
    _, dup = _twice(row, text.hashes(raw, start, end, False))
    lines = np.bincount(row, minlength=len(at) - 1)
    dups = np.bincount(np.sort(row)[dup], minlength=len(at) - 1)
    return [
        np.diff(w.first),
        _per_row(in_word & text.LEADS[raw], at),
        _per_row(SYMBOLS[raw], at),
        dups,
        _per_row(np.cumsum(cover)[:-1] > 0, w.first),
        lines,
        _per_row(UPPER[raw], at),
        _per_row(MARKS[raw], at),
    ]


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each whole text: words, their characters, symbols, repeated lines, words in repeated 3-word windows."""
    rest = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return docs.select(*keep, "text").mapInArrow(_measure, f"{schema}, {', '.join(f'{c} long' for c in COUNTS)}")


def _ratio(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))


def _bucket(value: Column) -> Column:
    return F.when(value < TINY, F.lit(-(1 << 20))).otherwise(F.ceil(F.log(value) / float(np.log1p(STEP))).cast("int"))


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """Rows (groups, feature, bucket, n): the quantile sketch of each feature in each group.

    Texts that fail a base rule don't count. Those of a group that have all counts in common are copies as far as a sketch can tell, and count once,
    so that a text with very many copies doesn't become the middle of its source.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), _bucket(_ratio(a, b)).alias("bucket")) for name, (a, b, _) in FEATURES.items()])
    once = measured.where(~F.col("base_failed")).select(*groups, *COUNTS).distinct()
    return once.select(*groups, F.explode(cells).alias("c")).groupBy(*groups, "c.feature", "c.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The same sketches for coarser groups."""
    return sketch.groupBy(*groups, "feature", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, docs, feature, mid, reach): the middle of each feature's sketch, and how far above it its limit lies."""
    by = [*groups, "feature"]
    run = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = sketch.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    value = F.when(F.col("bucket") < -(1 << 19), F.lit(0.0)).otherwise(F.pow(F.lit(1 + STEP), F.col("bucket")) * (2 / (2 + STEP)))
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), value))
    found = seen.groupBy(*by).agg(quantile(MID).alias("mid"), quantile(LOW).alias("low"), quantile(HIGH).alias("high"), F.max("all").alias("docs"))
    spread = F.col("feature").isin(VARIED) & (F.col("mid") > F.col("low"))  # else half of the texts have none of it, or as much
    reach = F.when(spread, SPREADS * (F.col("mid") - F.col("low"))).otherwise(TAILS * (F.col("high") - F.col("mid")))
    return found.select(*by, "docs", "mid", reach.alias("reach"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, feature, limit, own) of each cell of a sketch by lang and source; own says that no coarser group's reach replaced the cell's.

    From corpus to language to source, each level's middle and reach are drawn towards the level above, the less the more texts it has. There is
    none above the corpus, so few texts in all widen its reach, by 1 + PRIOR / n.
    """
    lang = merged(sketch, ["lang"])
    own = lambda k: F.col(f"docs{k}") / (F.col(f"docs{k}") + PRIOR)
    named = lambda x, k: x.select(*[F.col(c).alias(f"{c}{k}") if c in ("docs", "mid", "reach") else F.col(c) for c in x.columns])
    out = named(quantiles(merged(lang, []), []).withColumn("reach", F.col("reach") * (1 + PRIOR / F.col("docs"))), 2)
    for k, (finer, groups) in enumerate([(lang, ["lang"]), (sketch, ["lang", "source"])]):
        here, up = f"{1 - k}", f"{2 - k}"
        keys = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups[:-1]]
        above = out.select(F.col("feature").alias("f"), *[F.col(g).alias(f"__{g}") for g in groups[:-1]], f"mid{up}", f"reach{up}")
        found = named(quantiles(finer, groups), here).join(above, [F.col("feature") == F.col("f"), *keys])
        varied = F.col("feature").isin(VARIED)
        least = F.when(varied, F.greatest(f"reach{here}", LEAST_PART * F.col(f"reach{up}"))).otherwise(F.col(f"reach{here}"))
        blend = lambda value, rest: own(here) * value + (1 - own(here)) * F.col(rest)
        out = found.select(*groups, "feature", blend(F.col(f"mid{here}"), f"mid{up}").alias(f"mid{here}"), blend(least, f"reach{up}").alias(f"reach{here}"), (~varied | (F.col(f"reach{here}") >= LEAST_PART * F.col(f"reach{up}"))).alias("own"))
    limit = (F.col("mid0") + F.col("reach0")) * (1 + STEP)  # a value is known to a bucket
    limit = F.when(F.col("feature") == "repeats", F.least(limit, F.lit(MOST_REPEATS))).otherwise(limit)
    return out.select("lang", "source", "feature", limit.alias("limit"), "own")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and base_failed of each row."""
    m = saved(measures(docs, ("doc_id", "lang", "source")))
    return m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and failed: the rules that reject the document.

    base_failed: fewer than MIN_WORDS words, or more than half of them in repeated 3-word windows. Others are
    kept unless a feature exceeds the limit of their language and source. Nulls in lang or source form a group of
    their own; null and empty texts have no words, so they fail; equal rows are judged alike; extra columns are
    not read.
    """
    m = measured(docs)
    rules = limits(sketches(m, ["lang", "source"])).groupBy(F.col("lang").alias("l"), F.col("source").alias("s"))
    rules = rules.agg(*[F.max(F.when(F.col("feature") == name, F.col("limit"))).alias(f"limit_{name}") for name in FEATURES])
    out = m.join(rules, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    over = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *[F.when(_ratio(a, b) > F.col(f"limit_{name}"), F.lit(name)) for name, (a, b, _) in FEATURES.items()]))
    out = out.withColumn("failed", over).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "failed")


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, whole. Rows that repeat an id stay if one of them passes; rows without one go."""
    return docs.join(judged(docs).where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
