r"""Personal data: patterns, and what corpus co-occurrence says about the words beside protected values.

Patterns find e-mail addresses, IP addresses, cards and phone numbers. Beyond them, co-occurrence over the whole corpus tells
how strongly a word gives a protected entity away. With p(e) the share of texts (or terms) that hold the entity e and p(e|t) the share
of term t's occurrences that stand beside e, t discloses the part 1 - log p(e|t) / log p(e) of e's information. Two
kinds of entity are measured so:

* each e-mail address, IP address, card and phone number. Terms that disclose DISCLOSURE or more of one in SUPPORT documents name
  whom it belongs to; they are generalised wherever they stand. Documents count as one if their signatures agree in COPY of
  SIGNATURE least hashes of words, so copies and near copies of a text support nothing by themselves, whereas a fixed
  wording in different documents does;
* secrets, as one class: terms of SECRET_BITS or more of information, which the corpus's own transitions between bytes measure,
  so that nobody could guess them. Terms that disclose DISCLOSURE of that class, over SUPPORT different values, are cues ("token"). A cue names
  nobody and stays; the value beside it is generalised. Counts of cues are smoothed by PRIOR.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import text
from folioflow.llm.scratch import saved

KINDS = ("email", "ip", "card", "phone", "term", "secret")
#: Words on each side of an entity, on its line or others, that count as its context.
CONTEXT, SUPPORT, DISCLOSURE = 5, 3, 0.9
#: Information of a value that can't be guessed; bytes between a cue and its value; occurrences by which a cue's share is drawn to the corpus's.
SECRET_BITS, CUE_GAP, PRIOR = 64.0, 8, 4.0
#: What a disclosing term does: is generalised itself, or has the value after it or before it generalised.
ITSELF, VALUE_AFTER, VALUE_BEFORE = 0, 1, 2
SIGNATURE, COPY = 32, 16
_MUL = (np.random.default_rng(362436069).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
#: Terms looked for in one pass over the texts; more take more passes.
TERMS_A_PASS = 1 << 18
#: Bytes of the broadcast filter of candidate terms; it has no false negatives, and what it lets through is joined exactly.
FILTER_BYTES = 1 << 20

# The patterns are those of the contract, written so that no text makes them slow: digits and words are never given back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A term: ASCII letters and digits and all other characters outside ASCII, three bytes at least; A-Z are as a-z.
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
TERM_BYTES = 3
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(value: str) -> Iterator[tuple[int, int]]:
    """A match begins where the run of name characters before an @ does."""
    done, at = 0, value.find("@")
    while at >= 0:
        begin = at
        while begin > done and value[begin - 1] in _LOCALS:
            begin -= 1
        found = _DOMAIN.match(value, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        else:
            done = at + 1
        at = value.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(value: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and kind; ends exclusive, in code points."""
    out = [(a, 0, b) for a, b in emails(value)] if "@" in value else []
    for m in _IP.finditer(value):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(value):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in value:
        for m in _PHONE.finditer(value):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


_SIGNS = np.zeros(256, bool)
_SIGNS[[ord("@"), *range(0x30, 0x3A)]] = True


def suspects(raw: np.ndarray, at: np.ndarray) -> list[int]:
    """Rows with a digit or an @; no pattern matches in others."""
    total = np.concatenate([[0], np.cumsum(_SIGNS[raw])])
    return np.flatnonzero(total[at[1:]] > total[at[:-1]]).tolist()


def _hash(words: list[str]) -> np.ndarray:
    raw, at = text.flat(pa.array(words, pa.string()))
    return text.hashes(raw, at[:-1], at[1:], True).astype(np.int64)


def _terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, text.Words]:
    """Hash and place of each term of some rows."""
    w = text.words(raw, at, text.PUNCT)
    long = w.end - w.start >= TERM_BYTES
    w = text.Words(w.start[long], w.end[long], w.row[long], w.first)
    return text.hashes(raw, w.start, w.end, True).astype(np.int64), w


def contexts(value: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[str]]]:
    """(entity, terms near it) of each span; terms lie outside all spans."""
    for start, kind, end in spans:
        # a context is a few words, however long the text is
        left, right = max(0, start - 64 * CONTEXT), min(len(value), end + 64 * CONTEXT)
        near = [m for m in _WORD.finditer(value, left, start) if m.start() > left or left == 0][-CONTEXT:]
        after = [m for m in _WORD.finditer(value, end, right) if m.end() < right or right == len(value)][:CONTEXT]
        words = [m[0] for m in near + after if len(m[0].encode()) >= TERM_BYTES and not any(a < m.end() and m.start() < b for a, _, b in spans)]
        what = value[start:end]
        entity = what.lower() if kind == 0 else what if kind == 1 else re.sub("[^0-9]", "", what)
        yield f"{KINDS[kind]}:{entity}", words


def signature(value: str) -> list[int]:
    """Least hashes of the text's terms; the share of equal ones estimates the similarity of two texts."""
    terms, _ = _terms(*text.flat(pa.array([value], pa.string())))
    terms = text.mix(np.unique(terms).view(np.uint64))
    return [int((terms * np.uint64(m)).min(initial=(1 << 64) - 1)) >> 33 for m in _MUL]


_LOWER = text._LOWER.astype(np.int64)


def _steps(raw: np.ndarray, w: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the terms as a step from the byte before it (0 begins a term), in code 256 * before + byte; and each term's first step."""
    size = w.end - w.start
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.start - first[:-1], size) + np.arange(first[-1])
    here = _LOWER[raw[at]]
    before = np.concatenate([[0], here[:-1]]) if len(here) else here
    before[first[:-1]] = 0
    return before * 256 + here, first


def information(steps: dict[int, int]) -> np.ndarray:
    """Bits of each step, from how often the corpus takes it (a step more for each, so none is impossible)."""
    n = np.ones((256, 256))
    for code, k in steps.items():
        n[code >> 8, code & 255] += k
    return (np.log2(n.sum(1, keepdims=True)) - np.log2(n)).ravel().astype(np.float32)


def _bits(raw: np.ndarray, w: text.Words, table: np.ndarray) -> np.ndarray:
    steps, first = _steps(raw, w)
    total = np.concatenate([[0], np.cumsum(table[steps], dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, signature of the text) of each term near an entity, and a row with term 0 for each entity of a text; (code, null, null, n) of each step."""
    steps = np.zeros(1 << 16, np.int64)
    for batch in batches:
        raw, at = text.flat(batch.column("text"))
        for i, j in text.chunks(at):
            part = raw[at[i] : at[j]]
            steps += np.bincount(_steps(part, _terms(part, at[i : j + 1] - at[i])[1])[0], minlength=1 << 16)
        entity, term, around = [], [], []
        for k in suspects(raw, at):
            value = raw[at[k] : at[k + 1]].tobytes().decode()
            spans = base_spans(value)
            seen = set()
            mark = signature(value) if spans else []
            for who, words in contexts(value, spans) if spans else ():
                e = int(_hash([who])[0])
                if e not in seen:
                    seen.add(e)
                    entity.append(e)
                    term.append(0)
                    around.append([])
                for t in sorted(set(_hash(words).tolist())) if words else ():
                    entity.append(e)
                    term.append(t)
                    around.append(mark)
        yield _pair_rows(entity, term, around, [1] * len(entity))
    used = np.flatnonzero(steps)
    yield _pair_rows(used, [None] * len(used), [None] * len(used), steps[used])


def _pair_rows(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["entity", "term", "mark", "n"])


def _free(part: np.ndarray, bounds: np.ndarray, w: text.Words, picked: np.ndarray, spans: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """Those of the picked terms that lie outside the base spans of their row, which are found for such rows alone."""
    points = np.concatenate([[0], np.cumsum(text.LEADS[part])])
    keep = []
    for k in picked.tolist():
        r = int(w.row[k])
        if r not in spans:
            spans[r] = [(a, b) for a, _, b in base_spans(part[bounds[r] : bounds[r + 1]].tobytes().decode())]
        a, b = (int(points[x] - points[bounds[r]]) for x in (w.start[k], w.end[k]))
        keep.append(not any(x < b and a < y for x, y in spans[r]))
    return picked[np.array(keep, bool)]


def _beside(w: text.Words, picked: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(what a cue does, its index, the value's) of the terms close to each picked one, in its row."""
    for side, near in ((VALUE_AFTER, picked - 1), (VALUE_BEFORE, picked + 1)):
        ok = (near >= 0) & (near < len(w.row))
        a, b = near[ok], picked[ok]
        gap = w.start[b] - w.end[a] if side == VALUE_AFTER else w.start[a] - w.end[b]
        close = (w.row[a] == w.row[b]) & (gap <= CUE_GAP)
        yield side, a[close], b[close]


def _values(shared):
    """(cue, does, value, n) of the terms beside values that can't be guessed; and with cue 0 the number of values, with does -1 that of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows: list[tuple[np.ndarray, ...]] = []
            raw, at = text.flat(batch.column("text"))
            values = terms = 0
            for i, j in text.chunks(at):
                part, bounds = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                hashed, w = _terms(part, bounds)
                picked = _free(part, bounds, w, np.flatnonzero(_bits(part, w, table) >= SECRET_BITS), {})
                values, terms = values + len(picked), terms + len(hashed)
                rows += [(hashed[a], np.full(len(a), side), hashed[b], np.ones(len(a), np.int64)) for side, a, b in _beside(w, picked)]
            rows.append(tuple(np.array(x, np.int64) for x in ([0, 0], [0, -1], [0, 0], [values, terms])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], ["cue", "does", "value", "n"])

    return run


def _slots(terms: np.ndarray, size: int) -> np.ndarray:
    return (text.mix(terms.astype(np.uint64)) % np.uint64(size * 8)).astype(np.int64)


def _totals(shared):
    """(term, n): occurrences in this task of terms that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        total: Counter[int] = Counter()
        for batch in batches:
            raw, at = text.flat(batch.column("text"))
            for i, j in text.chunks(at):
                terms, _ = _terms(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                slot = _slots(terms, len(bits))
                total.update(terms[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1].tolist())
            if len(total) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return run


def _smoothed(beside: Column, among: Column, share: float) -> Column:
    return (beside + PRIOR * share) / (among + PRIOR)


def disclosing(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(term, does, disclosure): hashes of terms that reveal a protected entity, and what each does; and the bits of each step between bytes.

    Counts cover all texts; copies of a text support once, and so does each value.
    """
    spark = docs.sparkSession
    seen = saved(docs.select("text").mapInArrow(_pairs, "entity long, term long, mark array<int>, n long").groupBy("entity", "term", "mark").agg(F.sum("n").alias("n")))
    table = information({r.entity: r.n for r in seen.where("term is null").select("entity", "n").collect()})  # 65,536 rows at most
    found = docs.select("text").mapInArrow(_values(spark.sparkContext.broadcast(table)), "cue long, does long, value long, n long")
    found = saved(found.groupBy("cue", "does", "value").agg(F.sum("n").alias("n")))
    sizes = {r.does: r.n for r in found.where("does <= 0").collect()}
    cues = found.where("does > 0").groupBy("cue", "does").agg(F.sum("n").alias("beside"), F.count("*").alias("values")).where(F.col("values") >= SUPPORT)
    cues = saved(cues.select(F.col("cue").alias("term"), "does", "beside"))
    near = seen.where("term <> 0")
    rest = near
    for _ in range(SUPPORT - 1):  # the most frequent text goes, and all that are like it
        lead = rest.groupBy("entity", "term").agg(F.max(F.struct("n", "mark"))["mark"].alias("lead"))
        common = F.size(F.filter(F.zip_with("mark", "lead", lambda x, y: x == y), lambda same: same))
        rest = saved(rest.join(lead, ["entity", "term"]).where(common < COPY).drop("lead"))
    supported = rest.select("entity", "term").distinct()
    near = saved(near.groupBy("entity", "term").agg(F.sum("n").alias("beside")).join(supported, ["entity", "term"]))
    candidates = near.select("term").union(cues.select("term")).distinct()
    marks = candidates.mapInPandas(_marks, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()  # FILTER_BYTES rows at most
    bits = np.zeros(FILTER_BYTES, np.uint8)
    for at, x in marks:
        bits[at] = x
    totals = docs.select("text").mapInArrow(_totals(spark.sparkContext.broadcast(bits.tobytes())), "term long, n long").groupBy("term").agg(F.sum("n").alias("all"))
    totals = saved(totals.join(candidates, "term", "left_semi"))
    held = seen.where("term = 0").groupBy("entity").agg(F.sum("n").alias("texts"))
    texts = docs.count()
    told = lambda p_et, p_e: 1 - F.log(p_et) / F.log(p_e)
    scored = near.join(totals, "term").join(held, "entity")
    scored = scored.withColumn("disclosure", told(F.least(F.col("beside") / F.col("all"), F.lit(1.0)), F.least(F.col("texts") / F.lit(texts), F.lit(0.5))))
    share = min(0.5, max(sizes.get(0, 0), 1) / max(sizes.get(-1, 0), 1))
    cues = cues.join(totals, "term").withColumn("disclosure", told(_smoothed(F.least("beside", "all"), F.col("all"), share), F.lit(share)))
    both = scored.select("term", F.lit(ITSELF).alias("does"), "disclosure").union(cues.select("term", F.col("does").cast("int"), "disclosure"))
    return both.where(F.col("disclosure") >= DISCLOSURE).groupBy("term", "does").agg(F.max("disclosure").alias("disclosure")), table


def _marks(batches):
    import pandas as pd

    for pdf in batches:
        slot = _slots(pdf["term"].to_numpy(), FILTER_BYTES)
        yield pd.DataFrame({"at": slot >> 3, "bits": 1 << (slot & 7)})


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _among(hashed: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each hash is one of some, which ascend."""
    if not len(some):
        return np.zeros(len(hashed), bool)
    return some[np.minimum(np.searchsorted(some, hashed), len(some) - 1)] == hashed


def _find(shared, keep_text: bool):
    """Spans of each text: the base patterns' on the first pass, and those that the terms in shared tell."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, table = shared.value
        for batch in batches:
            raw, at = text.flat(batch.column("text"))
            out: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            if "spans" in batch.schema.names:
                out = [[(s["start"], s["kind"], s["end"]) for s in row] for row in batch.column("spans").to_pylist()]
            else:
                for k in suspects(raw, at):
                    out[k] = base_spans(raw[at[k] : at[k + 1]].tobytes().decode())
            for i, j in text.chunks(at):
                part, bounds = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                hashed, w = _terms(part, bounds)
                hit = [(k, 4) for k in np.flatnonzero(_among(hashed, terms[ITSELF])).tolist()]
                if len(terms[VALUE_AFTER]) or len(terms[VALUE_BEFORE]):
                    secret = np.flatnonzero(_bits(part, w, table) >= SECRET_BITS)
                    hit += [(k, 5) for side, a, b in _beside(w, secret) for k in b[_among(hashed[a], terms[side])].tolist()]
                points = np.concatenate([[0], np.cumsum(text.LEADS[part])])
                for k, what in hit:
                    r = int(w.row[k])
                    a, b = (int(points[x] - points[bounds[r]]) for x in (w.start[k], w.end[k]))
                    if not any(x < b and a < y and (k0 < 4 or k0 == what) for x, k0, y in out[i + r]):
                        out[i + r].append((a, what, b))
            rows = [[{"start": a, "kind": k0, "end": b} for a, k0, b in sorted(spans)] for spans in out]
            names = [n for n in batch.schema.names if n != "spans" and (keep_text or n != "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, kind)], [*names, "spans"])

    return run


def find(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, text (if asked for) and spans (start, kind, end): places in code points, kinds as in KINDS, by start and kind.

    Null and empty texts have no spans; copies have the same; rows that repeat an id each keep theirs. A term or secret that
    overlaps a base span isn't reported again. Extra columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    terms, table = disclosing(docs)
    terms = saved(terms)
    passes = max(1, -(-terms.count() // TERMS_A_PASS))
    out = docs.select("doc_id", "text")
    for k in range(passes):
        mine = terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k).collect()  # TERMS_A_PASS rows or so
        shared = spark.sparkContext.broadcast(([np.array(sorted(r.term for r in mine if r.does == side), np.int64) for side in (ITSELF, VALUE_AFTER, VALUE_BEFORE)], table))
        held = keep_text or k + 1 < passes
        out = out.mapInArrow(_find(shared, held), f"doc_id long, {'text string, ' * held}spans {_SPANS}")
    return out


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            parts, last = [], 0
            for s in spans:
                if s["end"] <= last:
                    continue
                if s["start"] >= last:
                    parts += [value[last : s["start"]], f"<{KINDS[s['kind']]}>"]
                last = s["end"]
            out.append(value if value is None else "".join([*parts, value[last:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text, with each span generalised to the name of its kind; overlapping spans become one."""
    return find(docs, True).mapInArrow(_replace, "doc_id long, text string")
