"""Operators against plain versions of what they compute."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, line_dedup, mixing, near_dedup, pii, quality, queries, scratch, sharding, text, token_count, toxicity

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.text(st.sampled_from("aB é\n\t.0😀-|#"), max_size=25) | st.none(), max_size=8)


@given(TEXTS)
def test_words_are_those_of_the_pattern(values):
    raw, at = text.flat(pa.array(values, pa.string()))
    for separators, pattern in ((text.SPACE, SPACED), (text.PUNCT, ALNUM)):
        w = text.words(raw, at, separators)
        found = [raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
        want = [pattern.findall(v or "") if separators is text.SPACE else [m.group() for m in pattern.finditer((v or "").translate(LOWER))] for v in values]
        assert [x.translate(LOWER) if separators is text.PUNCT else x for x in found] == [x for row in want for x in row]
        assert list(w.row) == [k for k, row in enumerate(want) for _ in row]
        hashed = text.hashes(raw, w.start, w.end, True).tolist()
        assert len(set(hashed)) == len({x.translate(LOWER) for x in found})


@given(TEXTS)
@settings(max_examples=60)
def test_quality_counts(values):
    raw, at = text.flat(pa.array(values, pa.string()))
    got = list(zip(*[x.tolist() for x in quality._counts(raw, at)[:5]], strict=True))

    def plain(value):
        v = value or ""
        w = SPACED.findall(v)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in v.split("\n") if SPACED.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", v)), len(lines) - len(set(lines)), len(cover)

    assert got == [plain(v) for v in values]


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[d] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    parent = {d: d for d in sets}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    holders = defaultdict(list)
    for d in sorted(sets):
        both = Counter(e for g in sets[d] for e in holders[g])
        for e, n in both.items():
            if 100 * n >= 85 * (len(sets[d]) + len(sets[e]) - n):
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
        for g in sets[d]:
            holders[g].append(d)
    return {(d, len(sets[d]), top(d), top(d) == d) for d in sets}


def near_copies(seed, groups=6, copies=40):
    """Groups of copies at every distance, around the threshold too."""
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"t{r.randint(0, 5000)}" for _ in range(r.randint(5, 200))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = f"n{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates(spark, small, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_copies(3)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == plain_components(rows)


def test_near_duplicates_of_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    assert {tuple(r) for r in queries.op2_near_dedup(spark, small).collect()} == plain_components(rows)


def test_estimate_follows_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for j in (0.5, 0.8, 0.95):
        shared = int(2 * 2000 * j / (1 + j))
        b = np.concatenate([a[:shared], r.integers(0, 1 << 63, 2000 - shared, dtype=np.uint64)])
        ra, rb = (near_dedup.registers(np.array([(x * m + c).min() for m, c in zip(near_dedup._MUL, near_dedup._ADD, strict=True)])) for x in (a, b))
        assert abs(near_dedup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0] - j) < 0.12


def plain_hits(value, items, window=10):
    w = [m.group() for m in ALNUM.finditer((value or "").translate(LOWER))]
    hit, found = set(), set()
    for item, t in items:
        iw = [m.group() for m in ALNUM.finditer((t or "").translate(LOWER))]
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1) if iw else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_contamination(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    r = random.Random(5)
    make = lambda n: " ".join(r.choice("abc") for _ in range(n))
    docs = [(i, make(r.randint(0, 40))) for i in range(120)]
    items = [(i, make(r.choice([0, 1, 3, 4, 9, 10, 11, 13]))) for i in range(30) if i != 1] + [(99, None)]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == {d: plain_hits(t, items) for d, t in docs}


def test_contamination_by_single_words(spark):
    docs, items = [(1, "a b c"), (2, "B-b"), (3, "c")], [(7, "b"), (8, "a b")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == {1: (3, 2, [7, 8]), 2: (2, 2, [7]), 3: (1, 0, [])}


def test_query_of_contamination(spark, small):
    items = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    want = {}
    for r in queries.table(spark, small, "documents").collect():
        n, h, f = plain_hits(r.text, items) if len(r.text) < 4000 else (None, None, None)
        if n is not None:
            want[r.doc_id] = (n, h, len(f), hashlib.sha256(",".join(sorted(map(str, f))).encode()).hexdigest(), h > 0)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_decontaminate(spark, small).collect()}
    assert {d: got[d] for d in want} == want and len(got) == 200


def prose(seed, n=90, capitals=0, marks=0, longer=0, dup=0, refrain=0, per_line=6):
    """n different words in lines; so many capitals, marks, words twice as long, repeated lines, and words of a repeated phrase."""
    r = random.Random(seed)
    w = [f"{''.join(r.choice('abcdefgh') for _ in range(r.randint(3, 7)))}{r.randint(0, 9)}" for _ in range(n)]
    w = [x * (2 if i < longer else 1) for i, x in enumerate(w)]
    w = [("AB" if i < capitals else "") + x + ("##" if i < marks else "") for i, x in enumerate(w)]
    if refrain:
        w[-2 * refrain : -refrain] = w[-refrain:]
    r.shuffle(lines := [" ".join(w[k : k + per_line]) for k in range(0, n, per_line)])
    for k in range(dup):  # one word each, in other company each time
        lines[4 * k + 1 : 4 * k + 1] = [f"z{k}"]
        lines[4 * k + 3 : 4 * k + 3] = [f"z{k}"]
    return "\n".join(lines)


#: What most texts of one source have of a feature, and what a text has that only this source is used to.
USED_TO = {"marks": ("marks", 30, 34), "upper": ("capitals", 30, 34), "word_length": ("longer", 60, 75), "dup_lines": ("dup", 6, 7), "repeats": ("refrain", 17, 18)}


@pytest.mark.parametrize("feature", USED_TO)
def test_limits_follow_sources(spark, feature):
    kind, usual, asked = USED_TO[feature]
    line = {"per_line": 30 if feature == "repeats" else 6}
    rows = [(k, prose(k, **{"capitals": 5 + k % 3, "marks": 5 + k % 4} | line), "en", "plain") for k in range(900)]
    few = {"marks": 10, "capitals": 10}.get(kind, 0)
    rows += [(1000 + k, prose(1000 + k, **{"capitals": 5 + k % 3, "marks": 5 + k % 4, kind: few + (usual - few) * (k % 20) // 19} | line), "en", "used") for k in range(300)]
    same = prose(9, **{"capitals": 5, "marks": 5, kind: asked} | line)
    rows += [(2000, same, "en", "plain"), (2001, same, "en", "used")]
    got = {r.doc_id: (r.kept, r.failed) for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[2000] == (False, [feature]) and got[2001] == (True, [])
    assert sum(not kept for kept, _ in got.values()) <= 2


def test_limits_are_those_of_exact_quantiles(spark, small):
    import numpy as np

    docs = queries.table(spark, small, "documents").unionAll(queries.table(spark, small.replace("0.001", "0.01"), "documents"))
    m = quality.measured(docs)
    got = {(r.lang, r.source, r.feature): r.limit for r in quality.limits(quality.sketches(m, ["lang", "source"])).collect()}
    rows = list({tuple(r)[1:]: r for r in m.collect() if not r.base_failed}.values())  # rows of equal counts are copies

    def level(some, f, up):
        top, bottom, varies = quality.FEATURES[f]
        x = np.sort([r[top] / r[bottom] if r[bottom] else 0.0 for r in some])
        mid, low, high = (x[int(np.ceil(q * len(x))) - 1] for q in (quality.MID, quality.LOW, quality.HIGH))
        reach = quality.SPREADS * (mid - low) if varies and mid > low else quality.TAILS * (high - mid)
        if up is None:
            return mid, reach * (1 + quality.PRIOR / len(x))
        reach = max(reach, quality.LEAST_PART * up[1]) if varies else reach
        own = len(x) / (len(x) + quality.PRIOR)
        return own * mid + (1 - own) * up[0], own * reach + (1 - own) * up[1]

    for (lang, source, f), limit in got.items():
        up = level([r for r in rows if r.lang == lang], f, level(rows, f, None))
        want = sum(level([r for r in rows if (r.lang, r.source) == (lang, source)], f, up))
        want = min(want, quality.MOST_REPEATS) if f == "repeats" else want
        assert abs(limit - want) <= 0.1 * want + 1e-3, (lang, source, f)  # buckets are 2 % wide, and a reach is 8 times a difference


def test_hardly_any_limit_is_another_groups(spark, small):
    docs = queries.table(spark, small.replace("0.001", "0.1"), "documents")
    cells = quality.limits(quality.sketches(quality.measured(docs), ["lang", "source"])).collect()
    assert len(cells) >= 300 and sum(not c.own for c in cells) < 0.05 * len(cells)
    assert all(c.limit < 0.5 for c in cells if c.feature == "repeats")


def test_features_that_a_language_lacks(spark):
    """Texts without capitals or marks but for a few: those stay, as the upper quantile says, and texts of capitals go."""
    rows = [(k, prose(k, capitals=2 if k % 50 == 0 else 0, marks=1 if k % 40 == 0 else 0), "zh", f"s{k % 3}") for k in range(900)] + [(2000, prose(7, capitals=80), "zh", "s1")]
    got = {r.doc_id for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("not kept").collect()}
    assert got == {2000}


def test_copies_do_not_narrow_a_source(spark):
    rows = [(k, prose(k, capitals=4 + k % 5, marks=3 + k % 5), "en", f"s{k % 4}") for k in range(400)] + [(1000 + k, prose(5000), "en", "s1") for k in range(400)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("not kept").count()
    assert got == 0


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
    r = random.Random(1)
    pieces = [*"ab th  ▁\n\t\r é😀字<>0.,ﬁ\x00\x01Éß", "the", "<s>", "　", "  ", " the", " and", "\nthe"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))) for i in range(4000)] + [(-1, None), (-2, " ".join(["the"] * 5000))]
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {i: (len((t or "").encode()), n := len(encode(t or "")), n > 4096) for i, t in rows}


@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(2, 6))
def test_differencing_partitions(sizes, shards):
    found = sharding.differencing(sizes, shards)
    assert len(found) == len(sizes) and all(0 <= s < shards for s in found)


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40), st.integers(2, 6))
def test_spread_is_at_most_the_largest_size(sizes, shards):
    of = [0] * shards
    for s, k in zip(sizes, sharding.differencing(sizes, shards), strict=True):
        of[k] += s
    assert max(of) - min(of) <= max(sizes) and sum(of) == sum(sizes)


@given(st.lists(st.integers(1, 60), min_size=1, max_size=8))
@settings(max_examples=60)
def test_differencing_is_near_the_best_halves(sizes):
    """Against every way to halve: the larger half is at most 7/6 of the least possible one."""
    halves = [sum(s for k, s in enumerate(sizes) if way >> k & 1) for way in range(1 << len(sizes))]
    best = min(max(h, sum(sizes) - h) for h in halves)
    found = [0, 0]
    for s, k in zip(sizes, sharding.differencing(sizes, 2), strict=True):
        found[k] += s
    assert 6 * max(found) <= 7 * best


def test_differencing_beats_its_rivals():
    r = random.Random(9)
    sizes = [r.randint(1, 10**6) for _ in range(400)]
    spread = lambda of: max(of) - min(of)
    kk, greedy = [0] * 16, [0] * 16
    for s, k in zip(sizes, sharding.differencing(sizes, 16), strict=True):
        kk[k] += s
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert spread(kk) < spread(greedy)


def test_shards(spark, small):
    rows = queries.op6_sharding(spark, small).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    sizes, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r.slot)
        of[texts[r.doc_id]].add(r["shard"])
    assert len(rows) == len(texts) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in of.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * max(sizes.values())


def test_numbering_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 10)
    df = spark.range(500).selectExpr("id", "id % 3 AS g")
    got = defaultdict(list)
    for r in sharding.numbered(df, "g", ["id"], "n").collect():
        got[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 500


def test_chat_round_trip(spark, small):
    want = defaultdict(list)
    for r in queries.table(spark, small, "conversations").collect():
        want[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    want[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op7_chat(spark, small).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv, turns in want.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert got.pop(conv) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
    assert not got


@given(st.text(st.sampled_from("<|\\n\nim_endx>"), max_size=30), st.text(st.sampled_from("<|\\n\nax>"), max_size=10))
def test_escaping(value, role):
    escape = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
    piece = f"{chat.BEGIN}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(value)}{chat.END}\n"
    assert chat.read_piece(piece) == (role, value)
    assert "<|" not in escape(value)


def test_layouts(spark):
    rows = [(1, '{"messages": [{"role": "user", "content": "q", "id": 3}, {"role": "assistant", "content": "a"}]}'), (2, '{"instruction": "i", "input": "", "output": "o"}'),
            (3, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}'), (4, '{"other": 1}'), (5, "{"), (6, None)]
    got = defaultdict(list)
    for r in chat.json_turns(spark.createDataFrame(rows, "conv_id long, json string")).collect():
        got[r.conv_id].append((r.layout, r.turn, r.role, r.text))
    assert got[1] == [("messages", 0, "user", "q"), ("messages", 1, "assistant", "a")]
    assert [x[2:] for x in got[2]] == [("user", "i"), ("assistant", "o")]
    assert [x[2:] for x in got[3]] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert got[4] == got[5] == got[6] == [(None, None, None, None)]


def test_layouts_beside_metadata(spark):
    rows = [(1, '{"conv_id": 1, "prompt": "a", "response": "b"}'), (2, '{"prompt": "a", "response": "b", "text": "c", "turn": 4, "role": "x"}'), (3, '{"messages": []}'),
            (4, '{"messages": [], "system": "s", "id": {"text": 3}}'), (5, '{"instruction": "i", "input": "n", "output": "o", "role": "r"}'), (6, '{"text": "only"}'), (7, '["messages"]')]
    turns = chat.json_turns(spark.createDataFrame(rows, "conv_id long, json string"))
    got = defaultdict(list)
    for r in turns.collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    assert got[1] == got[2] == [("prompt_response", "user", "a"), ("prompt_response", "assistant", "b")]
    assert got[3] == [("messages", None, None)] and got[4] == [("messages_system", "system", "s")]
    assert got[5] == [("instruction_input_output", "user", "i\n\nn"), ("instruction_input_output", "assistant", "o")] and got[6] == got[7] == [(None, None, None)]
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.formatted(turns)).collect()} == {1: 2, 2: 2, 4: 1, 5: 2}


@given(st.lists(st.text(st.sampled_from("abC é.\n1É字😀-"), max_size=20), max_size=6))
@settings(max_examples=150)
def test_grams_are_those_within_words(values):
    """As many distinct ones of each row as plain Python finds, alike in rows of equal grams."""

    def plain(value):
        low = "".join(" " if ord(c) < 128 and not c.isalnum() else c.lower() for c in value)
        padded = f" {low} "
        return {padded[i : i + n] for n in toxicity.GRAMS for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1]}

    raw, at = text.flat(pa.array(values, pa.string()))
    row, slot = toxicity.grams(raw, at)
    got = [set(slot[row == k].tolist()) for k in range(len(values))]
    want = [plain(v) for v in values]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in range(len(values)) for b in range(a))


def test_fit_finds_the_least_loss():
    """The gradient of the weighted, regularised loss vanishes at the fit."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [np.sort(r.choice(12, r.integers(0, 6), replace=False)).astype(np.int32) for _ in range(300)]
    scale, y, weight = r.normal(size=12), r.integers(0, 2, 300).astype(float), r.uniform(0.5, 2, 300)
    w, bias = toxicity._fit(rows, scale, y, weight)
    x = np.zeros((300, 12))
    for k, some in enumerate(rows):
        x[k, some] = scale[some]
    off = weight / weight.sum() * (1 / (1 + np.exp(-(x @ w + bias))) - y)
    assert np.abs(x.T @ off + toxicity.L2 * w).max() < 1e-4 and abs(off.sum()) < 1e-4


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abdeginorstu") for _ in range(r.randint(3, 8)))
    rows, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(r.randint(5, 60))]
        if toxic := i % 5 == 0:
            w[r.randrange(len(w))] = r.choice(["grumbkin", "Zorfing", "blatwad"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.scores(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [x for x in got if x.held]
    assert 150 < len(held) < 350
    assert sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(value):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, value):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii._luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@given(st.lists(st.sampled_from(["@", "a", ".", "1", "2", "99", "255", "+", "-", " ", "(", ")", "4111111111111111", "%", "b.c", "\n", "é", "١"]), max_size=24).map("".join))
@settings(max_examples=500)
def test_patterns(value):
    assert pii.base_spans(value) == plain_spans(value)


def test_disclosing_terms(spark):
    r = random.Random(2)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{some(8)} Zorblax jo@ex.org {some(8)}") for i in range(5)] + [(100 + i, some(30)) for i in range(500)] + [(700, "say zorblax here")]
    rows += [(800 + i, f"copy one two three four five qqqq me@ex.com six seven eight nine {'z' * (3 + i)}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [(s["start"], s["kind"], s["end"]) for s in x.spans] for x in pii.find(docs).collect()}
    assert got[700] == [(4, 4, 11)] and len(got[0]) == 2 and got[100] == []
    assert all(len(got[800 + i]) == 1 for i in range(9))  # copies support nothing
    assert {x.text for x in pii.sanitised(docs).where("doc_id = 700").collect()} == {"say <term> here"}


def plain_cues(rows):
    """(cue, does) -> disclosure, term by term."""
    import math

    word = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    found = []
    steps = Counter()
    for value in rows:
        ms = [m for m in word.finditer(value) if len(m[0].encode()) >= pii.TERM_BYTES]
        found.append(ms)
        for m in ms:
            raw = m[0].translate(LOWER).encode()
            steps.update(zip(b"\0" + raw, raw))
    out_of = Counter()
    for (a, _), n in steps.items():
        out_of[a] += n
    bits = lambda t: sum(math.log2(out_of[a] + 256) - math.log2(steps[a, b] + 1) for a, b in zip(b"\0" + t, t))
    beside, values, total, n_values = Counter(), defaultdict(set), Counter(), 0
    for value, ms in zip(rows, found, strict=True):
        spans = plain_spans(value)
        name = [m[0].translate(LOWER) for m in ms]
        total.update(name)
        for k, m in enumerate(ms):
            if bits(name[k].encode()) < pii.SECRET_BITS or any(a < m.end() and m.start() < b for a, _, b in spans):
                continue
            n_values += 1
            for does, j in ((pii.VALUE_AFTER, k - 1), (pii.VALUE_BEFORE, k + 1)):
                if 0 <= j < len(ms) and max(ms[j].start() - m.end(), m.start() - ms[j].end()) <= pii.CUE_GAP:
                    beside[name[j], does] += 1
                    values[name[j], does].add(name[k])
    p = n_values / sum(total.values())
    told = {c: 1 - math.log((min(n, total[c[0]]) + pii.PRIOR * p) / (total[c[0]] + pii.PRIOR)) / math.log(p) for c, n in beside.items() if len(values[c]) >= pii.SUPPORT}
    return {c: x for c, x in told.items() if x >= pii.DISCLOSURE}


def test_secrets_beside_cues(spark):
    r = random.Random(8)
    word = lambda n=6: "".join(r.choice("abcdefgh") for _ in range(n))
    some = lambda n: " ".join(word() for _ in range(n))
    key = lambda: "".join(r.choice("0123456789ABCDEFxyz") for _ in range(32))
    rows = [f'{some(12)} token = "{key()}" {some(9)}' for _ in range(12)] + [f"{some(7)} {key()} (serial) {some(9)}" for _ in range(12)] + [f"{some(4)} jo.{word()}@mail.ex.org {some(4)}" for _ in range(5)]
    rows += [f"{some(30)} the {word(30)} {some(3)}" for _ in range(3)] + [f"the {some(30)}" for _ in range(400)] + [f"{some(3)} copyright {'k9' * 20} {some(1)}"] * 9
    rows += ["say token in a meeting", f"here {key()} alone"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = plain_cues(rows)
    assert set(want) == {("token", pii.VALUE_AFTER), ("serial", pii.VALUE_BEFORE)}
    got = {(x.term, x.does): x.disclosure for x in pii.disclosing(docs)[0].collect()}
    assert got.keys() == {(int(pii._hash([c])[0]), d) for c, d in want}
    assert all(abs(got[int(pii._hash([c])[0]), d] - x) < 1e-5 for (c, d), x in want.items())
    spans = {x.doc_id: [rows[x.doc_id][s["start"] : s["end"]] for s in x.spans if s["kind"] == 5] for x in pii.find(docs).collect()}
    assert all(len(spans[k]) == 1 and len(spans[k][0]) == 32 for k in range(24)) and not any(spans[k] for k in range(24, len(rows)))


def test_terms_in_a_fixed_wording_and_on_other_lines(spark):
    r = random.Random(3)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{some(20)}\n\nKowalski: k@x.org\n\n{some(20)}") for i in range(6)] + [(100 + i, f"{some(20)}\nWrzesien\n+48 22 555 01 02\n{some(20)}") for i in range(6)]
    rows += [(200 + i, some(30)) for i in range(500)] + [(800, "met kowalski there"), (801, "met wrzesien there")]
    rows += [(900 + i, f"{some(1)} same words of one copy and Nobody: n@x.org so on and on it goes the same") for i in range(9)] + [(950, "met nobody there")]
    got = {x.doc_id: [(s["start"], s["kind"], s["end"]) for s in x.spans] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[800] == got[801] == [(4, 4, 12)] and got[950] == [] and got[200] == []


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_aligns(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(line_dedup.patience(a, a)) == len(a)


def test_shared_blocks(spark):
    line = lambda k: " ".join(f"v{k}w{i}" for i in range(12))
    rows = [(1, "\n".join(map(line, range(6)))), (2, "\n".join(["own words here", line(2), line(3), "more of its own"])), (3, "short\nline"), (4, "short\nline")]
    rows += [(10 + i, f"{line(99)}\n{line(1000 + i)}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.owners) for r in line_dedup.shared_lines(docs).collect()}
    assert got[1] == ([], []) and got[2] == ([1, 2], [1]) and got[3] == got[4] == ([], [])
    assert got[10] == ([], []) and all(got[10 + i] == ([0], [10]) for i in range(1, 30))
    assert {r.doc_id: r.text for r in line_dedup.without_shared_lines(docs).collect()}[2] == "own words here\nmore of its own"


def test_shared_blocks_of_short_lines_with_many_holders(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = "\n".join(words(f"p{k}x", 6) for k in range(9))
    tiny = "\n".join(words(f"t{k}x", 2) for k in range(5))
    rows = [(i, f"{passage}\n{words(f'own{i}x', 12)}") for i in range(1200)] + [(2000 + i, f"{words(f'own{i}y', 12)}\n{tiny}") for i in range(3)]
    got = {r.doc_id: (r.removed, r.owners) for r in line_dedup.shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[2000] == ([], []) and all(got[i] == (list(range(9)), [0]) for i in range(1, 1200))
    assert got[2001] == got[2002] == ([1, 2, 3, 4, 5], [2000])


def plain_removed(rows, least=10):
    """Lines in a run of equal lines, of so many words, of an earlier document."""
    lines = {d: t.split("\n") for d, t in rows}
    out = {d: set() for d in lines}
    for d in lines:
        for e in (e for e in lines if e < d):
            for j in range(len(lines[d])):
                for i in range(len(lines[e])):
                    n = 0
                    while i + n < len(lines[e]) and j + n < len(lines[d]) and lines[e][i + n] == lines[d][j + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[d][j : j + n]) >= least:
                        out[d] |= set(range(j, j + n))
    return {d: sorted(x) for d, x in out.items()}


def test_repeated_and_moved_blocks(spark):
    line = lambda k, n=12: " ".join(f"v{k}w{i}" for i in range(n))
    text = lambda *ks: "\n".join(map(line, ks))
    rows = [(1, text(1, 2, 1, 3)), (2, text(20, 1, 21)), (3, text(22, 3, 23, 2, 24, 3)), (4, text(30, 31, 32, 33)), (5, text(32, 33, 40, 30, 31, 41, 30))]
    r = random.Random(6)
    rows += [(10 + k, "\n".join(line(100 + (j := r.randint(0, 9)), 2 + j % 5) for _ in range(r.randint(1, 25)))) for k in range(30)]
    got = {x.doc_id: x.removed for x in line_dedup.shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == [1] and got[3] == [1, 3, 5] and got[5] == [0, 1, 3, 4, 6]
    assert got == plain_removed(rows)


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1))
def test_schedule_deviates_by_less_than_a_block(shares):
    period, given_ = sum(shares.values()), Counter()
    plan = mixing.schedule(shares)
    assert [slot for _, _, slot in plan] == list(range(period))
    for source, block, slot in plan:
        assert block == given_[source]
        given_[source] += 1
        assert all(abs(given_[k] - (slot + 1) * n / period) < 1 for k, n in shares.items())


def test_long_mixture_keeps_to_exact_weights(spark):
    weights = {"hot": 0.25, "rare": 0.0004} | {f"s{k}": 0.7496 / 18 for k in range(18)}
    rows = [(s, int(w * 60_000)) for s, w in weights.items()]
    docs = spark.createDataFrame(rows, "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS k").selectExpr("xxhash64(source, k) AS doc_id", "source", "'123456789' AS text")
    got = sorted((r.slot, r.source) for r in mixing.mixture(docs, weights, block_bytes=10).where("scheduled").collect())
    given_, total = Counter(), sum(weights.values())
    assert len(got) > 59_000
    for slot, source in got:
        given_[source] += 1
        if slot % 50 == 0:
            assert all(abs(given_[k] - (slot + 1) * w / total) < 1 + 1e-6 for k, w in weights.items())


def test_caps_of_shares():
    from fractions import Fraction

    def shares(sizes, most):
        top = mixing.at_top(sorted(sizes.items(), key=lambda x: -x[1]), sum(sizes.values()), most)
        got = mixing.capped(sizes, top, most)
        return {k: Fraction(v, sum(got.values())) for k, v in got.items()}

    got = shares({"hot": 900, "a": 50, "b": 30, "c": 20}, Fraction(2, 5))
    assert got["hot"] == Fraction(2, 5) and got["a"] / got["b"] == Fraction(5, 3)
    assert shares({"a": 5, "b": 5}, Fraction(1, 2)) == {"a": Fraction(1, 2), "b": Fraction(1, 2)}
    assert set(shares({"a": 97, "b": 1, "c": 1, "d": 1}, Fraction(1, 4)).values()) == {Fraction(1, 4)}
    assert shares({"a": 6, "b": 3}, Fraction(1)) == {"a": Fraction(2, 3), "b": Fraction(1, 3)}


def test_very_many_sources(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('s', id % 25000) AS source", "repeat('x', 9) AS text")
    got = sorted((r.slot, r.source) for r in mixing.mixture(docs, block_bytes=10).collect())
    assert len({s for s, _ in got}) == 60_000 and max(Counter(s for _, s in got[:25_000]).values()) <= 2


def test_uneven_weights_keep_to_a_block(spark):
    """Weights of which no short period is a multiple, over several hundred of their periods in ten thousands."""
    weights = {"a": 0.9, "b": 0.0999, "c": 0.0001}
    docs = spark.range(100_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 9 THEN 'a' WHEN id % 1000 = 999 THEN 'c' ELSE 'b' END AS source", "repeat('x', 9) AS text")
    given_, total = Counter(), sum(weights.values())
    for slot, source in sorted((r.slot, r.source) for r in mixing.mixture(docs, weights, block_bytes=10).where("scheduled").collect()):
        given_[source] += 1
        assert all(abs(given_[k] - (slot + 1) * w / total) < 1 + 1e-6 for k, w in weights.items())
    assert sum(given_.values()) > 90_000


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 50)
    rows = [(i, "x" * 99, "hot" if i % 3 else f"s{i % 7}") for i in range(1500)] + [(5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, block_bytes=1000).collect()
    assert len(got) == len(rows) and all(r.slot is not None for r in got)
    kept = sorted((r.slot, r.source or "", r.doc_id) for r in got if r.scheduled)
    share = Counter(s for _, s, _ in kept)
    assert abs(share["hot"] / len(kept) - 0.25) < 0.02 and all(share[f"s{k}"] == sum(1 for r in rows if r[2] == f"s{k}") for k in range(7))
    assert len({s for s, _, _ in kept}) == len({(s, k) for s, k, _ in kept})  # a slot has one source


def test_blocks_grow_beyond_a_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 10)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 20)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('x', 9) AS text")
    got = [(r.source, r.block, r.slot) for r in mixing.mixture(docs).collect()]
    assert len(got) == 3000 and len(set(got)) <= 21 and {len([1 for s, b, _ in set(got) if s == k]) for k in ("s0", "s1", "s2")} == {7}


def test_mixed_keeps_every_row(spark):
    rows = [(i, "x" * 99, "hot" if i % 40 else f"s{i // 40 % 3}") for i in range(1200)] + [(5000, None, None), (None, "y", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(tuple(r) for r in mixing.mixed(docs, block_bytes=1000).collect()) == Counter(rows)
    given_ = {"hot": 1.0, "s0": 1.0, "s1": 1.0}
    assert Counter(r.source for r in mixing.mixed(docs, given_, block_bytes=1000).collect())["hot"] < 30


@pytest.fixture
def many_files(spark):
    """Tables of a dozen files and more, of which a scan reads the largest first."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12", "spark.sql.files.maxRecordsPerFile": "30"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("form", ["saved", "narrowed", "plan"])
def test_shards_follow_the_mixture(spark, tmp_path, monkeypatch, many_files, form):
    import corpus_pipeline as p

    monkeypatch.setattr(mixing, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(sharding, "NUMBERED", 20)
    r = random.Random(4)
    rows = [(i, f"{i} {'x' * r.randint(1, 300)}", "hot" if i % 3 else f"s{i % 7}", "x", "x") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string, _metadata string")
    mixed = p.mixture(spark, docs, "")
    if form != "plan":
        mixed.write.parquet(str(tmp_path / "mixed"))
        mixed = spark.read.parquet(str(tmp_path / "mixed"))
        assert len(mixed.inputFiles()) > 12 and [x.doc_id for x in mixed.collect()] != sorted(range(900))
    if form == "narrowed":
        mixed = mixed.where("doc_id >= 0").select("text", "doc_id")
    order = [i for _, i in sorted((x.slot, x.doc_id) for x in mixing.mixture(docs, most=1.0).collect())]
    got = defaultdict(dict)
    for x in p.shards(spark, mixed, "").collect():
        got[x["shard"]][x.slot] = x.doc_id
    assert len(got) == 16 and sum(map(len, got.values())) == 900
    for shard in got.values():
        assert [shard[k] for k in range(len(shard))] == [i for i in order if i in set(shard.values())]


def test_run_numbers_shards_in_the_order_of_its_mixture(spark, small, monkeypatch, many_files):
    import corpus_pipeline as p

    monkeypatch.setattr(mixing, "BLOCK_BYTES", 1000)
    want = {tuple(x) for x in p.run(spark, small).collect()}
    monkeypatch.setattr(p, "STAGES", [s for s in p.STAGES if s[0] != "mixing"])
    other = {tuple(x) for x in p.run(spark, small).collect()}
    assert {x[:4] for x in want} == {x[:4] for x in other} and want != other


def test_places_follow_the_numbers_of_files(spark, tmp_path):
    names = ["part-00002-a-c000", "part-00002-a-c001", "part-00002-a-c1000", "part-00010-a-c000", "part-99999-a-c000", "part-100000-a-c000"]
    (tmp_path / "t").mkdir()
    for k, name in enumerate(names):
        spark.range(3 * k, 3 * k + 3, 1, 1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / "t" / f"{name}.parquet")
    df = spark.read.parquet(str(tmp_path / "t"))
    part, at = scratch.place(df)
    assert [x.id for x in df.select("id", part.alias("part"), at.alias("at")).orderBy("part", "at").collect()] == list(range(18))


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = queries.table(spark, small, "documents")
    names = docs.columns
    seen = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, seen, small)
        assert after.columns == names, name
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in seen.select("doc_id").collect()}
        seen = spark.createDataFrame(after.collect(), after.schema)
    assert decontaminate.contamination(seen, queries.table(spark, small, "benchmark")).where("n_hit > 0").count() == 0
    assert near_dedup.near_duplicates(seen).where("not kept").count() == 0
    assert sorted(r.doc_id for r in p.run(spark, small).collect()) == sorted(r.doc_id for r in seen.collect())


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, name):
    sf = small.replace("0.001", "0.01")
    df = queries.queries()[name](spark, sf)
    want = duck(sf).sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    rows = sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == rows


# runs of whole lines that reach ten words, the shortest from each line on and back from it; a line goes if a run over it stands in an earlier document
REMOVED = r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(list_transform(x, lambda y: regexp_extract_all(y, '[^\x20\x09-\x0D]+'))) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, n, array_to_string(w, ' ') AS t, row_number() OVER o AS k, sum(len(w)) OVER o AS upto, sum(len(w)) OVER o - len(w) AS before FROM l WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
run AS (SELECT a.doc_id, a.k AS first, min(b.k) AS last FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.k BETWEEN a.k AND a.k + 9 AND b.upto - a.before >= 10 GROUP BY ALL
UNION SELECT a.doc_id, max(b.k), a.k FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.k BETWEEN a.k - 9 AND a.k AND a.upto - b.before >= 10 GROUP BY ALL),
said AS (SELECT r.doc_id, first, last, string_agg(t, chr(10) ORDER BY k) AS t FROM run r JOIN k ON k.doc_id = r.doc_id AND k.k BETWEEN first AND last GROUP BY ALL),
gone AS (SELECT doc_id, first, last FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS owner FROM said) WHERE owner < doc_id)
SELECT doc_id, list_sort(list(DISTINCT n)) AS removed FROM gone JOIN k USING (doc_id) WHERE k.k BETWEEN first AND last GROUP BY doc_id"""


def test_every_shared_passage_of_documents_is_found(spark, small):
    """Against all documents at once: no passage that two of them share is lost, and nothing else goes."""
    sf = small.replace("0.001", "0.01")
    want = {d: r for d, r in duck(sf).sql(REMOVED).fetchall()}
    got = {r.doc_id: r.removed for r in queries.op1_line_dedup(spark, sf).collect()}
    assert len(want) > 50 and {d: r for d, r in got.items() if r} == want


def test_passages_pair_documents_without_the_first_holder(spark):
    rows = [(1, "one two three four five six\njunk\nx1 x2 x3 x4 x5 x6"), (2, "one two three four five six\nx1 x2 x3 x4 x5 x6\nown words"), (3, "some other\none two three four five six\nx1 x2 x3 x4 x5 x6")]
    rows += [(10 + k, "\n".join(f"t{i} u{i} v{i}" for i in range(40))) for k in range(2)]
    got = {r.doc_id: (r.removed, r.owners) for r in line_dedup.shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ([], []) and got[3] == ([1, 2], [2]) and got[11] == (list(range(40)), [10])


@pytest.mark.parametrize("copies", [1000, 1001, 5000])
def test_copies_lose_the_same_however_many(spark, copies):
    text = "\n".join(" ".join(f"c{k}w{i}" for i in range(6)) for k in range(10))
    got = line_dedup.shared_lines(spark.range(copies).withColumnRenamed("id", "doc_id").withColumn("text", F.lit(text)))
    assert got.where("size(removed) = 10").count() == copies - 1 == got.where("owners = array(0L)").count()
