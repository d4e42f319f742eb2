"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, line_dedup, mixing, near_dedup, pii, quality, sharding, token_count, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def bench(spark):
    rows = [(1, "zzz " * 12), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "word1 word2"), (5, "Word3 word4 word5")]
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(6, 3, 1), (7, 1, 0), (8, 0, None), (None, 0, 1), (1, 1, 0), (1, 1, 1), (12, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "lines": lambda spark, d: line_dedup.shared_lines(d),
    "without lines": lambda spark, d: line_dedup.without_shared_lines(d).select("doc_id", "text", "lang", "source", "n_chars"),
    "near": lambda spark, d: near_dedup.near_duplicates(d),
    "deduplicated": lambda spark, d: near_dedup.deduplicated(d).select("doc_id", "text", "lang", "source", "n_chars"),
    "contamination": lambda spark, d: decontaminate.contamination(d, bench(spark)),
    "decontaminated": lambda spark, d: decontaminate.decontaminated(d, bench(spark)).select("doc_id", "text", "lang", "source", "n_chars"),
    "quality": lambda spark, d: quality.judged(d),
    "good": lambda spark, d: quality.good_documents(d).select("doc_id", "text", "lang", "source", "n_chars"),
    "tokens": lambda spark, d: token_count.token_counts(d, MODEL),
    "shards": lambda spark, d: sharding.sharded(d, 4).select("doc_id", "size", "text_crc32", "shard"),
    "toxicity": lambda spark, d: toxicity.scores(d, toxicity.train(d, labels(spark))),
    "pii": lambda spark, d: pii.find(d),
    "sanitised": lambda spark, d: pii.sanitised(d),
    "mixture": lambda spark, d: mixing.mixture(d, block_bytes=400),
    "mixed": lambda spark, d: mixing.mixed(d, block_bytes=400).select("doc_id", "text", "lang", "source", "n_chars"),
}
ALL_ROWS = {"lines", "without lines", "near", "contamination", "quality", "tokens", "shards", "toxicity", "pii", "sanitised", "mixture"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_inputs(spark, odd, clashing, nothing, name):
    run = OPERATORS[name]
    got = [str(r) for r in run(spark, odd).collect()]
    if name in ALL_ROWS:
        assert len(got) == odd.count()
    assert Counter(got) == Counter(str(r) for r in run(spark, clashing).collect())
    assert run(spark, nothing).count() == 0


def test_defined_results(spark, odd):
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 56, 1, True), (2, 56, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (12, 1, 6, False), (10, 59997, 9, False), (None, 56, None, False)} <= near
    hit = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(odd, bench(spark)).collect()}
    assert hit[1] == (60, 3, [5]) and hit[6] == (1, 1, [4]) and hit[3] == (0, 0, [])
    lines = {r.doc_id: (r.n_lines, r.removed, r.owners) for r in line_dedup.shared_lines(odd).collect()}
    assert lines[1] == (1, [], []) and lines[2] == (1, [0], [1]) and lines[8] == (3, [2], [1]) and lines[3] == (0, [], [])
    clean = {r.doc_id: r.text for r in decontaminate.decontaminated(odd, bench(spark)).collect()}
    assert clean[1].split()[2:5] == ["word2", "word6", "word7"] and clean[3] is None and 6 not in clean
    tokens = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.token_counts(odd, MODEL).collect()}
    assert tokens[3] == tokens[4] == (0, 0)


def test_chat_odd(spark):
    rows = [(1, 0, "user", None), (1, 0, None, ""), (1, None, "assistant", "x"), (1, None, "assistant", "x"), (None, 3, "a\n\\n", "<|im_end|>\\")]
    turns = chat.table_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 and got[None].n_turns == 1
    assert chat.digests(chat.formatted(turns.where(F.lit(False)))).count() == 0
    with pytest.raises(ValueError):
        chat.table_turns(turns.drop("turn"))


@pytest.mark.parametrize("case", ["odd", "clashing", "nothing"])
def test_pipeline_odd(spark, odd, clashing, nothing, tmp_path, case):
    import corpus_pipeline as p

    docs = {"odd": odd, "clashing": clashing, "nothing": nothing}[case]
    good = " ".join(f"good{i}" for i in range(70))
    docs = docs.unionByName(spark.createDataFrame([(50, good, "en", "b", 9), (51, f"{good} almost", "en", "b", 9), (52, None, None, None, None)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema), allowMissingColumns=True) if case != "nothing" else docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = seen.columns
    for name, stage in p.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == names, name
        seen = spark.createDataFrame(seen.collect(), seen.schema)
    kept = sorted(r.doc_id for r in seen.collect())
    assert kept == ([] if case == "nothing" else [1, 9, 50])  # 2 is a copy, 10 and 51 are near ones, 8 repeats itself, the others are too short or have no text
    assert sorted(r.doc_id for r in p.run(spark, str(tmp_path)).collect()) == kept


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from folioflow.llm import scratch

    conf = SimpleNamespace(get=lambda key, default=None: default)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(far)


def test_arrow_batches_are_bounded_by_bytes(spark):
    """Wide rows come in batches of 64 MiB at most (Spark's own bound), whatever the number of rows."""
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 1 << 26

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    wide = spark.range(0, 300, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    got = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 290_000_000 and max(got) < 80_000_000
