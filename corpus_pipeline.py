"""From documents to shards: quality rules, near-duplicates, benchmark passages, mixture, shards.

Every stage but the last returns the columns of documents, whatever further ones there are. Null and empty texts fail the quality rules, so they end there, as do
rows without an id; rows that repeat an id end in the second stage, which keeps one. Null languages and sources are groups of their own. An empty table gives an empty result.
The mixture is the order of the rows that its stage returns: the last stage numbers each shard's rows in it, so that shards read from their first rows on hold sources in their shares throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, mixing, near_dedup, quality, sharding
from folioflow.llm.scratch import saved

#: Neither thresholds from sketches nor a likelihood over registers nor differencing is SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None
#: Target weights of the sources in the mixture, as {source: weight}; None keeps every document, at its source's natural share.
WEIGHTS: dict[str | None, float] | None = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.good_documents(docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicated(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a schedule that spreads each source evenly; with WEIGHTS, those that the weights have room for."""
    return mixing.mixed(docs, WEIGHTS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard of sixteen and its place there, in the order of docs."""
    return sharding.sharded(docs, 16, in_order=True)


STAGES = [("quality", rules), ("near_duplicates", duplicates), ("decontamination", benchmarks), ("mixing", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
