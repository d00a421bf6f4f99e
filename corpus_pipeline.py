"""A corpus in five stages; each reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm import decontamination, mixing, quality, sharding, simhash
from braidwork.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: each document as often as the mix takes it; those it doesn't take go."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the rows, each with its shard and slot."""
    return sharding.sharded(docs)


STAGES = [("quality classifier", good_quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left, with shard and slot. Nulls, ties and repeated rows as each stage's operator says; an
    empty table passes through all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs


#: The classifier, the alignment and the tree can't be said in SQL.
ORACLE_SQL = None
