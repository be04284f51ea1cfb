"""A corpus pipeline: toxic texts go, one of each group of near copies stays, contaminated texts go, sources are mixed, shards are dealt.

Each stage works on all rows that the one before it kept and returns the columns of documents; the last
adds the shard and the slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorweave.llm import decontaminate, jaccard, mixing, queries, sharding, toxicity
from factorweave.llm.scratch import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, toxicity.trained(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs).select(*docs.columns, "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None
