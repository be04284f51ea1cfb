"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontaminate, html_main, jaccard, media, mixing, sharding, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digit(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that a model may learn from."""
    return labels.where(_digit(4) != 2)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int"))
    return url_filter.filter_urls(pages.select("page_id", "url", fetched.alias("fetched_at")), url_filter.dated_list(pages))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.with_copies(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.format_conversations(chat.with_forged(_table(spark, sf_dir, "conversations"))))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, learnable(_table(spark, sf_dir, "labels")))
    rows = toxicity.scored(docs, model)
    return rows.select("doc_id", F.coalesce(_digit(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_digit(5) == 1, F.lit(False)).alias("held_out"))
    return ctw.score_documents(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filters, op2_mixing, op3_ngram_jaccard, op4_sharding, op5_decontamination, op6_chat_formatting, op7_media_columns, op8_html_extraction, op9_toxicity, op10_lm_scoring]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filter.ORACLE_SQL, "op2_mixing": mixing.ORACLE_SQL}
