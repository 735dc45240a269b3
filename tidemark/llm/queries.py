"""The queries of this subpackage: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chroma, language, metric_join, mixing, packing, page_text, quality, simhash, token_counts, token_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.recording_report(table(spark, sf_dir, "conversations"))


def op2_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chroma": op1_chroma,
    "op2_metric_join": op2_metric_join,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_token_store": op8_token_store,
    "op9_mixing": op9_mixing,
    "op10_page_text": op10_page_text,
}

ORACLE_SQL: dict[str, str] = {"op2_metric_join": metric_join.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
