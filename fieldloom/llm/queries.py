"""The queries of this subpackage, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, jaccard, licenses, lm, media, mixing, packing, quality, spans, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(_table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_repeats(_table(spark, sf_dir, "documents"), counts=True)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_media_columns, op2_license_scan, op3_nearest_neighbours, op4_packing, op5_quality,
        op6_mixing, op7_language_model, op8_toxicity, op9_ngram_jaccard_join, op10_substring_dedup,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.ORACLE, "op6_mixing": mixing.ORACLE, "op9_ngram_jaccard_join": jaccard.ORACLE}
