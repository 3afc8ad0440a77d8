"""Queries over whole tables, one for each operator. Importing this module registers nothing elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm import divergence, fingerprint, langid, merkle, mixing, neardup, packing, quality, records, secrets, substrings, topk, vectordup
from duewise.llm.common import read_table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.withColumn("position", F.round("position", 6))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op5_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(read_table(spark, sf_dir, "documents"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(read_table(spark, sf_dir, "documents"))


def op9_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated_words(read_table(spark, sf_dir, "documents"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(read_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op13_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_fingerprints, op3_kneser_ney_quality, op4_secret_scan, op5_hyperminhash_dedup, op6_exact_top_k, op7_language_id,
        op8_token_records, op9_de_bruijn_dedup, op10_best_two_fit, op11_merkle_manifest, op12_source_divergence, op13_projection_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE, "op6_exact_top_k": topk.ORACLE, "op11_merkle_manifest": merkle.ORACLE,
    "op12_source_divergence": divergence.ORACLE, "op13_projection_dedup": vectordup.ORACLE,
}
