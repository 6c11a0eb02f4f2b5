"""Named queries over the tables of a data folder, one for each operator, and SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe,
    decontamination,
    fingerprints,
    language_id,
    licenses,
    manifest,
    mixing,
    nearest,
    pages,
    periodic,
    preferences,
    simhash,
    token_counts,
)
from tidemark.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.match_next(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.paired_completions(table(spark, sf_dir, "conversations"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_language_id,
        op2_token_counts,
        op3_nearest_neighbours,
        op4_fingerprints,
        op5_license_scan,
        op6_source_mix,
        op7_simhash,
        op8_main_text,
        op9_preferences,
        op10_byte_bpe,
        op11_manifest,
        op12_periodic_runs,
        op13_decontamination,
    )
}

ORACLES = {
    "op6_source_mix": mixing.SQL,
    "op9_preferences": preferences.SQL,
    "op11_manifest": manifest.SQL,
    "op13_decontamination": decontamination.SQL,
}
