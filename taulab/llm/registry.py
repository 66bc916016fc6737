"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, language, licenses, lines, minhash, mixing, periodic, quality, resampling, sharding, toxicity, warc
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHashParams(width=3, percent=85))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_groups(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items", "near_items")


def op4_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.near_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")).drop("n_words")


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("archive", "url", "intact")


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_decontaminate": op4_decontaminate,
        "op4_near_matches": op4_near_matches,
        "op5_quality_rules": op5_quality_rules,
        "op6_license_scan": op6_license_scan,
        "op7_sharding": op7_sharding,
        "op8_mix_sources": op8_mix_sources,
        "op9_html_text": op9_html_text,
        "op10_language_id": op10_language_id,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_warc_archives": op13_warc_archives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op4_near_matches": decontaminate.NEAR_SQL,
        "op5_quality_rules": quality.ORACLE_SQL,
        "op6_license_scan": licenses.ORACLE_SQL,
        "op12_importance_resampling": resampling.ORACLE_SQL,
        "op13_warc_archives": warc.ORACLE_SQL,
    }
