"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafline.llm import oracle
from leafline.llm.common import table
from leafline.llm.decontaminate import contamination_digest, decontaminate
from leafline.llm.license_scan import license_digest, license_scan
from leafline.llm.lm_score import lm_scores
from leafline.llm.near_dedup import near_duplicates
from leafline.llm.packing import pack, packing_digest
from leafline.llm.pii import pii_digest, pii_spans
from leafline.llm.preferences import format_preferences, preference_digest, variant_endings
from leafline.llm.quality_rules import quality_rules
from leafline.llm.secret_scan import secret_digest, secret_scan
from leafline.llm.suffix_dedup import repeated, repeated_bytes_digest


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.drop("char_distance", "word_distance")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan(table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(pii_spans(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(pack(table(spark, sf_dir, "documents")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes_digest(repeated(table(spark, sf_dir, "documents")))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(table(spark, sf_dir, "documents")))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_digest(format_preferences(variant_endings(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_license_scan": op2_license_scan,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_packing": op4_packing,
        "op5_preferences": op5_preferences,
        "op6_secret_scan": op6_secret_scan,
        "op7_near_dedup": op7_near_dedup,
        "op8_pii": op8_pii,
        "op9_lm_score": op9_lm_score,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracle.quality_rules_sql(),
        "op2_license_scan": oracle.license_scan_sql(),
        "op3_suffix_dedup": oracle.repeated_bytes_sql(),
        "op5_preferences": oracle.preferences_sql(),
        "op6_secret_scan": oracle.secret_scan_sql(),
        "op10_decontamination": oracle.decontamination_sql(),
    }
