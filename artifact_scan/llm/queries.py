"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from artifact_scan.llm import chat, decontamination, jaccard_join, licenses, mixing, quality, sharding, substring_dedup, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_url_filters": url_filters.op5_url_filters,
    "url_aliases": url_filters.url_aliases,
    "op6_mixing": mixing.op6_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scans": licenses.oracle_sql(),
        "op5_url_filters": url_filters.ORACLE_SQL,
        "url_aliases": url_filters.ALIASES_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
        "op7_sharding": sharding.ORACLE_SQL,
        "op8_chat_formatting": chat.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    }
