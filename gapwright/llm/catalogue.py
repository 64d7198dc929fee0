"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fixity, language_id, line_dedup, merge_dropout, near_dups, pii, quality_rules, token_files, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.query,
    "op2_line_dedup": line_dedup.query,
    "op3_quality_rules": quality_rules.query,
    "op4_pii": pii.query,
    "op5_warc_fixity": fixity.query,
    "op6_merge_dropout": merge_dropout.query,
    "op7_language_id": language_id.query,
    "op8_decontaminate": decontaminate.query,
    "op9_near_dups": near_dups.query,
    "op10_url_filter": url_filter.query,
    "pii_base": pii.base_query,
    "url_rules": url_filter.rules_query,
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op5_warc_fixity": fixity.ORACLE_SQL, "pii_base": pii.BASE_SQL, "url_rules": url_filter.RULES_SQL}
