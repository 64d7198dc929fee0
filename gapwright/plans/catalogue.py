"""Queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import io_queries, queries
from .oracle import FINAL, ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {name: getattr(queries, name) for name in FINAL} | io_queries.QUERIES | {"evidence_package": queries.package}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.package(spark, sf_dir)
