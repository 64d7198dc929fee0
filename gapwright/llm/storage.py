"""Tables that operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import discard, remove, shared_dir, stored

__all__ = ["discard", "remove", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
