"""Histories, summaries and predictions as JSON."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HISTORY


def write_history(history: DataFrame, path: str) -> None:
    """One JSON document with all epochs in order; a row an epoch, so one file is right."""
    record = F.struct(*history.columns)
    history.agg(F.array_sort(F.collect_list(record)).alias("history")).coalesce(1).write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """HistoryFrame of a history document; one without epochs is an error."""
    rows = spark.read.schema(f"history array<{HISTORY.simpleString()}>").json(path, multiLine=True)
    checked = rows.select(F.when(F.size("history") > 0, F.col("history")).otherwise(F.raise_error(F.lit("the history is empty")).cast(f"array<{HISTORY.simpleString()}>")).alias("history"))
    return checked.select(F.explode("history").alias("h")).select("h.*")


def run_summary(config: dict[str, Any], best_epoch: int, best: float, epochs: int) -> dict[str, Any]:
    return {"finished_at": datetime.now(UTC).isoformat(), "epochs": epochs, "best_epoch": best_epoch, "best_event_f1": best, "config": config}


def write_predictions(packages: DataFrame, path: str) -> None:
    """A line a package, in as many files as there are partitions."""
    packages.write.mode("overwrite").json(path)
