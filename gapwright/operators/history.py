"""Epoch records: best epoch, learning rate, merging and switches."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VISIBLE = 1e-12


def best_epoch(history: DataFrame, metric: str = "val_event_f1") -> DataFrame:
    """The first epoch with the highest metric."""
    return history.orderBy(F.desc(metric), "epoch").limit(1)


def cosine_rate(epoch: Column, epochs: int, rate: float, least: float) -> Column:
    """The rate recorded after ``epoch`` steps of a cosine schedule."""
    return least + (rate - least) * (1.0 + F.cos(pi * epoch / epochs)) / 2.0


def merge_epochs(train: DataFrame, val: DataFrame) -> DataFrame:
    """One record an epoch with train_ and val_ columns."""
    named = lambda df, side: df.withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c not in ("epoch", "lr")})
    return named(train, "train").join(named(val, "val"), "epoch")


def bc_visible(history: DataFrame) -> DataFrame:
    """Whether the boundary-consistency curve has anything to show."""
    return history.agg(F.coalesce(F.bool_or(F.abs("train_bc") > VISIBLE), F.lit(False)).alias("include_bc"))
