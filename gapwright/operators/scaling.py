"""Per-series scaling as windows over PointFrame: one exchange serves all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EPS

def _sample():
    return Window.partitionBy("sample_id")


def _in_order():
    return _sample().orderBy("t")


def zscore(points: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Adds mean, sd and z. ``anchors`` (sample_id, mean, sd) freezes the scale where it has a row."""
    own = points.withColumns({"mean": F.avg("v").over(_sample()), "sd": F.stddev_pop("v").over(_sample())})
    if anchors is not None:
        a = anchors.select("sample_id", F.col("mean").alias("_m"), F.col("sd").alias("_s"))
        own = own.join(a, "sample_id", "left").withColumns({"mean": F.coalesce("_m", "mean"), "sd": F.coalesce("_s", "sd")}).drop("_m", "_s")
    return own.withColumn("z", (F.col("v") - F.col("mean")) / (F.col("sd") + EPS))


def normalized_index(points: DataFrame) -> DataFrame:
    return points.withColumn("t_norm", F.col("t") / F.greatest(F.col("n") - 1, F.lit(1)))


def first_difference(points: DataFrame) -> DataFrame:
    return points.withColumn("delta", F.col("v") - F.coalesce(F.lag("v").over(_in_order()), F.col("v")))


def local_zscore(points: DataFrame, window: int = 25) -> DataFrame:
    half = max(window // 2, 1)
    near = _in_order().rowsBetween(-half, half)
    return points.withColumn("local_z", (F.col("v") - F.avg("v").over(near)) / (F.stddev_pop("v").over(near) + EPS))
