"""Trainable scorers on Spark's own learners.

Point, start and end heads are logistic regressions on a point's features and its neighbours'; the
type head is a multinomial one on a segment's means; attributes are linear regressions. This is
not the network of :mod:`gapwright.scoring.network` and is not fitted by gradient steps over epochs.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE = ("t_norm", "deseason", "delta", "local_z")
REACH = 3


def point_features(features: DataFrame) -> DataFrame:
    """FeatureFrame with each value's neighbours within REACH steps; beyond the ends a value repeats."""
    w = Window.partitionBy("sample_id").orderBy("t")
    out = features
    for name in BASE[1:]:
        for o in range(1, REACH + 1):
            out = out.withColumns({f"{name}_m{o}": F.coalesce(F.lag(name, o).over(w), F.col(name)), f"{name}_p{o}": F.coalesce(F.lead(name, o).over(w), F.col(name))})
    return out


def point_columns() -> list[str]:
    return [*BASE, *(f"{n}_{s}{o}" for n in BASE[1:] for o in range(1, REACH + 1) for s in "mp")]


def fit_points(points: DataFrame, target: str, max_iter: int = 30) -> PipelineModel:
    """A head for a 0/1 column of point features."""
    learner = LogisticRegression(featuresCol="x", labelCol=target, maxIter=max_iter, regParam=1e-3, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y")
    return Pipeline(stages=[VectorAssembler(inputCols=point_columns(), outputCol="x"), learner]).fit(points)


def point_logits(model: PipelineModel, points: DataFrame, name: str) -> DataFrame:
    return model.transform(points).withColumn(name, vector_to_array("_raw")[1]).drop("x", "_p", "_raw", "_y")


def segment_features(features: DataFrame, segments: DataFrame) -> DataFrame:
    """Means and extremes of the features inside each segment (sample_id, k, start, end)."""
    inside = features.join(segments, "sample_id").where(F.col("t").between(F.col("start"), F.col("end")))
    stats = [f(c).alias(f"{c}_{n}") for c in BASE[1:] for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return inside.groupBy("sample_id", "k", "start", "end").agg(*stats, F.count("*").cast("double").alias("length"))


def segment_columns() -> list[str]:
    return [*(f"{c}_{n}" for c in BASE[1:] for n in ("mean", "max", "min")), "length"]


def fit_types(segments: DataFrame, target: str = "type", max_iter: int = 30) -> PipelineModel:
    learner = LogisticRegression(featuresCol="x", labelCol=target, maxIter=max_iter, regParam=1e-3, family="multinomial")
    return Pipeline(stages=[VectorAssembler(inputCols=segment_columns(), outputCol="x"), learner]).fit(segments)


def fit_attribute(segments: DataFrame, target: str) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=segment_columns(), outputCol="x"), LinearRegression(featuresCol="x", labelCol=target, regParam=1e-3)]).fit(segments)
