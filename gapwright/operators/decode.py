"""Scores to intervals, and pooling over points and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cut, expected_coordinate, first_max
from ..functions.scalar import let_all, sigmoid, softplus, window_bounds, window_radius
from .segments import binary_segments

#: the logit of a step that is padding
PADDING = -1e4


def masked_logits(logits: Column, valid: Column) -> Column:
    return F.zip_with(logits, valid, lambda x, v: F.when(v > 0, x).otherwise(F.lit(PADDING)))


def probabilities(logits: Column) -> Column:
    return F.transform(logits, sigmoid)


def refined_segments(point: Column, start: Column, end: Column, threshold: float = 0.5, min_length: int = 1) -> Column:
    """Runs of the point probabilities, each from its first best start to its first best end."""

    def of(point: Column, start: Column, end: Column) -> Column:
        def refine(s: Column) -> Column:
            a = s["start"] + first_max(cut(start, s["start"], s["end"]))
            b = s["start"] + first_max(cut(end, s["start"], s["end"]))
            return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))

        return F.transform(binary_segments(point, threshold, min_length), refine)

    return let_all((point, start, end), of)


def localized_interval(start_prob: Column, end_prob: Column, start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """Expected first and last place near the ends of a run."""
    radius = window_radius(start, end)
    return expected_coordinate(start_prob, *window_bounds(start, radius, n)), expected_coordinate(end_prob, *window_bounds(end, radius, n))


def predicted_intervals(point: Column, start: Column, end: Column, threshold: float = 0.5, min_length: int = 1) -> Column:
    """Real-valued intervals of the runs of the point probabilities, in order."""
    def of(point: Column, start: Column, end: Column) -> Column:
        n = F.size(point).cast("bigint")

        def locate(s: Column) -> Column:
            return let_all(localized_interval(start, end, s["start"], s["end"], n), lambda a, b: F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end")))

        return F.transform(binary_segments(point, threshold, min_length), locate)

    return let_all((point, start, end), of)


def pooled(hidden: DataFrame, groups: list[str]) -> DataFrame:
    """Mean of the vectors ``h`` in each group, dimension by dimension; map-side sums, no vector is collected."""
    parts = hidden.select(*groups, F.posexplode("h").alias("d", "x")).groupBy(*groups, "d").agg(F.avg("x").alias("x"))
    return parts.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("h"))


def masked_mean(hidden: DataFrame, valid: Column) -> DataFrame:
    """Mean over the valid steps of a sample."""
    return pooled(hidden.where(valid), ["sample_id"])


def pool_segments(hidden: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean over the steps of each segment (sample_id, k, start, end): an interval join under an equal sample."""
    inside = hidden.join(segments, "sample_id").where(F.col("t").between(F.col("start"), F.col("end")))
    return pooled(inside, ["sample_id", "k"])


def argmax(a: Column) -> Column:
    return first_max(a)


def evidence_activations(confidence_logit: Column, attributes: Column) -> tuple[Column, Column]:
    return sigmoid(confidence_logit), F.transform(attributes, softplus)
