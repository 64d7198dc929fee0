"""Runs of flagged points: islands, masks and boundary maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import runs
from ..functions.scalar import let

#: a labelled point is anomalous above, a predicted one from this value on
THRESHOLD = 0.5


def labelled(mask: Column) -> Column:
    return mask > THRESHOLD


def predicted(prob: Column, threshold: float = THRESHOLD) -> Column:
    return prob >= threshold


def islands(points: DataFrame, flag: Column, min_length: int = 1) -> DataFrame:
    """SegmentFrame (sample_id, k, start, end) of the runs of ``flag``; k counts the runs of a sample that are long enough.

    The difference of place and rank names a run, so the grouping stays in the sample's partition.
    """
    by_sample = Window.partitionBy("sample_id")
    flagged = points.where(flag).withColumn("grp", F.col("t") - F.row_number().over(by_sample.orderBy("t")))
    found = flagged.groupBy("sample_id", "grp").agg(F.min("t").alias("start"), F.max("t").alias("end")).where(F.col("end") - F.col("start") + 1 >= min_length)
    return found.select("sample_id", (F.row_number().over(by_sample.orderBy("start")) - 1).cast("bigint").alias("k"), "start", "end")


def mask_segments(mask: Column) -> Column:
    """Inclusive runs of a label mask, as an array; empty for a normal sample."""
    return runs(F.transform(mask, labelled))


def binary_segments(prob: Column, threshold: float = THRESHOLD, min_length: int = 1) -> Column:
    """Inclusive runs of a probability array that are ``min_length`` long or longer."""
    return F.filter(runs(F.transform(prob, lambda p: predicted(p, threshold))), lambda s: s["end"] - s["start"] + 1 >= min_length)


def exploded(samples: DataFrame, segments: str = "segments") -> DataFrame:
    """A row per segment: the other columns, k, start, end."""
    rest = [c for c in samples.columns if c != segments]
    return samples.select(*rest, F.posexplode(segments).alias("k", "_s")).select(*rest, F.col("k").cast("bigint").alias("k"), "_s.start", "_s.end")


def segments_to_mask(segments: Column, n: Column) -> Column:
    """A 0/1 mask of ``n`` points."""
    at = F.sequence(F.lit(0).cast("bigint"), n - 1)
    return let(segments, lambda g: F.transform(at, lambda t: F.exists(g, lambda s: t.between(s["start"], s["end"])).cast("double")))


def boundary_targets(segments: Column, n: Column) -> tuple[Column, Column]:
    """0/1 maps of the first and of the last points of segments."""
    at = F.sequence(F.lit(0).cast("bigint"), n - 1)
    marks = lambda field: let(segments[field], lambda g: F.transform(at, lambda t: F.array_contains(g, t).cast("double")))
    return marks("start"), marks("end")
