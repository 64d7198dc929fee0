"""Synthetic labelled series with parameters that follow from the sample id."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import TYPES

SEASON, SLOPE, NOISE = 48.0, 0.002, 0.08


def base_series(samples: DataFrame, length: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds ``series``: a season, a trend, and normal noise (Box-Muller on hashes of seed, sample and place)."""
    t = F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))

    def value(i: Column) -> Column:
        clean = F.sin(2.0 * pi * i / SEASON) + SLOPE * i
        if not noise:
            return clean
        u = lambda k: (F.pmod(F.xxhash64("sample_id", i, F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        return clean + noise * F.sqrt(-2.0 * F.log(u(0))) * F.cos(2.0 * pi * u(1))

    return samples.withColumn("series", F.transform(t, value))


def inject(series: Column, kind: Column, start: Column, duration: Column, size: Column) -> tuple[Column, Column, Column]:
    """The series with one anomaly, its first and its last point. ``size`` in [0, 1) sets the strength in the kind's range."""
    last = F.least(F.size(series).cast("bigint") - 1, start + duration - 1)
    point = kind == TYPES.index("point")
    first, end = F.when(point, start + F.floor(duration / 2)).otherwise(start), F.when(point, start + F.floor(duration / 2)).otherwise(last)
    span = F.greatest(last - start, F.lit(1))

    def add(x: Column, i: Column) -> Column:
        change = (
            F.when(kind == 0, 2.5 + size)
            .when(kind == 1, 0.8 * F.sin(2.0 * pi * (i - start) / 8.0))
            .when(kind == 2, (1.5 + 1.5 * size) * (i - start) / span)
            .when(kind == 3, 1.5 + 0.7 * size)
            .otherwise(F.raise_error(F.concat(F.lit("unsupported anomaly type: "), kind.cast("string"))).cast("double"))
        )
        return F.when(i.between(first, end), x + change).otherwise(x)

    return F.transform(series, add), first, end


def labelled_samples(samples: DataFrame, length: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds series, mask, segments, types and type; one anomaly a sample, begun in [40, length - 80)."""
    if length <= 120:
        raise ValueError("a labelled series needs more than 120 points")
    s = F.col("sample_id")
    draw = lambda a, m: (s * a + seed) % m
    out, first, last = inject(F.col("series"), F.col("type"), 40 + draw(7919, length - 120), 8 + draw(104729, 24), draw(1299709, 1000) / 1000.0)
    made = base_series(samples, length, noise, seed).withColumn("type", draw(31, len(TYPES)).cast("bigint"))
    made = made.withColumns({"_first": first, "_last": last, "series": out})
    mask = F.transform("series", lambda x, t: t.between(F.col("_first"), F.col("_last")).cast("double"))
    return made.withColumns({"mask": mask, "segments": F.array(F.struct(F.col("_first").alias("start"), F.col("_last").alias("end"))), "types": F.array("type")}).drop("_first", "_last")
