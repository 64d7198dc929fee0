"""Series to model features: scale, period, decomposition, and the augmented branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import acf_period, deseasonalize, deviation, mean, project_period, resample, smooth, standardize, temporal_features
from ..functions.scalar import half_even, let, let_all

#: fixed values: transform kinds in the order they are drawn from
KINDS = ("scale", "shift", "resample", "style", "smooth")
LEAST_LENGTH = 8
PARTS = ("mean", "sd", "z", "period")


def preprocess(samples: DataFrame, series: str = "series", period: Column | None = None, center: Column | None = None, scale: Column | None = None, window: int = 25) -> DataFrame:
    """Adds mean, sd, z, period, deseason and features (array of structs). Given anchors and period are used as they are."""
    def scaled(x: Column, m: Column, d: Column) -> Column:
        def found(z: Column, p: Column) -> Column:
            return F.struct(m.alias("mean"), d.alias("sd"), z.alias("z"), p.alias("period"))

        return let(standardize(x, m, d), lambda z: let_all((z, acf_period(z) if period is None else period), found))

    def anchored(x: Column) -> Column:
        return let_all((x, mean(x) if center is None else center, deviation(x) if scale is None else scale), scaled)

    # one expression a row for what belongs together; the rest is pruned where it isn't used
    out = samples.withColumn("_pre", let(F.col(series), anchored)).select(*(c for c in samples.columns if c not in PARTS), *(F.col(f"_pre.{c}").alias(c) for c in PARTS))
    return out.withColumn("deseason", deseasonalize(F.col("z"), F.col("period"))).withColumn("features", temporal_features(F.col("deseason"), window))


def draw(sample_id: Column) -> Column:
    """A number in [0, 1) of a sample, the same on every engine and run."""
    return (sample_id * 7919 % 1000) / 1000.0


def augmented(samples: DataFrame, ratio: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """Adds ``transform`` (kind, source_length, target_length) and ``aug_series``: one transform a sample that keeps its meaning."""
    u, s = draw(F.col("sample_id")), F.col("series")
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("sample_id") % len(KINDS)).cast("int"))
    n = F.size(s).cast("bigint")
    length = F.greatest(F.lit(LEAST_LENGTH).cast("bigint"), half_even(n * (ratio[0] + (ratio[1] - ratio[0]) * u)))
    out = samples.withColumn("transform", F.struct(kind.alias("kind"), n.alias("source_length"), F.when(kind == "resample", length).otherwise(n).alias("target_length")))
    k = F.col("transform.kind")
    value = (
        F.when(k == "scale", F.transform(s, lambda x: x * (0.85 + 0.3 * u)))
        .when(k == "shift", F.transform(s, lambda x: x + (-0.25 + 0.5 * u)))
        .when(k == "resample", resample(s, F.col("transform.target_length")))
        .when(k == "smooth", smooth(s))
        .otherwise(s)
    )
    return out.withColumn("aug_series", value)


def augmented_features(samples: DataFrame, window: int = 25) -> DataFrame:
    """Preprocessed samples and their augmented branch, which keeps the mean, the deviation and the (projected) period of its original."""
    plain = augmented(preprocess(samples, window=window))
    t = F.col("transform")
    period = F.when(t["kind"] == "resample", project_period(F.col("period"), t["source_length"], t["target_length"])).otherwise(F.col("period"))
    branch = let_all((F.col("aug_series"), F.col("mean"), F.col("sd"), period), lambda x, m, d, p: F.struct(p.alias("aug_period"), deseasonalize(standardize(x, m, d), p).alias("aug_deseason")))
    out = plain.withColumn("_aug", branch).select("*", "_aug.*").drop("_aug")
    return out.withColumn("aug_features", temporal_features(F.col("aug_deseason"), window))
