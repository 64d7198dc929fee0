"""Evidence records, summaries and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import TYPES, type_name


def evidence_list(evidences: Column) -> Column:
    """Records of evidences (start, end, type, confidence, length, peak_amplitude, mean_deviation), by (start, end)."""

    def record(e: Column) -> Column:
        attributes = F.struct(e["length"].cast("int").alias("length"), e["peak_amplitude"].alias("peak_amplitude"), e["mean_deviation"].alias("mean_deviation"))
        return F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["type"].cast("int").alias("type"), type_name(e["type"]).alias("type_name"), e["confidence"].alias("confidence"), attributes.alias("attributes"))

    return F.transform(F.array_sort(evidences), record)


def summarize(evidences: DataFrame) -> DataFrame:
    """One row a sample of an EvidenceFrame; samples without evidence come in through :func:`packages`."""
    last = F.max_by("end", F.struct("start", "end"))
    span = F.greatest(last - F.min("start") + 1, F.lit(1)).cast("double")
    counts = [F.count_if(F.col("type") == i).alias(f"count_{t}") for i, t in enumerate(TYPES)]
    return evidences.groupBy("sample_id").agg(
        F.count("*").alias("anomaly_count"), F.avg("length").alias("average_segment_length"), *counts, (F.sum("length") / span).alias("continuity_degree"), F.max("confidence").alias("max_confidence"),
        F.collect_list(F.struct("start", "end", "type", "confidence", "length", "peak_amplitude", "mean_deviation")).alias("evidences"),
    )


def complete(samples: DataFrame, summary: DataFrame, divergence: Column | None = None) -> DataFrame:
    """Summary columns of every sample; those without evidence have zeros."""
    zero = lambda c, kind="double": F.coalesce(F.col(c), F.lit(0)).cast(kind)
    n = F.greatest(F.coalesce("anomaly_count", F.lit(0)), F.lit(1)).cast("double")
    joined = samples.join(summary, "sample_id", "left")
    return joined.select(
        *samples.columns, zero("anomaly_count", "bigint").alias("anomaly_count"), zero("average_segment_length").alias("average_segment_length"),
        *(zero(f"count_{t}", "bigint").alias(f"count_{t}") for t in TYPES), *((zero(f"count_{t}") / n).alias(f"ratio_{t}") for t in TYPES),
        zero("continuity_degree").alias("continuity_degree"), F.when(F.col("anomaly_count") > 0, 1.0 - F.col("continuity_degree")).otherwise(0.0).alias("fragmentation_degree"),
        zero("max_confidence").alias("max_confidence"), (F.lit(0.0) if divergence is None else F.coalesce(divergence, F.lit(0.0))).alias("text_image_divergence"), "evidences",
    )


#: order of the summary vector
Q = ("anomaly_count", "average_segment_length", *(f"ratio_{t}" for t in TYPES), "continuity_degree", "fragmentation_degree", "max_confidence", "text_image_divergence")


def packages(summaries: DataFrame) -> DataFrame:
    """PackageFrame (id, evidence, summary, q) of completed summaries."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,type:bigint,confidence:double,length:bigint,peak_amplitude:double,mean_deviation:double>>")
    kinds = F.struct(*(F.struct(F.col(f"count_{t}").cast("int").alias("count"), F.col(f"ratio_{t}").alias("ratio")).alias(t) for t in TYPES))
    summary = F.struct(F.col("anomaly_count").cast("int").alias("anomaly_count"), "average_segment_length", kinds.alias("type_distribution"), "continuity_degree", "fragmentation_degree", "max_confidence", "text_image_divergence")
    return summaries.select(F.col("sample_id").cast("string").alias("id"), evidence_list(F.coalesce("evidences", none)).alias("evidence"), summary.alias("summary"), F.array(*(F.col(c).cast("double") for c in Q)).alias("q"))
