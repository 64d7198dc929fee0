"""Series, masks and embeddings read from the star-schema tables.

``events`` of a user are a series: ``t`` is the place by time, ``v`` the value, and an ``error``
event is an anomalous point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PointFrame: sample_id, t, n, v, mask. One exchange on the sample."""
    # named before the windows: an alias above them would hide that the rows are already dealt
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "sample_id")
    sample = Window.partitionBy("sample_id")
    return events.select(
        "sample_id",
        (F.row_number().over(sample.orderBy("ts", "event_id")) - 1).cast("bigint").alias("t"),
        F.count("*").over(sample).alias("n"),
        F.col("value").alias("v"),
        (F.col("event_type") == "error").cast("double").alias("mask"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SampleFrame: sample_id, n, series, mask; arrays in time order. One exchange on the sample."""
    event = F.struct("ts", "event_id", "value", (F.col("event_type") == "error").cast("double").alias("mask"))
    grouped = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id")).agg(F.array_sort(F.collect_list(event)).alias("e"))
    return grouped.select("sample_id", F.size("e").cast("bigint").alias("n"), F.col("e.value").alias("series"), F.col("e.mask").alias("mask"))


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors as the two views of a sample: sample_id, text, image."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("sample_id"), (F.col("vec_id") % 2).alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    grouped = e.groupBy("sample_id").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("text"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("image"))
    return grouped.where("text IS NOT NULL AND image IS NOT NULL")


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label in id order as hidden states: sample_id, t, n, h."""
    label = Window.partitionBy("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("sample_id"), (F.row_number().over(label.orderBy("vec_id")) - 1).cast("bigint").alias("t"), F.count("*").over(label).alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("h")
    )
