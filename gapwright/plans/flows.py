"""Whole runs: conversion, prediction and training."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import f1_scores, sigmoid
from ..operators import decode, evidence, losses, metrics, segments
from ..operators.preprocess import preprocess
from ..schema import HISTORY
from ..scoring import heads, network, training
from ..sources import generator, images, paths, records
from ..sources import samples as corpus
from ..storage import stored


def convert(spark: SparkSession, source: str, target: str, splits: tuple[str, ...] = ("train", "val", "test"), max_samples: int | None = None, replace: bool = False) -> DataFrame:
    """Raw splits under ``source`` to Parquet under ``target``, unless train and val have samples there; returns the counts of each split."""
    if not replace and all(corpus.has_samples(spark, target, s) for s in ("train", "val")):
        return corpus.conversion_summary(corpus.read_samples(spark, target, list(splits)))
    rows = None
    for split in splits:
        one = corpus.convert(corpus.read_split(spark, source, split, max_samples))
        rows = one if rows is None else rows.unionByName(one)
    corpus.write_samples(rows, target, True)
    return corpus.conversion_summary(corpus.read_samples(spark, target, list(splits)))


def with_image_paths(samples: DataFrame, root: str | None) -> DataFrame:
    return samples.withColumn("image_path", paths.image_path(F.col("image_path"), F.lit(root), F.col("split"), F.col("sample_id")))


def generate(spark: SparkSession, target: str, counts: dict[str, int], length: int = 256, noise: float = generator.NOISE, seed: int = 2026) -> DataFrame:
    """A labelled corpus of generated series: npz samples and drawn images by split under ``target``; returns the files written."""
    done = None
    for first, (split, n) in zip(itertools.accumulate(counts.values(), initial=0), counts.items(), strict=False):
        made = generator.labelled_samples(spark.range(first, first + n).withColumnRenamed("id", "sample_id"), length, noise, seed)
        rows = made.withColumn("sample_id", F.format_string(f"{split}_%05d", "sample_id")).select(F.lit(split).alias("split"), "sample_id", "series", "mask", "segments", "types")
        drawn = images.render(rows.select("sample_id", "series"), f"{target}/{paths.IMAGE_FOLDER}/{split}")
        drawn.write.mode("overwrite").parquet(f"{target}/rendered/{split}")
        placed = rows.join(spark.read.parquet(f"{target}/rendered/{split}").select("sample_id", "image_path"), "sample_id")
        cast = placed.select("split", "sample_id", *(F.col(c).cast("array<float>").alias(c) for c in ("series", "mask")), "segments", "types", "image_path")
        done = cast if done is None else done.unionByName(cast)
    corpus.write_npz(done, f"{target}/npz").write.mode("overwrite").parquet(f"{target}/written")
    return spark.read.parquet(f"{target}/written")


def predict(samples: DataFrame, views: DataFrame | Callable[[DataFrame], DataFrame], weights: network.Weights, size: tuple[int, int], window: int = 25, only: str | None = None) -> DataFrame:
    """PackageFrame of samples with resolved image paths. ``only`` is applied before anything is computed.

    ``views`` are joined by path, or are a function that adds ``pixels``. Evidences are stored: summaries and packages
    read them again, and each series is scored once.
    """
    chosen = samples.where(F.col("sample_id") == only) if only else samples
    prepared = preprocess(chosen.withColumn("series", F.transform("series", lambda x: x.cast("double"))), window=window)
    seen = views(prepared) if callable(views) else images.with_views(prepared, views)
    mse = losses.mean_squared(F.col("text_evidence"), F.col("image_evidence")).alias("_mse")
    scored = stored(network.score(seen, weights, size).select("sample_id", "evidences", mse), "scored")
    rows = scored.select("sample_id", F.explode("evidences").alias("e")).select("sample_id", "e.*")
    base = scored.select("sample_id", "_mse")
    return evidence.packages(evidence.complete(base, evidence.summarize(rows), F.col("_mse")))


def train_network(train: DataFrame, val: DataFrame, weights: network.Weights, settings: training.Settings, output: str) -> DataFrame:
    """Fits the network on samples with pixels; returns the HistoryFrame.

    After each epoch ``output`` holds the last and the best checkpoint (the first epoch with the
    highest event F1 on ``val``), each with the optimizer's state, and the history.
    """
    spark = train.sparkSession
    fs, base = pafs.FileSystem.from_uri(output)
    fs.create_dir(base, recursive=True)
    state, best, rows = training.fresh(weights), float("-inf"), []
    for epoch in range(1, settings.epochs + 1):
        weights, state, fitted = training.train_epoch(train, weights, state, settings, epoch)
        measured = training.validate(val, weights, settings)
        rate = settings.least_rate + (settings.rate - settings.least_rate) * training.cosine(epoch, settings.epochs)
        record = {"epoch": epoch, "lr": rate} | {f"train_{k}": v for k, v in fitted.items()} | {f"val_{k}": v for k, v in measured.items()}
        rows.append(tuple(record[c] for c in HISTORY.names))
        for name in ["last", "best"] if measured["event_f1"] > best else ["last"]:
            network.save_weights(weights, f"{output}/{name}.npz", epoch=epoch, **measured)
            training.save_state(f"{output}/{name}-state.npz", state)
        best = max(best, measured["event_f1"])
        records.write_history(spark.createDataFrame(rows, HISTORY), f"{output}/history")
    return spark.createDataFrame(rows, HISTORY)


def feature_points(prepared: DataFrame, *columns: str) -> DataFrame:
    """FeatureFrame of preprocessed samples, with 0/1 targets of their mask and segment ends."""
    n = F.size("series").cast("bigint")
    first, last = segments.boundary_targets(F.col("segments"), n)
    zipped = F.arrays_zip("features", F.col("mask"), first.alias("first"), last.alias("last"))
    p = prepared.select("sample_id", *columns, F.posexplode(zipped).alias("t", "x"))
    return p.select("sample_id", *columns, F.col("t").cast("bigint").alias("t"), *(F.col(f"x.features.{c}").alias(c) for c in heads.BASE), F.col("x.mask").cast("double").alias("mask"), F.col("x.first").alias("first"), F.col("x.last").alias("last"))


def train_heads(prepared: DataFrame) -> dict[str, object]:
    """Point, start and end heads on preprocessed, labelled samples."""
    points = heads.point_features(feature_points(prepared))
    return {name: heads.fit_points(points, target) for name, target in (("point", "mask"), ("start", "first"), ("end", "last"))}


def evaluate_heads(models: dict[str, object], prepared: DataFrame) -> DataFrame:
    """Point and event scores of trained heads: one row."""
    points = heads.point_features(feature_points(prepared))
    for name, model in models.items():
        points = heads.point_logits(model, points, f"{name}_logit")
    order = F.array_sort(F.collect_list(F.struct("t", "mask", *(f"{n}_logit" for n in models))))
    s = points.groupBy("sample_id").agg(order.alias("x"))
    s = s.select("sample_id", F.col("x.mask").alias("mask"), *(F.transform(F.col(f"x.{n}_logit"), sigmoid).alias(n) for n in models))
    s = s.withColumns({"truth": segments.mask_segments(F.col("mask")), "found": decode.refined_segments(F.col("point"), F.col("start"), F.col("end"))})
    s = s.select(metrics.point_counts(F.col("point"), F.col("mask")).alias("p"), metrics.event_counts(F.col("found"), F.col("truth")).alias("e"))
    names = ("precision", "recall", "f1")
    point, event = (f1_scores(*(F.sum(f"{k}.{c}") for c in ("tp", "fp", "fn"))) for k in "pe")
    return s.agg(*(c.alias(f"point_{n}") for n, c in zip(names, point, strict=True)), *(c.alias(f"event_{n}") for n, c in zip(names, event, strict=True)))
