"""Losses as masked aggregates: per-series sums in arrays, then one grouped aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import mean, resample, total
from ..functions.scalar import bce_with_logits, center_gap, interval_iou, let, let_all, map_coordinate, smooth_l1
from .decode import localized_interval

TIE = 1e-6


@dataclass(frozen=True)
class LossWeights:
    point: float = 1.0
    seg: float = 1.0
    type: float = 1.0
    evidence: float = 0.5
    bc: float = 1.0
    cons: float = 0.2
    tv: float = 0.05


def masked_mean(value: Column, valid: Column) -> Column:
    """Aggregate: mean of ``value`` where ``valid`` counts; 0 without any."""
    return F.coalesce(F.sum(value * valid), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(valid), F.lit(0.0)), F.lit(1.0))


def masked_bce(logit: Column, target: Column, valid: Column) -> Column:
    return masked_mean(bce_with_logits(logit, target), valid)


def bce_sum(logits: Column, targets: Column) -> Column:
    """Sum over one series."""
    return total(F.zip_with(logits, targets, bce_with_logits))


def segment_interval_terms(start_prob: Column, end_prob: Column, segments: Column, n: Column) -> Column:
    """For each true segment, how far the expected ends near it are off."""

    def of(start: Column, end: Column, segments: Column, n: Column) -> Column:
        def term(s: Column) -> Column:
            a, b = localized_interval(start, end, s["start"], s["end"], n)
            return F.abs(a - s["start"]) + F.abs(b - s["end"])

        return F.transform(segments, term)

    return let_all((start_prob, end_prob, segments, n), of)


def cross_entropy(logits: Column, target: Column) -> Column:
    top = F.array_max(logits)
    return let(top, lambda m: F.log(total(F.transform(logits, lambda x: F.exp(x - m)))) + m) - F.get(logits, target.cast("int"))


def attribute_loss(values: Column, targets: Column) -> Column:
    return mean(F.zip_with(values, targets, lambda x, y: smooth_l1(x - y)))


def mean_squared(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def variation(prob: Column) -> Column:
    """Sum of absolute steps."""
    n = F.size(prob)
    return total(F.zip_with(F.slice(prob, 1, F.greatest(n - 1, F.lit(0))), F.slice(prob, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(b - a)))


def warp_to_source(values: Column, kind: Column, source: Column) -> Column:
    """A resampled sequence back on the source axis; any other is as it was."""
    return F.when(kind == "resample", resample(values, source)).otherwise(values)


def intervals_to_source(intervals: Column, target: Column, source: Column) -> Column:
    return F.transform(intervals, lambda i: F.struct(map_coordinate(i["start"], target, source).alias("start"), map_coordinate(i["end"], target, source).alias("end")))


def match_intervals(origin: Column, warped: Column) -> Column:
    """Greedy monotone pairs (origin, warped): places of each origin interval and its best remaining candidate.

    The best has the highest IoU, near ties going to the smaller center gap; the next search starts
    behind it. A candidate without overlap still matches.
    """
    return let_all((origin, warped), _matched)


def _matched(origin: Column, warped: Column) -> Column:
    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<origin:int,warped:int>>").alias("pairs"))

    def best(o: Column, first: Column) -> Column:
        start = F.struct(F.lit(-1).alias("i"), F.lit(-1.0).alias("iou"), F.lit(float("inf")).alias("gap"))

        def look(acc: Column, i: Column) -> Column:
            c = F.get(warped, i)
            fit = F.struct(i.alias("i"), interval_iou(o["start"], o["end"], c["start"], c["end"]).alias("iou"), center_gap(o["start"], o["end"], c["start"], c["end"]).alias("gap"))
            return let(fit, lambda f: F.when((f["iou"] > acc["iou"]) | ((F.abs(f["iou"] - acc["iou"]) <= TIE) & (f["gap"] < acc["gap"])), f).otherwise(acc))

        left = F.filter(F.sequence(F.lit(0), F.greatest(F.size(warped) - 1, F.lit(0))), lambda i: (i >= first) & (i < F.size(warped)))
        return F.aggregate(left, start, look)

    def step(acc: Column, k: Column) -> Column:
        def take(b: Column) -> Column:
            pair = F.struct(k.alias("origin"), b["i"].alias("warped"))
            more = F.struct((b["i"] + 1).alias("next"), F.concat(acc["pairs"], F.array(pair)).alias("pairs"))
            return F.when(b["i"] >= 0, more).otherwise(acc)

        return let(best(F.get(origin, k), acc["next"]), take)

    order = F.filter(F.sequence(F.lit(0), F.greatest(F.size(origin) - 1, F.lit(0))), lambda i: i < F.size(origin))
    return F.aggregate(order, zero, step, lambda acc: acc["pairs"])


def pair_distance(origin: Column, warped: Column, pairs: Column) -> Column:
    """Sum over pairs of how far both ends are apart."""
    gap = lambda a, b: F.abs(a["start"] - b["start"]) + F.abs(a["end"] - b["end"])
    return let_all((origin, warped), lambda o, w: total(F.transform(pairs, lambda p: gap(F.get(o, p["origin"]), F.get(w, p["warped"])))))


def anchored_terms(start: Column, end: Column, warped_start: Column, warped_end: Column, segments: Column, n: Column) -> Column:
    """For each true segment, how far the expected ends of both branches are apart."""

    def of(start: Column, end: Column, warped_start: Column, warped_end: Column, segments: Column, n: Column) -> Column:
        def term(s: Column) -> Column:
            a, b = localized_interval(start, end, s["start"], s["end"], n)
            c, d = localized_interval(warped_start, warped_end, s["start"], s["end"], n)
            return F.abs(a - c) + F.abs(b - d)

        return F.transform(segments, term)

    return let_all((start, end, warped_start, warped_end, segments, n), of)


def mask_distance(prob: Column, warped: Column) -> Column:
    return mean(F.zip_with(prob, warped, lambda a, b: F.abs(a - b)))


def weighted_total(w: LossWeights, point: Column, seg: Column, type_: Column, evidence: Column, bc: Column, cons: Column, tv: Column) -> Column:
    return w.point * point + w.seg * seg + w.type * type_ + w.evidence * evidence + w.bc * bc + w.cons * cons + w.tv * tv
