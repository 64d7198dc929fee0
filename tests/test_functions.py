"""Hand cases of the scalar, taxonomy and array functions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.functions import arrays as A
from gapwright.functions import scalar as C
from gapwright.functions import taxonomy
from gapwright.operators import decode, losses, metrics, segments, targets
from gapwright.operators.preprocess import preprocess


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def arr(*values):
    return F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")


def big(x):
    return F.lit(x).cast("bigint")


def intervals(*pairs, kind="double"):
    if not pairs:
        return F.array().cast(f"array<struct<start:{kind},end:{kind}>>")
    return F.array(*(F.struct(F.lit(a).cast(kind).alias("start"), F.lit(b).cast(kind).alias("end")) for a, b in pairs))


@pytest.mark.parametrize(("mask", "want"), [([0, 1, 1, 0, 1], [(1, 2), (4, 4)]), ([0, 0], []), ([1, 1], [(0, 1)]), ([0.5, 0], [])])
def test_mask_segments(spark, mask, want):
    got = [tuple(s) for s in one(spark, segments.mask_segments(arr(*mask)))]
    assert got == want
    assert one(spark, segments.segments_to_mask(segments.mask_segments(arr(*mask)), big(len(mask)))) == [float(m > 0.5) for m in mask]


def test_probability_threshold_is_inclusive(spark):
    assert [tuple(s) for s in one(spark, segments.binary_segments(arr(0.5, 0.4)))] == [(0, 0)]
    assert one(spark, segments.binary_segments(arr(0.5, 0.4), min_length=2)) == []


@pytest.mark.parametrize(("raw", "want"), [(" Frequency ", "freq"), ("level", "range"), ("trend", "trend"), ("\tPOINT\n", "point"), ("other", "other")])
def test_canonical_name(spark, raw, want):
    assert one(spark, taxonomy.canonical_name(F.lit(raw))) == want


@pytest.mark.parametrize(("i", "want"), [(3, "range"), (7, "7"), (-1, "-1"), (0, "point")])
def test_type_name(spark, i, want):
    assert one(spark, taxonomy.type_name(F.lit(i))) == want


def test_resolve_types(spark):
    names = lambda *n: F.array(*map(F.lit, n))
    assert one(spark, taxonomy.resolve_types(names("trend"), big(2), F.lit("level"))) == [3, 3]
    assert one(spark, taxonomy.resolve_types(names("trend", "nonsense"), big(2), F.lit("freq"))) == [2, 1]
    assert one(spark, taxonomy.resolve_types(F.lit(None).cast("array<string>"), big(1), F.lit("point"))) == [0]
    with pytest.raises(Exception, match="unknown anomaly type"):
        one(spark, taxonomy.resolve_types(names("trend"), big(2), F.lit("nonsense")))


def test_scaling(spark):
    assert one(spark, A.deviation(arr(1, 1, 1))) == 0 and one(spark, A.standardize(arr(1, 1, 1), F.lit(1.0), F.lit(0.0))) == [0, 0, 0]
    f = one(spark, A.temporal_features(arr(0, 0, 3), 3))
    want = [0.0, (0 - 1) / (math.sqrt(2) + 1e-6), 1.5 / (1.5 + 1e-6)]
    assert np.allclose([x.local_z for x in f], want) and [x.t_norm for x in f] == [0, 0.5, 1]
    assert [x.delta for x in one(spark, A.temporal_features(arr(2, 5, 4)))] == [0, 3, -1]
    assert [x.t_norm for x in one(spark, A.temporal_features(arr(4)))] == [0]


def test_period(spark):
    assert one(spark, A.acf_period(arr(*[5] * 10))) == 2
    wave = [math.sin(2 * math.pi * t / 12) for t in range(96)]
    assert one(spark, A.acf_period(arr(*wave))) == 12
    with pytest.raises(Exception, match="at least 4"):
        one(spark, A.acf_period(arr(1, 2, 3)))
    assert one(spark, A.project_period(F.lit(5), F.lit(100), F.lit(90))) == 4


def decomposed(z, p):
    n, h = len(z), p // 2
    trend = np.full(n, np.nan)
    for t in range(h, n - h):
        w = np.ones(2 * h + 1)
        if p % 2 == 0:
            w[0] = w[-1] = 0.5
        trend[t] = (z[t - h : t + h + 1] * w).sum() / p
    last = n - 1 - h
    for lo, hi, fill in ((h, min(h + p, last), range(h)), (max(h, last - p), last, range(last + 1, n))):
        m = np.vstack([np.arange(lo, hi), np.ones(hi - lo)]).T
        k = np.linalg.lstsq(m, trend[lo:hi], rcond=None)[0]
        for t in fill:
            trend[t] = k[0] * t + k[1]
    phase = np.array([(z - trend)[j::p].mean() for j in range(p)])
    return trend, z - (phase - phase.mean())[np.arange(n) % p]


@pytest.mark.parametrize(("n", "p"), [(4, 2), (20, 5), (31, 6), (64, 12), (9, 4)])
def test_decomposition(spark, n, p):
    z = np.random.default_rng(n).normal(size=n) + np.sin(np.arange(n) * 2 * np.pi / p)
    trend, rest = decomposed(z, p)
    assert np.allclose(one(spark, A.trend(arr(*z), F.lit(p))), trend) and np.allclose(one(spark, A.deseasonalize(arr(*z), F.lit(p))), rest)
    assert abs(sum(one(spark, A.seasonal(arr(*z), F.lit(p))))) < 1e-9


def test_decomposition_needs_two_periods(spark):
    with pytest.raises(Exception, match="two full periods"):
        one(spark, A.deseasonalize(arr(1, 2, 3, 4, 5), F.lit(3)))


def test_resampling(spark):
    assert one(spark, A.smooth(arr(5, 0, 0, 0, 0))) == [3, 2, 1, 0, 0]
    assert one(spark, A.resample(arr(0, 10), big(3))) == [0, 5, 10]
    x = np.random.default_rng(3).normal(size=37)
    assert np.allclose(one(spark, A.resample(arr(*x), big(50))), np.interp(np.linspace(0, 1, 50), np.linspace(0, 1, 37), x))
    assert one(spark, C.map_coordinate(F.lit(9.0), big(10), big(19))) == 18 and one(spark, C.map_coordinate(F.lit(5.0), big(1), big(10))) == 0
    there = C.map_coordinate(F.lit(4.0), big(11), big(21))
    assert one(spark, C.map_coordinate(there, big(21), big(11))) == pytest.approx(4)
    with pytest.raises(ValueError, match="odd"):
        A.smooth(arr(1), 4)


@pytest.mark.parametrize(("s", "e", "want"), [(0, 9, 2), (0, 13, 4), (0, 0, 2), (0, 17, 4)])
def test_window_radius(spark, s, e, want):
    assert one(spark, C.window_radius(big(s), big(e))) == want


def test_evidence_target(spark):
    t = one(spark, targets.evidence_targets(arr(9, -2, 1, 9), big(1), big(2)))
    assert (t.peak, t.meandev) == (2, 1.5) and t.conf == pytest.approx(1 - math.exp(-1.75))


def test_overlaps(spark):
    assert one(spark, C.segment_iou(big(0), big(4), big(4), big(8))) == pytest.approx(1 / 9) and one(spark, C.segment_iou(big(0), big(1), big(3), big(4))) == 0
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, C.interval_iou(*lit(0, 4, 4, 8))) == 0 and one(spark, C.interval_iou(*lit(2, 2, 2, 2))) == 0 and one(spark, C.interval_iou(*lit(0, 4, 2, 6))) == pytest.approx(1 / 3)


def test_event_counts(spark):
    got = one(spark, metrics.event_counts(intervals((0, 4), kind="bigint"), intervals((0, 4), (10, 12), kind="bigint")))
    assert tuple(got) == (1, 0, 1)
    assert tuple(one(spark, metrics.event_counts(intervals(kind="bigint"), intervals(kind="bigint")))) == (0, 0, 0)
    # two predictions on one event: the second is false
    assert tuple(one(spark, metrics.event_counts(intervals((0, 1), (3, 4), kind="bigint"), intervals((0, 4), kind="bigint")))) == (1, 1, 0)
    p, r, f = (one(spark, c) for c in C.f1_scores(F.lit(1), F.lit(0), F.lit(1)))
    assert (p, r) == (1, 0.5) and f == pytest.approx(2 / 3)


def greedy(origin, warped):
    iou = lambda a, b: 0.0 if max(a[1], b[1]) - min(a[0], b[0]) <= 0 else max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))
    out, first = [], 0
    for i, o in enumerate(origin):
        best = (None, -1.0, math.inf)
        for j in range(first, len(warped)):
            f, g = iou(o, warped[j]), abs(sum(o) / 2 - sum(warped[j]) / 2)
            if f > best[1] or (abs(f - best[1]) <= 1e-6 and g < best[2]):
                best = (j, f, g)
        if best[0] is None:
            break
        out.append((i, best[0]))
        first = best[0] + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_match_intervals(spark, seed):
    rng = np.random.default_rng(seed)
    make = lambda n: [(float(a), float(a + rng.integers(0, 9))) for a in np.sort(rng.integers(0, 60, n))]
    o, w = make(rng.integers(0, 5)), make(rng.integers(0, 5))
    assert [tuple(p) for p in one(spark, losses.match_intervals(intervals(*o), intervals(*w)))] == greedy(o, w)


def test_a_pair_without_overlap_still_matches(spark):
    assert [tuple(p) for p in one(spark, losses.match_intervals(intervals((0, 1)), intervals((8, 9))))] == [(0, 0)]


def test_refined_segments(spark):
    got = one(spark, decode.refined_segments(arr(0.9, 0.9, 0.1), arr(0.7, 0.7, 0.9), arr(0.2, 0.8, 0.9)))
    assert [tuple(s) for s in got] == [(0, 1)]
    swapped = one(spark, decode.refined_segments(arr(0.9, 0.9), arr(0.1, 0.7), arr(0.8, 0.2)))
    assert [tuple(s) for s in swapped] == [(0, 1)]


def test_losses(spark):
    assert one(spark, losses.cross_entropy(arr(1, 2, 3), F.lit(2))) == pytest.approx(math.log(1 + math.exp(-1) + math.exp(-2)))
    assert one(spark, losses.attribute_loss(arr(0, 3), arr(0.5, 0))) == pytest.approx((0.125 + 2.5) / 2)
    assert one(spark, losses.variation(arr(0, 1, 0.5))) == 1.5 and one(spark, losses.variation(arr(1))) == 0
    assert one(spark, losses.mean_squared(arr(1, 2), arr(3, 2))) == 2
    assert one(spark, C.softplus(F.lit(-1000.0))) == 0 and one(spark, C.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, A.expected_coordinate(arr(0, 1, 3), big(0), big(2))) == pytest.approx(1.75)


def test_order_of_rows_does_not_matter(spark):
    rows = [(i, [float((i * 7 + t * t) % 11) for t in range(24)]) for i in range(6)]
    a, b = (preprocess(spark.createDataFrame(r, "sample_id long, series array<double>")).select("sample_id", "deseason").collect() for r in (rows, rows[::-1]))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
