"""Scalar formulas as columns. All compute in double; rounding is half-even where an index is derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
COUNT_EPS = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once a row: a one-element lambda binds it."""
    return F.transform(F.array(value), body)[0]


def let_all(values: tuple[Column, ...], body: Callable[..., Column]) -> Column:
    """``body`` of several values, each evaluated once a row.

    Without it an array that a lambda refers to may be computed again for each element, once the
    optimizer has put its expression there.
    """
    names = [f"_{i}" for i in range(len(values))]
    return let(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))), lambda s: body(*(s[n] for n in names)))


def r6(x: Column) -> Column:
    """Rounded to 6 decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def smooth_l1(d: Column) -> Column:
    """Huber loss with a bend at 1."""
    return F.when(F.abs(d) < 1.0, 0.5 * d * d).otherwise(F.abs(d) - 0.5)


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def window_radius(start: Column, end: Column) -> Column:
    """A quarter of the run's length, 2 at least."""
    return F.greatest(F.lit(2).cast("bigint"), half_even((end - start + 1) * 0.25))


def window_bounds(center: Column, radius: Column, n: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0).cast("bigint"), center - radius), F.least(n - 1, center + radius)


def map_coordinate(x: Column, source: Column, target: Column) -> Column:
    """A 0-based coordinate on an axis of ``source`` points, on one of ``target`` points."""
    scaled = x * ((target - 1) / F.greatest(source - 1, F.lit(1)))
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), (target - 1).cast("double"))
    return F.when((source <= 1) | (target <= 1), F.lit(0.0)).when(source == target, x.cast("double")).otherwise(clipped)


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over hull of real intervals; 0 for an empty hull."""
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    both = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.when(hull <= 0, F.lit(0.0)).otherwise(both / F.when(hull <= 0, F.lit(1.0)).otherwise(hull))


def segment_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common over covered points of inclusive integer runs."""
    both = F.greatest(F.lit(0).cast("bigint"), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)
    covered = (a_end - a_start + 1) + (b_end - b_start + 1) - both
    return both / F.greatest(covered, F.lit(1).cast("bigint"))


def center_gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.abs((a_start + a_end) / 2.0 - (b_start + b_end) / 2.0)


def f1_scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 with guarded denominators."""
    tp, fp, fn = (c.cast("double") for c in (tp, fp, fn))
    precision = tp / F.greatest(tp + fp, F.lit(COUNT_EPS))
    recall = tp / F.greatest(tp + fn, F.lit(COUNT_EPS))
    return precision, recall, 2.0 * precision * recall / F.greatest(precision + recall, F.lit(COUNT_EPS))
