"""Whole-series kernels over array columns: no shuffle, one pass a series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import EPS, half_even, let, let_all

ZERO = 0.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda s, x: s + x)


#: elements whose running sums are taken in one go; sums cost some CHUNK steps an element
CHUNK = 64


def prefix(a: Column) -> Column:
    """The sums of the elements before each place, and of all: one more than ``a`` has.

    Sums grow by chunks, so that an array isn't copied once for each of its elements.
    """
    kind = "struct<at:double,out:array<double>>"
    zero = F.struct(F.lit(ZERO).alias("at"), F.array().cast("array<double>").alias("out"))
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(kind)

    def of(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / CHUNK).cast("int"), F.lit(1)) - 1), lambda k: F.aggregate(F.slice(v, k * CHUNK + 1, CHUNK), zero, add))
        return let(chunks, joined)

    def joined(parts: Column) -> Column:
        whole = F.aggregate(parts, zero, lambda acc, p: add(acc, p["at"]))
        return let(whole, lambda b: F.concat(F.flatten(F.zip_with(parts, b["out"], lambda p, x: F.transform(p["out"], lambda y: x + y))), F.array(b["at"])))

    return let(a, of)


def window_sum(sums: Column, first: Column, last: Column) -> Column:
    """The sum of the elements ``first`` to ``last`` (inclusive), from their :func:`prefix`."""
    return F.get(sums, (last + 1).cast("int")) - F.get(sums, first.cast("int"))


def mean(a: Column) -> Column:
    return total(a) / F.greatest(F.size(a), F.lit(1))


def indices(n: Column) -> Column:
    """0 to n - 1 as bigint; none for n = 0."""
    return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint") - 1))


def cut(a: Column, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last`` (0-based, inclusive)."""
    return F.slice(a, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m)))))


def standardize(a: Column, center: Column, scale: Column) -> Column:
    return let_all((center, scale), lambda m, d: F.transform(a, lambda x: (x - m) / (d + EPS)))


def first_max(a: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def runs(flags: Column) -> Column:
    """Inclusive (start, end) of the runs of true, in order; empty if there are none."""

    def of(f: Column) -> Column:
        at = indices(F.size(f))
        starts = F.filter(at, lambda i: F.get(f, i.cast("int")) & ~F.coalesce(F.get(f, i.cast("int") - 1), F.lit(False)))
        ends = F.filter(at, lambda i: F.get(f, i.cast("int")) & ~F.coalesce(F.get(f, i.cast("int") + 1), F.lit(False)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    return let(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), of)


def acf_period(series: Column, shortest: int = 2, longest: int = 256) -> Column:
    """The lag of the first highest autocorrelation among ``shortest`` to max(min(n / 2, longest), 3).

    A constant series, whose autocorrelation is 0/0, has period ``shortest``.
    """

    def of(x: Column) -> Column:
        n = F.size(x)
        lags = F.sequence(F.lit(shortest), F.greatest(F.least(F.floor(n / 2).cast("int"), F.lit(longest)), F.lit(3)))
        power = total(F.transform(x, lambda v: v * v))
        score = let(power, lambda p: F.transform(lags, lambda k: F.round(total(F.zip_with(F.slice(x, 1, n - k), F.slice(x, k + 1, n - k), lambda a, b: a * b)) / F.when(p > 0, p).otherwise(F.lit(1.0)), 10)))
        return (first_max(score) + shortest).cast("int")

    def centred(z: Column) -> Column:
        return let(mean(z), lambda m: let(F.transform(z, lambda v: v - m), of))

    checked = F.when(F.size(series) < 4, F.raise_error(F.lit("a period needs at least 4 points")).cast("array<double>")).otherwise(series)
    return let(checked, lambda s: let(F.struct(mean(s).alias("m"), deviation(s).alias("d")), lambda c: let(standardize(s, c["m"], c["d"]), centred)))


def _line(t0: Column, ys: Column) -> Column:
    """Slope and intercept of the least-squares line through (t0 + i, y_i); through one point the one of least norm."""
    m = F.size(ys).cast("double")
    at = F.transform(ys, lambda y, i: (t0 + i).cast("double"))

    def of(ts: Column) -> Column:
        st, sy = total(ts), total(ys)
        sxx = total(F.transform(ts, lambda t: t * t)) - st * st / m
        sxy = total(F.zip_with(ts, ys, lambda t, y: t * y)) - st * sy / m
        slope = F.when(F.size(ys) < 2, sy * st / (st * st + 1.0)).otherwise(sxy / F.when(F.size(ys) < 2, F.lit(1.0)).otherwise(sxx))
        return let(slope, lambda b: F.struct(b.alias("slope"), F.when(F.size(ys) < 2, sy / (st * st + 1.0)).otherwise((sy - b * st) / m).alias("base")))

    return let(at, of)


def trend(z: Column, period: Column) -> Column:
    """Centred moving average over one period (half weights at both ends of an even one), extended by lines fitted to its first and last period."""
    n, h = F.size(z).cast("bigint"), F.floor(period / 2).cast("bigint")
    even = period % 2 == 0
    ends = lambda t: F.when(even, 0.5 * (F.get(z, (t - h).cast("int")) + F.get(z, (t + h).cast("int")))).otherwise(0.0)
    inner = let(prefix(z), lambda sums: F.transform(F.sequence(h, n - 1 - h), lambda t: (window_sum(sums, t - h, t + h) - ends(t)) / period))

    def extended(y: Column) -> Column:
        # the last point of the average takes no part in either fit
        front = F.slice(y, 1, F.least(period, F.size(y) - 1))
        first = F.greatest(F.size(y) - 1 - period, F.lit(0))
        back = F.slice(y, first + 1, F.size(y) - 1 - first)

        def join(lines: Column) -> Column:
            head = F.transform(indices(h), lambda t: lines["f"]["slope"] * t + lines["f"]["base"])
            tail = F.transform(indices(h), lambda i: lines["b"]["slope"] * (n - h + i) + lines["b"]["base"])
            return F.concat(head, y, tail)

        return let(F.struct(_line(h, front).alias("f"), _line(h + first, back).alias("b")), join)

    return let(inner, extended)


def seasonal(z: Column, period: Column) -> Column:
    """Mean-centred phase means of ``z`` less its trend, one value a phase."""

    def of(rest: Column) -> Column:
        last, step = F.size(rest).cast("bigint") - 1, period.cast("bigint")
        # each point is met once, by its own phase
        sum_of = lambda j: F.aggregate(F.sequence(j, last, step), F.lit(ZERO), lambda s, i: s + F.get(rest, i.cast("int")))
        phase = F.transform(indices(period), lambda j: sum_of(j) / (F.floor((last - j) / step) + 1))
        return let(phase, lambda a: let(mean(a), lambda m: F.transform(a, lambda x: x - m)))

    return let(trend(z, period), lambda tr: let(F.zip_with(z, tr, lambda a, b: a - b), of))


def deseasonalize(z: Column, period: Column) -> Column:
    """``z`` less its seasonal part; the trend stays. Shorter than two periods is an error."""

    def of(given: Column) -> Column:
        x, p = given["z"], given["p"]
        whole = F.when(F.size(x) < 2 * p, F.raise_error(F.lit("a decomposition needs two full periods")).cast("array<double>")).otherwise(seasonal(x, p))
        return let(whole, lambda s: F.transform(x, lambda v, t: v - F.get(s, (t % p).cast("int"))))

    return let(F.struct(z.alias("z"), period.alias("p")), of)


def project_period(period: Column, source: Column, target: Column) -> Column:
    return F.least(F.greatest(half_even(period * target / source), F.lit(2).cast("bigint")), F.greatest(F.floor(target / 2), F.lit(2).cast("bigint"))).cast("int")


def local_z(a: Column, window: int = 25) -> Column:
    """Each value against the mean and deviation of its neighbours, ``max(window / 2, 1)`` on either side, fewer at the ends."""
    half = max(window // 2, 1)

    def of(v: Column, centre: Column) -> Column:
        # sums of squares lose least about the mean
        c = F.transform(v, lambda x: x - centre)
        return let(c, lambda x: let_all((x, prefix(x), prefix(F.transform(x, lambda y: y * y))), scored))

    def scored(x: Column, sums: Column, squares: Column) -> Column:
        n = F.size(x)

        def one(y: Column, t: Column) -> Column:
            first, last = F.greatest(t - half, F.lit(0)), F.least(t + half, n - 1)
            k = last - first + 1
            m = window_sum(sums, first, last) / k
            return let(m, lambda m: (y - m) / (F.sqrt(F.greatest(window_sum(squares, first, last) / k - m * m, F.lit(ZERO))) + EPS))

        return F.transform(x, one)

    return let_all((a, mean(a)), of)


def temporal_features(a: Column, window: int = 25) -> Column:
    """(t_norm, value, delta, local_z) of each point."""

    def of(v: Column) -> Column:
        n = F.size(v)
        near = local_z(v, window)
        place = lambda t: t / F.greatest(n - 1, F.lit(1))
        return let(near, lambda z: F.transform(v, lambda x, t: F.struct(place(t).alias("t_norm"), x.alias("deseason"), (x - F.coalesce(F.get(v, t - 1), x)).alias("delta"), F.get(z, t).alias("local_z"))))

    return let(a, of)


def resample(a: Column, m: Column) -> Column:
    """Linear interpolation on ``m`` points with both ends kept."""

    def of(v: Column) -> Column:
        n = F.size(v)

        def lerp(x: Column) -> Column:
            lo = F.floor(x).cast("int")
            hi = F.least(lo + 1, n - 1)
            return F.get(v, lo) + (x - lo) * (F.get(v, hi) - F.get(v, lo))

        return F.transform(indices(m), lambda j: let(j * (n - 1) / F.greatest(m - 1, F.lit(1)), lerp))

    return let(a, of)


def smooth(a: Column, kernel: int = 5) -> Column:
    """Box average over an odd kernel, end values repeated beyond the ends."""
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    half = kernel // 2
    box = lambda v, t: sum((F.get(v, F.least(F.greatest(t + o, F.lit(0)), F.size(v) - 1)) for o in range(-half, half + 1)), F.lit(0.0)) / float(kernel)
    return let(a, lambda v: F.transform(v, lambda x, t: box(v, t)))


def expected_coordinate(prob: Column, left: Column, right: Column) -> Column:
    """Mean place under the weights of ``prob`` from ``left`` to ``right`` (inclusive)."""
    return let(cut(prob, left, right), lambda p: total(F.transform(p, lambda x, i: x * i)) / F.greatest(total(p), F.lit(EPS)) + left)


def pad(a: Column, size: Column, value: Column) -> Column:
    return F.concat(a, F.array_repeat(value, F.greatest(size - F.size(a), F.lit(0)).cast("int")))
