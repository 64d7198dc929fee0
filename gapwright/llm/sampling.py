"""Bounded samples that are the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest_hashes(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """min(``most``, all) rows, those with the lowest hashes of ``columns``, in that order.

    A bound on the hash first leaves some twice as many rows as wanted, so that not each task sends
    its own ``most`` rows to be merged. Where equal rows or a hot key leave fewer, the bound is
    widened until it leaves enough or is gone: it never changes the result.
    """
    h = F.xxhash64(*columns)
    n, wanted = rows.count(), 2 * most
    while wanted < n:
        low = rows.where(h < -(2**63) + 2**64 * wanted // n)
        if low.limit(most).count() >= most:
            rows = low
            break
        wanted *= 8
    return rows.orderBy(h, *columns).limit(most)
