"""Joins in which no key can overload a task, whatever share of the rows it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys that may be hot at once; the rows broadcast for them are at most as many
HOT_KEYS = 10_000
#: rows of a few numbers that may be broadcast; more are shuffled
SMALL = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast where its counted rows are at most SMALL. For rows of a few numbers."""
    return F.broadcast(df) if df.count() <= SMALL else df


def meet(many: DataFrame, few: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``many`` joined ("inner" or "left") with ``few``, which has one row a key and counts the key's rows of ``many`` in ``weight``.

    Keys of more than 1 / HOT_KEYS of the counted rows are fewer than HOT_KEYS; these are
    broadcast, so their rows stay where they are. The others are shuffled. Both tables are read
    twice, so they should be stored.
    """
    bound = (few.agg(F.sum(weight)).head()[0] or 0) // HOT_KEYS
    hot, rest = few.where(F.col(weight) > bound).drop(weight), few.where(F.col(weight) <= bound).drop(weight)
    there = many.join(F.broadcast(hot), on)
    others = many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return there.unionByName(others)
