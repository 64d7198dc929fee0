"""Anomaly types: names, aliases and ids."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: ids are places in this order
TYPES = ("point", "freq", "trend", "range")
#: fixed values: other names in use
ALIASES = {"frequency": "freq", "level": "range"}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def canonical_name(name: Column) -> Column:
    """Trimmed of all white space, lower-cased, aliases resolved; unknown names pass through."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(name, r"^\s+", ""), r"\s+$", ""))
    return F.coalesce(F.try_element_at(_literal_map(ALIASES), plain), plain)


def type_name(type_id: Column) -> Column:
    """The name of an id, or the id as text when out of range."""
    known = F.get(F.array(*map(F.lit, TYPES)), type_id.cast("int"))
    return F.when(type_id.between(0, len(TYPES) - 1), known).otherwise(type_id.cast("string"))


def type_id(name: Column) -> Column:
    """The id of a name in any spelling; null when unknown."""
    return F.try_element_at(_literal_map({t: i for i, t in enumerate(TYPES)}), canonical_name(name)).cast("bigint")


def resolve_types(events: Column, n_segments: Column, default: Column) -> Column:
    """Ids of ``n_segments`` segments: the events' own where there are as many, else the default's.

    An unknown event name takes the default; an unknown default is an error.
    """
    fallback = F.coalesce(type_id(default), F.raise_error(F.concat(F.lit("unknown anomaly type: "), default)).cast("bigint"))
    own = F.transform(events, lambda e: F.coalesce(type_id(e), fallback))
    return F.when(F.coalesce(F.size(events), F.lit(-1)) == n_segments, own).otherwise(F.array_repeat(fallback, n_segments.cast("int")))
