"""Decoding-parameter maps: tolerant JSON parsing and key filtering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_params(c, strict: bool = False) -> Column:
    """JSON object text -> ``map<string,string>``. Missing, empty or invalid text gives
    an empty map; ``strict`` fails the query instead."""
    opts = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE"}
    m = F.from_json(_col(c), "map<string,string>", opts)
    if strict:
        return m
    return F.coalesce(m, F.create_map().cast("map<string,string>"))


def filter_params(c, allowed=None) -> Column:
    """Keep the keys a predictor accepts; ``allowed=None`` (an open signature) keeps all."""
    m = _col(c)
    if allowed is None:
        return m
    acc = F.array(*[F.lit(a) for a in allowed])
    return F.map_filter(m, lambda k, v: F.array_contains(acc, k))


def dropped_params(c, allowed=None) -> Column:
    """Sorted keys that ``filter_params`` would drop."""
    m = _col(c)
    if allowed is None:
        return F.array().cast("array<string>")
    acc = F.array(*[F.lit(a) for a in allowed])
    return F.array_sort(F.array_except(F.map_keys(m), acc))
