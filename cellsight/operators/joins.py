"""Joins that treat null keys as equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys with null equal to null; the key columns of `left` are kept.

    Without keys the right side is the one row of a whole-table aggregate.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right.limit(1)))
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_right_{k}" for k in keys])


def attach_by_value(rows: DataFrame, lookup: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Join a table with one row per value back to the rows.

    The side of the rows is what a frequent value makes large, and the skew rule of the adaptive planner
    splits it; the other side has one row per value.
    """
    return null_safe_join(rows, lookup.select(*keys, *payload), keys)
