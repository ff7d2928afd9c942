"""Joining per-group results back on group keys, NULL keys included.

A plain ``join(other, keys)`` drops groups whose key is NULL (NULL = NULL is not true), which
would silently lose a whole group. These joins use null-safe equality instead; Spark still plans
them as hash or sort-merge equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with NULL-safe key equality; keys appear once."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_on needs at least one key")
    r = right.select(*[F.col(c).alias("_rk_" + c) if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_rk_" + k)) for k in keys])
    out = left.join(r, cond, how)
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        out = out.select(*[F.coalesce(F.col(c), F.col("_rk_" + c)).alias(c) if c in keys else F.col(c)
                           for c in left.columns],
                         *[c for c in r.columns if not c.startswith("_rk_") and c not in left.columns])
        return out
    return out.drop(*["_rk_" + k for k in keys])


def with_group_row(left: DataFrame, group: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``group``, which has one row per key. Without keys ``group`` is
    a single row and is read as a scalar subquery, so no join on a constant is planned."""
    if keys:
        return join_on(left, group, keys, how)
    row = group.select(F.struct(*group.columns).alias("_row")).scalar()
    return left.select(*left.columns, row.alias("_group")).select(
        *left.columns, *[F.col("_group")[c].alias(c) for c in group.columns])
