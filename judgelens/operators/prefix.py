"""Running aggregates over an ordered key that never put one key into one task.

``Window.partitionBy(key)`` sends every row of a key to one task, which breaks when one run,
group or stratum holds a third of the data. Here the rows are range-partitioned on
``(keys, order)`` (Spark samples the bounds, so a hot key is cut into many slices and tiny keys
are packed together) and written to the checkpoint folder with their partition number. Running
values come from a window within each slice, and what a slice takes over from the slices before
it is a running aggregate over the per-slice totals: only the first key of a partition can
continue, so that table has at most one row per partition and its broadcast is bounded.

Everything is a DataFrame expression: types, NULL, NaN and wide integers pass through untouched,
and both forms fold with the same Spark aggregates. Keys that all fit one task (checked) keep
the plain window, which is one sort-based stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``out = fn(column) over rows before (and, if inclusive, at) this row``.
    Values are read as ``kind`` (doubles unless told otherwise; a sum of decimals widens it); a sum
    over nothing is 0, a minimum or maximum over nothing is NULL."""

    out: str
    fn: str
    column: str
    inclusive: bool = True
    kind: str = "double"

    def __post_init__(self):
        if self.fn not in _AGG:
            raise ValueError(f"fn must be one of {tuple(_AGG)}, got {self.fn!r}")

    def over(self, window) -> Column:
        rows = window.rowsBetween(Window.unboundedPreceding, Window.currentRow if self.inclusive else -1)
        return _AGG[self.fn](F.col(self.column).cast(self.kind)).over(rows)

    def total(self) -> Column:
        return _AGG[self.fn](F.col(self.column).cast(self.kind))

    def joined(self, carried: Column, local: Column) -> Column:
        """The value over earlier slices and the value within this one, as one value."""
        if self.fn == "sum":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        return (F.least if self.fn == "min" else F.greatest)(carried, local)


def max_key_rows(spark) -> int:
    """Largest key that may be handled by one window task (rows). It chooses a plan, never a result."""
    return int(spark.conf.get("judgelens.maxKeyRows", "250000"))


def running(df: DataFrame, keys: list[str], order: list[str], specs: list[Running],
            partitions: int | None = None, key_rows: int | None = None,
            small: bool | None = None) -> DataFrame:
    """Add one column per spec holding the running aggregate within ``keys`` in ``order``.

    When every key has at most ``key_rows`` rows a plain window is used, one task per key;
    otherwise the range-partitioned form, which spreads one key over many tasks. The check is one
    small aggregate job; callers that already checked a bound on every key pass ``small=True`` /
    ``False``. Rows that tie on ``(keys, order)`` are taken in an arbitrary but fixed order, so
    callers make the order unique (or aggregate ties first, as :func:`prefix_before` does).
    """
    if small is None:
        small = all_keys_small(df, keys, key_rows)
    return (_running_window if small else _running_ranged)(df, keys, order, specs, partitions)


def _kept(df: DataFrame, specs: list[Running]) -> list[str]:
    return [c for c in df.columns if c not in {s.out for s in specs}]


def _running_window(df: DataFrame, keys: list[str], order: list[str], specs: list[Running],
                    partitions: int | None = None) -> DataFrame:
    base = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*_kept(df, specs), *[
        (F.coalesce(s.over(base), F.lit(0)) if s.fn == "sum" else s.over(base)).alias(s.out) for s in specs])


def _running_ranged(df: DataFrame, keys: list[str], order: list[str], specs: list[Running],
                    partitions: int | None = None) -> DataFrame:
    n = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Checkpointed (reliably, into spark.checkpoint.dir): the slices and their totals then come from
    # one set of range bounds, and a lost executor recomputes nothing upstream.
    sliced = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()))
    totals = sliced.groupBy("_pid", *keys).agg(*[s.total().alias("_t_" + s.out) for s in specs],
                                               F.lit(True).alias("_slice"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_pid").alias("_c_pid"), *[F.col(k).alias("_ck_" + k) for k in keys],
        *[_AGG[s.fn]("_t_" + s.out).over(before).alias("_c_" + s.out) for s in specs],
        F.max("_slice").over(before).alias("_continues")).filter("_continues").drop("_continues")
    same = F.col("_pid") == F.col("_c_pid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_ck_" + k))
    within = Window.partitionBy("_pid", *keys).orderBy(*order)
    local = sliced.select(*_kept(sliced, specs), *[s.over(within).alias("_l_" + s.out) for s in specs])
    return local.join(F.broadcast(carried), same, "left").select(
        *_kept(df, specs), *[s.joined(F.col("_c_" + s.out), F.col("_l_" + s.out)).alias(s.out) for s in specs])


def all_keys_small(df: DataFrame, keys: list[str], key_rows: int | None = None) -> bool:
    """True when no key of ``df`` has more rows than one window task may take."""
    limit = key_rows or max_key_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.filter(F.col("_rows") > F.lit(limit)).isEmpty()


def prefix_before(points: DataFrame, keys: list[str], order: str | list[str], weights: list[str],
                  partitions: int | None = None, small: bool | None = None) -> DataFrame:
    """For each distinct ``(keys, order)`` value: the sum of every weight at that value
    (``<w>``) and over strictly smaller values of the same key (``<w>_before``).

    Ties are aggregated first (map-side), so the result is exact whatever the duplication.
    """
    order = [order] if isinstance(order, str) else list(order)
    agg = points.groupBy(*keys, *order).agg(*[F.sum(w).cast("double").alias(w) for w in weights])
    specs = [Running(w + "_before", "sum", w, inclusive=False) for w in weights]
    return running(agg, keys, order, specs, partitions, small=small)
