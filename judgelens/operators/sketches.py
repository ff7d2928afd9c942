"""Quantile sketches of scores: kept per part of the data, merged later, no sort.

The exact strata (:mod:`.sampling`) order every score. For data that keeps arriving, a KLL sketch per
part (a run and day, say) is stored instead; parts are merged when thresholds are wanted, so old
rows are never read again. Sketches are Spark aggregates with map-side combine, a few kilobytes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import with_group_row


def rank_error_bound(k: int) -> float:
    """What a threshold's rank may be off by, as a share of the rows: twice the sketch's 99 % rank error
    (2.296 / k^0.9723 for one quantile), which a run then meets with near certainty."""
    return 2 * 2.296 / k ** 0.9723


def score_sketches(df: DataFrame, keys: list[str], score: str = "human_score", k: int = 400) -> DataFrame:
    """One sketch of ``score`` per part: keys, n, sketch (binary). Missing and NaN scores are left out."""
    s = F.col(score).cast("double")
    return df.filter(s.isNotNull() & ~F.isnan(s)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(s, F.lit(k)).alias("sketch"))


def merge_sketches(parts: DataFrame, keys: list[str], k: int = 400) -> DataFrame:
    """The parts' sketches merged by coarser keys: keys, n, sketch."""
    return parts.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_thresholds(sketches: DataFrame, keys: list[str], high: float = 0.75, low: float = 0.25) -> DataFrame:
    """Strata thresholds read off each sketch: keys, n, low_threshold, high_threshold."""
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
    return sketches.select(*keys, "n", at(low).alias("low_threshold"), at(high).alias("high_threshold"))


def sketch_strata(df: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "human_score") -> DataFrame:
    """``df`` with both thresholds of its group and ``stratum``, by the rule of :func:`sampling.score_strata`."""
    j = with_group_row(df, thresholds.drop("n"), list(keys), "left")
    s = F.col(score)
    return j.withColumn("stratum", F.when(s >= F.col("high_threshold"), "high").when(s <= F.col("low_threshold"), "low").otherwise("mid"))


def rank_errors(df: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "human_score", high: float = 0.75,
                low: float = 0.25) -> DataFrame:
    """Measured rank error of both thresholds, by counting: how far the wanted share lies outside the
    shares of rows below and up to the threshold. Keys, n, low_error, high_error."""
    s = F.col(score).cast("double")
    j = with_group_row(df.filter(s.isNotNull() & ~F.isnan(s)), thresholds.drop("n"), list(keys))

    def off(t: str, p: float):
        below, upto = (F.sum(x.cast("double")) / F.count(F.lit(1)) for x in ((s < F.col(t)).cast("int"), (s <= F.col(t)).cast("int")))
        return F.greatest(F.lit(0.0), below - F.lit(p), F.lit(p) - upto)

    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), off("low_threshold", low).alias("low_error"),
                                off("high_threshold", high).alias("high_error"))
