"""Judge drift over time: bias, MAE and judge-score spread per tumbling event-time window.

The same aggregation runs in batch (:func:`windowed_drift`) and as a stream
(:func:`drift_stream`), where a watermark bounds the state kept for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keys import join_on


def _drift_aggs(human: str, judge: str):
    e = F.col(judge) - F.col(human)
    return [F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"),
            F.stddev_pop(judge).alias("judge_std")]


def windowed_drift(df: DataFrame, ts: str = "ts", human: str = "human_score", judge: str = "judge_score",
                width: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """One row per window of ``width`` and keys: its start and end, and the drift figures."""
    keys = list(keys or [])
    g = df.groupBy(F.window(ts, width).alias("w"), *keys).agg(*_drift_aggs(human, judge))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                    "n", "bias", "mae", "judge_std")


def drift_stream(stream: DataFrame, ts: str = "ts", human: str = "human_score", judge: str = "judge_score",
                 width: str = "1 day", watermark: str = "2 days", keys: list[str] | None = None) -> DataFrame:
    """Streaming form: append mode emits a window once the watermark has passed its end."""
    keys = list(keys or [])
    # Watermarks need TIMESTAMP (local time zone) event time; parquet may carry TIMESTAMP_NTZ.
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    g = (stream.withWatermark(ts, watermark)
         .groupBy(F.window(ts, width).alias("w"), *keys).agg(*_drift_aggs(human, judge)))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                    "n", "bias", "mae", "judge_std")


def late_counts(closed: DataFrame, log: DataFrame, ts: str = "ts", width: str = "1 day",
                keys: list[str] | None = None) -> DataFrame:
    """``closed`` (what :func:`drift_stream` wrote) with ``late_rows``: the rows of each closed window that the log
    holds but the window does not, because they came after the watermark had passed its end."""
    keys = list(keys or [])
    seen = log.select(F.col(ts).cast("timestamp").alias(ts), *keys).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.select(F.col("w.start").alias("window_start"), *keys, "_n")
    return join_on(closed, seen, ["window_start", *keys], "left").withColumn("late_rows", F.coalesce("_n", F.lit(0)) - F.col("n")).drop("_n")
