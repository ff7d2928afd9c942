"""Streaming run monitor: early stopping and degeneration warnings as evaluations arrive.

State per run is bounded (best loss and step, counter, the last six rank correlations, last
entropy / variance and their counts, the sticky stop flag, the last step seen, the number of late
rows), kept in Spark's state store via ``applyInPandasWithState``. Every evaluation row yields one
decision row, so nothing is dropped unseen. Within a micro-batch a run's rows are taken in order of
step, loss and metrics, as in the batch form; a task holds six numbers a row of one run for that,
and the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds a micro-batch.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

DECISION_FIELDS = [
    T.StructField("step", T.LongType()),
    T.StructField("val_loss", T.DoubleType()), T.StructField("improved", T.BooleanType()),
    T.StructField("best_step", T.LongType()), T.StructField("best_loss", T.DoubleType()),
    T.StructField("counter", T.LongType()), T.StructField("rank_decline", T.BooleanType()),
    T.StructField("entropy_collapse", T.BooleanType()), T.StructField("variance_increase", T.BooleanType()),
    T.StructField("n_warnings", T.LongType()), T.StructField("stop_now", T.BooleanType()),
    T.StructField("stopped", T.BooleanType()), T.StructField("late", T.BooleanType()),
    T.StructField("n_late", T.LongType())]

STATE_SCHEMA = T.StructType([
    T.StructField("best", T.DoubleType()), T.StructField("best_step", T.LongType()),
    T.StructField("counter", T.LongType()), T.StructField("last_step", T.LongType()),
    T.StructField("taus", T.ArrayType(T.DoubleType())), T.StructField("n_tau", T.LongType()),
    T.StructField("n_ent", T.LongType()), T.StructField("last_ent", T.DoubleType()),
    T.StructField("n_var", T.LongType()), T.StructField("last_var", T.DoubleType()),
    T.StructField("stopped", T.BooleanType()), T.StructField("n_late", T.LongType()),
    T.StructField("last_ms", T.LongType())])

FRESH_STATE = (None, 0, 0, None, [], 0, 0, None, 0, None, False, 0, None)
METRICS = ["kendall_tau", "score_entropy", "mean_self_consistency_var"]
CHUNK_ROWS = 50_000


def _present(v) -> bool:
    return v is not None and not (isinstance(v, float) and math.isnan(v))


def advance(run, rows: pd.DataFrame, state: tuple, patience: int = 5, min_delta: float = 0.0,
            entropy_threshold: float = 0.5, variance_threshold: float = 0.1, monitor_rank_corr: bool = True,
            monitor_entropy: bool = True, monitor_variance: bool = True):
    """Apply one run's new evaluation rows to its state: yields frames of decision rows, returns the
    new state.

    A row whose step lies before the last step of an earlier row is late: it changes no state but the
    count ``n_late``, and its decision row has ``late`` true. A repeated step is an evaluation of its own.
    """
    (best, best_step, counter, last_step, taus, n_tau, n_ent, last_ent, n_var, last_var,
     stopped, n_late, last_ms) = state
    taus = list(taus or [])
    best = math.inf if best is None else best
    columns = ["run_id", *[f.name for f in DECISION_FIELDS]]
    out = []
    for row in rows.sort_values(["step", "val_loss", *METRICS], kind="stable", na_position="first").itertuples(index=False):
        step = int(row.step)
        loss = float(row.val_loss) if row.val_loss is not None else math.nan
        late = last_step is not None and step < last_step
        improved = rank = ent = var = stop_now = False
        if late:
            n_late += 1
        else:
            last_step = step
            improved = loss < best - min_delta
            if improved:
                best, best_step, counter = loss, step, 0
            else:
                counter += 1
            if patience != 0:
                if _present(row.kendall_tau):
                    taus = (taus + [float(row.kendall_tau)])[-6:]
                    n_tau += 1
                if _present(row.score_entropy):
                    n_ent, last_ent = n_ent + 1, float(row.score_entropy)
                if _present(row.mean_self_consistency_var):
                    n_var, last_var = n_var + 1, float(row.mean_self_consistency_var)
                if monitor_rank_corr and n_tau > 5:
                    a, b, c, d, e, f = taus
                    rank = (d + e + f) / 3.0 < (a + b + c) / 3.0 - 0.05
                ent = monitor_entropy and n_ent >= 2 and last_ent < entropy_threshold
                var = monitor_variance and n_var >= 2 and last_var > variance_threshold
                stop_now = counter >= patience or (rank + ent + var) >= 2
                stopped = stopped or stop_now
        out.append((run, step, None if math.isnan(loss) else loss, improved, int(best_step),
                    None if math.isinf(best) else best, counter, rank, ent, var,
                    int(rank) + int(ent) + int(var), stop_now, stopped, late, n_late))
        if len(out) == CHUNK_ROWS:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)
    return (None if math.isinf(best) else best, int(best_step), int(counter), last_step, taus,
            n_tau, n_ent, last_ent, n_var, last_var, stopped, n_late, last_ms)


def monitor_function(idle_ms: int | None = None, **params):
    """The streaming state update: per run, the new rows of a micro-batch; a run that was idle for
    ``idle_ms`` of event time loses its state."""

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        current = tuple(state.get) if state.exists else FRESH_STATE
        rows = pd.concat(list(batches), ignore_index=True)
        new = yield from advance(key[0], rows, current, **params)
        if idle_ms is not None:
            seen = [t for t in (new[-1], rows["_ms"].max()) if t is not None and not pd.isna(t)]
            last = int(max(seen)) if seen else None
            new = (*new[:-1], last)
            # The timeout must lie after the watermark; a run known only by late rows ends at once after it.
            state.setTimeoutTimestamp(max(last or 0, state.getCurrentWatermarkMs()) + idle_ms)
        state.update(new)

    return update


def monitor_stream(evals: DataFrame, run: str = "run_id", ts: str | None = None, watermark: str = "1 day",
                   idle_hours: float | None = None, **params) -> DataFrame:
    """Apply the monitor to a stream of evaluation rows
    ``(run, step, val_loss, kendall_tau, score_entropy, mean_self_consistency_var)``.

    ``run`` may have any type and is returned as ``run_id``. With ``idle_hours`` (and the event time
    column ``ts``) a run's state is removed once the watermark is that far past its newest row; Spark
    then leaves out rows older than the watermark, and a run that goes on later starts afresh. Without
    it, state is kept for good.
    """
    if idle_hours is not None and ts is None:
        raise ValueError("idle_hours needs the event time column ts")
    cols = [F.col(run).alias("run_id"), F.col("step").cast("bigint").alias("step"),
            *[F.col(c).cast("double").alias(c) for c in ("val_loss", *METRICS)]]
    if idle_hours is None:
        x, timeout, idle_ms = evals.select(*cols), GroupStateTimeout.NoTimeout, None
    else:
        x = (evals.select(*cols, F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", watermark)
             .withColumn("_ms", F.unix_millis("_ts")))
        timeout, idle_ms = GroupStateTimeout.EventTimeTimeout, int(idle_hours * 3_600_000)
    schema = T.StructType([T.StructField("run_id", x.schema["run_id"].dataType), *DECISION_FIELDS])
    return x.groupBy("run_id").applyInPandasWithState(
        monitor_function(idle_ms=idle_ms, **params), schema, STATE_SCHEMA, "append", timeout)
