"""Run monitoring over evaluation logs: early stopping, degeneration warnings, best checkpoint,
evaluation cadence and the learning-rate schedule.

Per-run sequences are computed with :func:`running`: a window when every run fits one task
(checked first), else a range-partitioned pass that spreads a very long run over many tasks.
For hot runs, "value k entries ago" is an equi-join on ``(run, index)`` rather than a window.
No per-run list is ever collected. With ``min_delta > 0`` the best loss is a sequential recurrence;
it is folded over each run's strict running minima only, in a stream that holds one number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import lr_at
from ..session import cut_lineage
from .keys import join_on
from .prefix import Running, all_keys_small, running


def _present(col: str) -> Column:
    """The value as a double; a missing metric (NULL or NaN) is NULL."""
    return F.when(~F.isnan(F.col(col)), F.col(col).cast("double"))


def early_stop_trace(history: DataFrame, keys: list[str] | None = None, step: str = "step",
                     loss: str = "val_loss", patience: int = 5, min_delta: float = 0.0,
                     monitor_rank_corr: bool = True, monitor_entropy: bool = True,
                     monitor_variance: bool = True, entropy_threshold: float = 0.5,
                     variance_threshold: float = 0.1, tau: str = "kendall_tau",
                     entropy: str = "score_entropy", variance: str = "mean_self_consistency_var") -> DataFrame:
    """One row per evaluation with the early-stopping state after it.

    improved: loss < best - min_delta (strict; a NaN loss never improves), where best is the loss of
    the last improvement; best_step / best_loss; counter: evaluations since the last improvement;
    warnings (see :func:`degeneration_warnings`); stop_now: counter >= patience or >= 2 warnings;
    stopped: sticky once true. ``patience = 0`` disables everything but best tracking. Rows after
    the first stop are flagged, not dropped. Rows that repeat a step count as evaluations of their
    own, in order of their loss and metrics. ``min_delta`` must not be negative.
    """
    if not min_delta >= 0.0:
        raise ValueError("min_delta must be at least 0")
    keys = list(keys or ["run_id"])
    x = history.select(*keys, step, loss, _present(loss).alias("_loss"), F.lit(1.0).alias("_one"),
                       _present(tau).alias("_tau"), _present(entropy).alias("_ent"), _present(variance).alias("_var"))
    small = all_keys_small(history, keys)
    # Pass 1: row number, best loss before each row, and how many values of each metric came so far.
    x = x.select("*", *[F.col("_" + m).isNotNull().cast("double").alias("_n_" + m) for m in _METRICS])
    specs = [Running("_rn", "sum", "_one"), Running("_best_before", "min", "_loss", inclusive=False)]
    x = running(x, keys, [step, "_loss", *["_" + m for m in _METRICS]],
                specs + [Running("_n_" + m, "sum", "_n_" + m) for m in _METRICS], small=small)
    # Materialised: read by the warnings, the second pass and the stop summary.
    x = cut_lineage(x)
    lower = F.col("_loss").isNotNull() & (F.col("_best_before").isNull() | (F.col("_loss") < F.col("_best_before")))
    if min_delta == 0.0:
        x = x.withColumn("improved", lower)
    else:
        better = _improvements(x.filter(lower), keys, min_delta).withColumn("improved", F.lit(True))
        x = join_on(x, better, [*keys, "_rn"], "left").withColumn("improved", F.coalesce("improved", F.lit(False)))
    x = _with_warnings(x, keys, "_rn", entropy_threshold, variance_threshold,
                       (monitor_rank_corr, monitor_entropy, monitor_variance), small)
    # Pass 2: the last improving row (needs "improved"); losses fall and steps rise with each one.
    x = x.withColumns({c: F.when(F.col("improved"), F.col(v).cast("double"))
                       for c, v in (("_imp_rn", "_rn"), ("_imp_step", step), ("_imp_loss", "_loss"))})
    x = running(x, keys, ["_rn"], [Running("_last_imp_rn", "max", "_imp_rn"), Running("_best_step", "max", "_imp_step"),
                                   Running("best_loss", "min", "_imp_loss")], small=small)
    counter = (F.col("_rn") - F.coalesce(F.col("_last_imp_rn"), F.lit(0.0))).cast("bigint")
    x = x.withColumn("counter", counter)
    stop_now = F.lit(False) if patience == 0 else (
        (F.col("counter") >= F.lit(patience)) | (F.col("n_warnings") >= 2))
    x = x.withColumn("stop_now", stop_now)
    first = x.filter("stop_now").groupBy(*keys).agg(F.min(step).alias("first_stop_step"),
                                                    F.min("_rn").alias("_stop_rn"))
    x = join_on(x, first, keys, "left")
    return x.select(
        *keys, step, loss, "improved",
        F.coalesce(F.col("_best_step"), F.lit(0.0)).cast("bigint").alias("best_step"),
        "best_loss", "counter", "stop_now",
        F.coalesce(F.col("_rn") >= F.col("_stop_rn"), F.lit(False)).alias("stopped"),
        "first_stop_step")


def _improvements(lower: DataFrame, keys: list[str], min_delta: float) -> DataFrame:
    """The rows among each run's strict running minima (``lower``) that beat the last improvement by
    more than ``min_delta``: (keys, _rn).

    Each improvement is such a minimum, so only those rows are shuffled, sorted by run and row
    number and folded in a stream of Arrow batches that remembers one loss. Losses fall within a run,
    so the next improvement is found by binary search. Keys pass through as they are.
    """
    rows = (lower.select(*keys, "_rn", "_loss", F.col("_best_before").isNull().alias("_starts"))
            .repartition(*keys).sortWithinPartitions(*keys, "_rn"))

    def fold(batches):
        best = math.inf
        for batch in batches:
            loss = batch.column("_loss").to_numpy()
            starts = np.flatnonzero(batch.column("_starts").to_numpy(zero_copy_only=False))
            taken = []
            for k, (a, b) in enumerate(zip([0, *starts], [*starts, len(loss)])):
                if k:
                    best = math.inf
                falling = -loss[a:b]
                at = int(np.searchsorted(falling, min_delta - best, side="right"))
                while at < b - a:
                    taken.append(a + at)
                    best = float(loss[a + at])
                    at = int(np.searchsorted(falling, min_delta - best, side="right"))
            yield batch.take(pa.array(taken, pa.int64()))

    return rows.mapInArrow(fold, rows.schema).select(*keys, "_rn")


_METRICS = ("tau", "ent", "var")


def _mean3(a: Column, b: Column, c: Column) -> Column:
    """Mean of three in this order of addition, so that every form compares the same doubles."""
    return (a + b + c) / F.lit(3.0)


def _with_warnings(x: DataFrame, keys: list[str], order: str, entropy_threshold: float, variance_threshold: float,
                   on: tuple[bool, bool, bool], small: bool) -> DataFrame:
    """``x`` with the three warning flags and their count. It holds the cleaned metrics ``_tau``,
    ``_ent``, ``_var`` and the numbers of values so far ``_n_*``; ``order`` is unique within keys."""
    if small:
        # Runs that fit one task (checked): all windows of a run share one shuffle on the keys.
        run = Window.partitionBy(*keys).orderBy(order)
        of_kind = Window.partitionBy(*keys, F.col("_tau").isNull()).orderBy(order)
        lags = [F.lag("_tau", i).over(of_kind) for i in range(6)]
        x = x.repartition(*keys).withColumn("_means", F.when(F.col("_tau").isNotNull(), F.struct(
            _mean3(lags[2], lags[1], lags[0]).alias("recent"), _mean3(lags[5], lags[4], lags[3]).alias("earlier"))))
        upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = x.withColumns({f"_at_{c}": F.last(c, ignorenulls=True).over(upto) for c in ("_means", "_ent", "_var")})
        recent, earlier = F.col("_at__means")["recent"], F.col("_at__means")["earlier"]
    else:
        # A run over many tasks: what stands at a number of values is an equi-join on that number.
        # A tau takes part in the means at its own number and the five after it.
        n, at = F.col("_n_tau"), F.explode(F.sequence(F.lit(0), F.lit(5)))
        near = x.filter(F.col("_tau").isNotNull()).select(*keys, n, "_tau", at.alias("_back"))
        back = [F.max(F.when(F.col("_back") == i, F.col("_tau"))) for i in range(6)]
        means = near.groupBy(*keys, (n + F.col("_back")).alias("_n_tau")).agg(
            _mean3(back[2], back[1], back[0]).alias("_recent"), _mean3(back[5], back[4], back[3]).alias("_earlier"))
        x = join_on(x, means, [*keys, "_n_tau"], "left")
        for m in ("ent", "var"):
            seen = x.filter(F.col("_" + m).isNotNull()).select(*keys, "_n_" + m, F.col("_" + m).alias("_at__" + m))
            x = join_on(x, seen, [*keys, "_n_" + m], "left")
        recent, earlier = F.col("_recent"), F.col("_earlier")
    flags = {"rank_decline": (F.col("_n_tau") > 5) & (recent < earlier - F.lit(0.05)),
             "entropy_collapse": (F.col("_n_ent") >= 2) & (F.col("_at__ent") < F.lit(entropy_threshold)),
             "variance_increase": (F.col("_n_var") >= 2) & (F.col("_at__var") > F.lit(variance_threshold))}
    x = x.withColumns({f: F.coalesce(c, F.lit(False)) if use else F.lit(False)
                       for (f, c), use in zip(flags.items(), on)})
    return x.withColumn("n_warnings", sum((F.col(f).cast("bigint") for f in flags), F.lit(0).cast("bigint")))


def degeneration_warnings(history: DataFrame, keys: list[str] | None = None, step: str = "step",
                          tau: str = "kendall_tau", entropy: str = "score_entropy",
                          variance: str = "mean_self_consistency_var", entropy_threshold: float = 0.5,
                          variance_threshold: float = 0.1) -> DataFrame:
    """Per evaluation: rank-correlation decline (more than 5 taus seen and the mean of the last 3
    below the mean of the 3 before minus 0.05), entropy collapse (at least 2 entropies and the
    last below 0.5), variance increase (at least 2 variances and the last above 0.1). Missing
    metrics do not enter their history. Rows that repeat a step are evaluations of their own."""
    keys = list(keys or ["run_id"])
    small = all_keys_small(history, keys)
    x = history.select(*keys, step, F.lit(1.0).alias("_one"), _present(tau).alias("_tau"),
                       _present(entropy).alias("_ent"), _present(variance).alias("_var"))
    x = x.select("*", *[F.col("_" + m).isNotNull().cast("double").alias("_n_" + m) for m in _METRICS])
    x = running(x, keys, [step, *["_" + m for m in _METRICS]],
                [Running("_rn", "sum", "_one"), *[Running("_n_" + m, "sum", "_n_" + m) for m in _METRICS]], small=small)
    if not small:
        x = cut_lineage(x)  # read once per metric and for the rows
    x = _with_warnings(x, keys, "_rn", entropy_threshold, variance_threshold, (True, True, True), small)
    return x.select(*keys, step, "rank_decline", "entropy_collapse", "variance_increase", "n_warnings")


def best_checkpoint(history: DataFrame, keys: list[str] | None = None, step: str = "step",
                    loss: str = "val_loss") -> DataFrame:
    """Lowest loss per run and its step, both tie rules: latest (the trainer's ``<=``) and
    earliest (early stopping's ``<``). Plain aggregates, partial on the map side."""
    keys = list(keys or ["run_id"])
    ok = history.filter(F.col(loss).isNotNull() & ~F.isnan(F.col(loss)))
    return ok.groupBy(*keys).agg(
        F.min(loss).alias("best_loss"),
        F.min_by(F.col(step), F.struct(F.col(loss), -F.col(step))).alias("best_step_latest"),
        F.min_by(F.col(step), F.struct(F.col(loss), F.col(step))).alias("best_step_earliest"))


def eval_cadence(history: DataFrame, every: int, keys: list[str] | None = None, step: str = "step",
                 last_step: DataFrame | None = None) -> DataFrame:
    """Rows at evaluation steps: every ``every`` steps and always the last step of the run."""
    keys = list(keys or ["run_id"])
    last = last_step if last_step is not None else history.groupBy(*keys).agg(F.max(step).alias("_last"))
    j = join_on(history, last, keys)
    return j.filter((F.col(step) % every == 0) | (F.col(step) == F.col("_last"))).drop("_last")


def lr_trace(runs: DataFrame, keys: list[str] | None = None, max_steps: str = "max_steps",
             initial_lr: float = 0.1, min_lr: float = 0.001, warmup_steps: int = 10) -> DataFrame:
    """Learning rate of every training step of every run: step s uses schedule index s - 1.
    ``runs`` has one row per run with its ``max_steps``; NULL when max_steps equals warm-up."""
    keys = list(keys or ["run_id"])
    s = runs.filter(F.col(max_steps) >= 1).select(*keys, max_steps, F.explode(F.sequence(F.lit(1), F.col(max_steps))).alias("step"))
    lr = lr_at(F.col("step") - 1, initial_lr, min_lr, F.col(max_steps), warmup_steps)
    return s.select(*keys, F.col("step").cast("bigint").alias("step"), lr.alias("learning_rate"))
