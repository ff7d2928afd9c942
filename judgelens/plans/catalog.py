"""Registered queries: one per operator, each reading the given tables at ``sf_dir``.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names match the
DuckDB oracle in :mod:`judgelens.plans.oracle`. Floating results are rounded to 6 places on
both sides so that summation order cannot change the comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import md5_unit, round_half_up
from ..operators import (audit, bulk_scoring, consensus, edit_limits, metrics, monitor, prompts, ranking, samples,
                         sampling, scoring, sketches)
from ..operators.prefix import Running, running
from ..session import ensure_checkpoint_dir, remove_folder
from ..sources import scored_files, synthetic
from ..sources.tables import table
from ..streaming import drift
from ..streaming.monitor_stream import monitor_stream
from . import fixtures as fx

GROUP = ["source", "prompt_version"]


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- metrics ------------------------------------------------------------------------------

def q_error_columns(spark: SparkSession, d: str) -> DataFrame:
    j = fx.judged_docs(spark, d)
    return r6(metrics.with_error_columns(j).select("sample_id", "source", "human_score", "judge_score",
                                                   "error", "abs_error"))


def q_error_metrics(spark, d):
    return r6(metrics.error_metrics(fx.judged_versions(spark, d), GROUP))


def q_error_metrics_rollup(spark, d):
    return r6(metrics.error_metrics_rollup(fx.judged_docs(spark, d), ["source", "lang"]))


def q_huber_loss(spark, d):
    return r6(metrics.huber_loss(fx.judged_versions(spark, d), GROUP, delta=1.0))


def q_score_spread(spark, d):
    return r6(metrics.score_spread(fx.judged_versions(spark, d), GROUP))


def q_score_entropy(spark, d):
    return r6(metrics.score_entropy(fx.judged_versions(spark, d), GROUP))


def q_kendall_tau(spark, d):
    return r6(ranking.kendall_tau(fx.pair_scores(spark, d), ["group_id"]))


def q_spearman_rho(spark, d):
    return r6(ranking.spearman_rho(fx.pair_scores(spark, d), ["group_id"]))


def q_pairwise_ranking_loss(spark, d):
    return r6(ranking.pairwise_ranking_loss(fx.pair_scores(spark, d), ["group_id"]))


def q_pairwise_ranking_loss_margin(spark, d):
    return r6(ranking.pairwise_ranking_loss(fx.pair_scores(spark, d), ["group_id"], margin=0.5))


def q_composite_loss(spark, d):
    return r6(metrics.composite_loss_all(fx.judged_versions(spark, d), GROUP))


def q_evaluation_report(spark, d):
    return r6(metrics.evaluation_report(fx.judged_versions(spark, d), GROUP, loss_type="pairwise"))


def q_rank_statistics_rollup(spark, d):
    return r6(ranking.rank_statistics_rollup(fx.judged_docs(spark, d), ["source", "lang"]))


def q_contraction_loss(spark, d):
    return r6(metrics.contraction_loss(fx.judged_versions(spark, d), GROUP, loss_type="kendall", gamma=0.5))


def q_stratum_ranking_loss(spark, d):
    """The pairwise loss among each group's best and worst scored rows."""
    strata = sampling.score_strata(fx.pair_scores(spark, d), ["group_id"]).filter("stratum <> 'mid'")
    return r6(ranking.pairwise_ranking_loss(strata, ["group_id", "stratum"]))


def _consensus_places(df):
    """Fitted values settle to 1e-9 in either engine: four places of them are compared."""
    fitted = ("fitted_score", "bias", "residual")
    return df.select(*[F.round(c, 4 if c in fitted else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_human_consensus(spark, d):
    return _consensus_places(consensus.human_consensus(fx.ratings(spark, d)))


def q_annotator_bias(spark, d):
    return _consensus_places(consensus.fit_annotators(consensus.rating_cells(fx.ratings(spark, d))).annotators)


def q_judge_human_join(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("sample_id"),
        round_half_up(F.lit(1.0) + F.lit(9.0) * F.col("n_chars") / (F.col("n_chars") + F.lit(3000.0)), 1)
        .alias("judge_score"))
    human = table(spark, d, "labels").select(
        F.col("doc_id").alias("sample_id"),
        (F.lit(1) + F.lit(6) * F.col("quality") + F.lit(3) * (F.lit(1) - F.col("toxic"))).cast("double")
        .alias("human_score"))
    return r6(scoring.judge_human_join(docs, human))


# ---- sampling -----------------------------------------------------------------------------

def _split(spark, d):
    return sampling.train_val_split(fx.strata_samples(spark, d), id_col="sample_id", val_fraction=0.2, seed=42)


def q_train_val_split(spark, d):
    return r6(_split(spark, d).select("sample_id", "human_score", "split"))


def q_hash_split(spark, d):
    return r6(sampling.hash_split(fx.strata_samples(spark, d), val_fraction=0.2, seed=42))


def q_strata_sketch(spark, d):
    """Sketches kept per run and day, merged by day: whether the thresholds' measured rank error meets the bound."""
    path = f"{scratch(spark, 'strata-sketch')}/parts"
    x = fx.eval_history(spark, d).select("run_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("val_loss").alias("human_score"))
    sketches.score_sketches(x, ["run_id", "day"]).write.parquet(path)
    thresholds = sketches.sketch_thresholds(sketches.merge_sketches(spark.read.parquet(path), ["day"]), ["day"])
    bound = sketches.rank_error_bound(400)
    return sketches.rank_errors(x, thresholds, ["day"]).select(
        "day", "n", (F.col("low_error") <= bound).alias("low_within"), (F.col("high_error") <= bound).alias("high_within"))


def q_split_summary(spark, d):
    return r6(metrics.split_summary(_split(spark, d), ["split"]))


def q_score_strata(spark, d):
    s = sampling.score_strata(fx.strata_samples(spark, d))
    return r6(s.select("sample_id", "human_score", "low_threshold", "high_threshold", "stratum"))


def _batches(spark, d):
    return sampling.epoch_batches(fx.strata_samples(spark, d), batch_size=32, epochs=2, seed=42)


def q_epoch_batches(spark, d):
    return r6(_batches(spark, d))


def q_gather_batches(spark, d):
    g = sampling.gather_batch(_batches(spark, d), fx.strata_samples(spark, d), epoch=1)
    return r6(g.select("sample_id", "human_score", "batch_no", "position", "stratum"))


def q_epoch_progress(spark, d):
    return r6(sampling.epoch_progress(_batches(spark, d)))


# ---- error samples ------------------------------------------------------------------------

def q_error_samples(spark, d):
    return r6(samples.error_samples(fx.judged_docs(spark, d), ["source"], k=3))


def q_error_statistics(spark, d):
    return r6(samples.error_statistics(fx.judged_docs(spark, d), ["source"], k=3))


def q_format_error_samples(spark, d):
    return samples.format_error_samples(fx.judged_docs(spark, d), ["source"], k=3)


def q_prompt_version_compare(spark, d):
    pairs = scoring.prompt_version_compare(fx.judged_versions(spark, d), 1, 2, keys=["source"])
    return r6(scoring.version_compare_summary(pairs, ["source"]))


def q_prompt_version_pairs(spark, d):
    """Every sample under both prompt versions: scores, errors, change and outcome."""
    pairs = scoring.prompt_version_compare(fx.judged_versions(spark, d), 1, 2, keys=["source"])
    return r6(pairs.select("source", "sample_id", "score_a", "score_b", "abs_error_a", "abs_error_b", "abs_error_delta", "outcome"))


# ---- scoring ------------------------------------------------------------------------------

def _consistency(spark, d):
    r = fx.responses(spark, d).withColumn("prompt_version", F.explode(F.array(F.lit(1), F.lit(2))))

    def scorer(rep):
        return scoring.length_judge(F.col("response"), F.lit("sc"), F.col("prompt_version").cast("string"),
                                    F.col("sample_id"), rep.cast("string"))
    return scoring.self_consistency(r, scorer, n_samples=3, keys=["prompt_version"])


def q_self_consistency(spark, d):
    sc = _consistency(spark, d)
    return r6(sc.select("prompt_version", "sample_id", "mean_score", "variance", "n_scores"))


def q_mean_consistency(spark, d):
    return r6(scoring.mean_self_consistency_variance(_consistency(spark, d), ["prompt_version"]))


def q_batch_scores(spark, d):
    """A plugged-in scorer that gets whole Arrow batches: the share of the prompt's words in the response."""

    @F.pandas_udf("double")
    def overlap(prompt: pd.Series, response: pd.Series) -> pd.Series:
        words = [(set(p.split(" ")), set(r.split(" "))) for p, r in zip(prompt, response)]
        return pd.Series([len(p & r) / len(p) for p, r in words], dtype="float64")

    scored = scoring.score_responses(fx.responses(spark, d).fillna("", ["response"]), overlap)
    return r6(scored.select("sample_id", "judge_score"))


def q_bulk_scores(spark, d):
    """A scorer that raises for some rows, recovers for others and says nothing for some: every row comes back."""

    def scorer(prompt: str, response: str, attempt: int) -> float | None:
        kind = len(response) % 5
        if kind == 0 or kind == 1 and attempt == 1:
            raise ValueError(f"no verdict on {len(response)} characters")
        return None if kind == 2 else len(response) / 10.0

    scored = bulk_scoring.score_rows(fx.responses(spark, d).fillna("", ["response"]), scorer, ["prompt", "response"], attempts=3)
    return r6(scored.select("sample_id", "judge_score", "status", "reason", "n_attempts"))


def q_length_judge(spark, d):
    r = fx.responses(spark, d)
    return r6(r.select("sample_id", scoring.length_judge(F.col("response"), F.lit("lj"), F.col("sample_id"))
                       .alias("judge_score")))


def q_extract_score(spark, d):
    # Parsed numbers, no arithmetic: returned as parsed (rounding would only blur huge values).
    return scoring.extract_scores(fx.judge_replies(spark, d)).select("sample_id", "score", "used_fallback")


def q_unscored_pairs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    cand = docs.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("prompt_version"), "sample_id")
    lab = table(spark, d, "labels")
    cache = (lab.select(F.lit(1).alias("prompt_version"), F.col("doc_id").alias("sample_id"))
             .unionByName(lab.filter(F.col("quality") == 1)
                          .select(F.lit(2).alias("prompt_version"), F.col("doc_id").alias("sample_id"))))
    return scoring.unscored_pairs(cand, cache, ["prompt_version", "sample_id"])


# ---- prompts and audit ----------------------------------------------------------------------

def _audit(spark, d):
    return audit.audit_proposals(fx.proposals(spark, d), fx.prompt_sections(spark, d), initial_lr=0.1)


def _applied(spark, d):
    return prompts.apply_edits(fx.prompt_sections(spark, d), audit.accepted_edits(_audit(spark, d)))


def q_section_classes(spark, d):
    return prompts.section_classes(fx.prompt_sections(spark, d))


def q_section_lookup(spark, d):
    o = table(spark, d, "orders")
    req = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("prompt_id"),
                   F.lit(1).alias("version"), F.col("o_orderpriority").alias("section"))
    return prompts.lookup_sections(fx.prompt_sections(spark, d), req)


def q_render_prompt(spark, d):
    both = fx.prompt_sections(spark, d).unionByName(_applied(spark, d))
    return prompts.render_prompt(both)


def q_section_diff(spark, d):
    return prompts.section_diff(fx.prompt_sections(spark, d), _applied(spark, d))


def q_edit_audit(spark, d):
    old, new, rates = fx.section_updates(spark, d)
    return edit_limits.edit_audit(old, new, rates, initial_lr=1.0, max_chars=200)


def q_modal_strength(spark, d):
    old, new, _ = fx.section_updates(spark, d)
    return edit_limits.modal_strength(old, new)


def q_apply_edits(spark, d):
    return _applied(spark, d)


def q_applied_edit_counts(spark, d):
    return prompts.applied_edit_counts(audit.accepted_edits(_audit(spark, d)), fx.prompt_sections(spark, d))


def q_proposal_audit(spark, d):
    return r6(_audit(spark, d))


def q_clean_section_text(spark, d):
    a = _audit(spark, d)
    return a.select("proposal_id", "new_content")


def q_parse_gradient_replies(spark, d):
    mods, _ = audit.parse_gradient_replies(fx.gradient_replies(spark, d), keys=["reply_id", "prompt_id"])
    return mods


def q_fallback_direction(spark, d):
    sec = fx.prompt_sections(spark, d)
    stats = table(spark, d, "customer").select(
        F.col("c_custkey").alias("prompt_id"),
        ((F.col("c_custkey") % 5 - 2) / F.lit(10.0)).alias("mean_error"))
    return audit.fallback_direction(_audit(spark, d), sec, stats)


# ---- version log ---------------------------------------------------------------------------

def _versions(spark, d):
    h = fx.eval_history(spark, d)
    return h.select("run_id", "step", "val_loss", (F.col("val_loss") * F.lit(0.9)).alias("train_loss"),
                    "kendall_tau", "score_entropy", "mean_self_consistency_var", F.col("ts").alias("committed_at"),
                    F.repeat(F.col("props"), F.col("k") % 25).alias("gradient_summary"),
                    F.concat(F.lit("lower loss at step "), F.col("step").cast("string"), F.lit(": "),
                             F.repeat(F.lit("ab"), F.col("k"))).alias("rationale"))


def q_version_log_summary(spark, d):
    v = prompts.version_log(_versions(spark, d), metrics=["kendall_tau", "score_entropy",
                                                          "mean_self_consistency_var"])
    return r6(v.select("run_id", "step", "val_loss", "summary_clipped", "rationale_clipped", "message",
                       F.length("gradient_summary").cast("bigint").alias("summary_chars")))


def q_version_commits(spark, d):
    """Two commits, the first of them repeated, then the table compacted and read: each version once."""
    base = scratch(spark, "versions")
    v = _versions(spark, d).select("run_id", "step", "val_loss", "committed_at")
    written = [prompts.append_versions(v.filter(part), f"{base}/log", key) for key, part in
               (("first", "step % 2 = 1"), ("second", "step % 2 = 0"), ("first", "step % 2 = 1"))]
    prompts.compact_versions(spark, f"{base}/log", f"{base}/compact")
    remove_folder(spark, f"{base}/log")
    return r6(prompts.read_versions(spark, f"{base}/compact").select("run_id", "step", "val_loss", F.lit(written[2]).cast("bigint").alias("repeated")))


def q_version_history(spark, d):
    return r6(prompts.version_history(_versions(spark, d), max_count=10)
              .select("run_id", "step", "val_loss", "recency"))


def q_checkout_version(spark, d):
    v = _versions(spark, d)
    # The best tag moves to every evaluation whose loss is <= the best so far.
    best = running(v.withColumn("_l", F.col("val_loss")), ["run_id"], ["step"],
                   [Running("_best_before", "min", "_l", inclusive=False)])
    best_tags = (best.filter(F.col("_best_before").isNull() | (F.col("val_loss") <= F.col("_best_before")))
                 .select("run_id", F.lit("best").alias("tag"), "step", F.col("committed_at").alias("tagged_at")))
    stable = (v.filter((F.col("run_id") % 2 == 0) & (F.col("step") == 10))
              .select("run_id", F.lit("stable").alias("tag"), "step", F.col("committed_at").alias("tagged_at")))
    runs = v.select("run_id").distinct()
    req = runs.select(
        "run_id",
        F.when(F.col("run_id") % 3 == 0, F.lit("stable")).alias("tag"),
        F.when(F.col("run_id") % 3 == 1, F.lit(5).cast("bigint")).alias("step"))
    res = prompts.checkout_version(v.select("run_id", "step", "val_loss"), best_tags.unionByName(stable), req)
    # A request that checks nothing out shows step -1, so that the column holds integers in every client.
    return r6(res.fillna(-1, subset=["step"]).select("run_id", "resolved_by", "step", "status", "val_loss"))


# ---- monitor --------------------------------------------------------------------------------

def q_lr_trace(spark, d):
    runs = fx.eval_history(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("max_steps"))
    return r6(monitor.lr_trace(runs, initial_lr=0.1, min_lr=0.001, warmup_steps=10))


def q_eval_cadence(spark, d):
    return r6(monitor.eval_cadence(fx.eval_history(spark, d), every=5).select("run_id", "step", "val_loss"))


def q_early_stop_trace(spark, d):
    return r6(monitor.early_stop_trace(fx.eval_history(spark, d), patience=5))


def q_early_stop_min_delta(spark, d):
    return r6(monitor.early_stop_trace(fx.eval_history(spark, d), patience=5, min_delta=0.01))


def q_degeneration_warnings(spark, d):
    return monitor.degeneration_warnings(fx.eval_history(spark, d))


def q_best_checkpoint(spark, d):
    return r6(monitor.best_checkpoint(fx.eval_history(spark, d)))


def q_daily_score_drift(spark, d):
    h = fx.eval_history(spark, d)
    x = h.select("ts", F.col("val_loss").alias("human_score"),
                 (F.col("val_loss") + (F.col("k") - F.lit(50)) / F.lit(50.0)).alias("judge_score"))
    w = drift.windowed_drift(x, width="1 day")
    return r6(w.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end"))


def q_stream_drift(spark, d):
    """The score log arriving in three parts, the last of them late, through the drift stream: the windows
    that the watermark closed, and how many rows of theirs came too late."""
    base = scratch(spark, "stream-drift")
    h = fx.eval_history(spark, d)
    x = h.select(F.col("ts").cast("timestamp").alias("ts"), F.col("val_loss").alias("human_score"), (F.col("val_loss") + (F.col("k") - F.lit(50)) / F.lit(50.0)).alias("judge_score"),
                 ((F.col("k") % 10 == 0) & (F.col("ts") < F.lit("2024-01-06").cast("timestamp"))).alias("late"))
    cut = F.col("ts") < F.lit("2024-01-21").cast("timestamp")
    cols = ["ts", "human_score", "judge_score"]
    late = F.coalesce("late", F.lit(False))
    for part in (~late & cut, ~late & ~cut, late):
        x.filter(part).select(*cols).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(x.select(*cols).schema).parquet(f"{base}/log")
        (drift.drift_stream(stream, width="1 day", watermark="2 days").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/state").option("path", f"{base}/windows").trigger(availableNow=True).start().awaitTermination())
    remove_folder(spark, f"{base}/state")
    out = drift.late_counts(spark.read.parquet(f"{base}/windows"), spark.read.parquet(f"{base}/log"))
    return r6(out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end"))


def q_stream_monitor(spark, d):
    """The run log as a stream of files through the stateful monitor; its decisions, read back."""
    base = scratch(spark, "stream-monitor")
    log = fx.eval_history(spark, d).select("run_id", "step", "val_loss", "kendall_tau", "score_entropy",
                                           "mean_self_consistency_var")
    log.write.parquet(f"{base}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{base}/log")
    run = (monitor_stream(stream, patience=5).writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", f"{base}/state").option("path", f"{base}/decisions")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    for part in ("log", "state"):
        remove_folder(spark, f"{base}/{part}")
    decisions = spark.read.parquet(f"{base}/decisions")
    return r6(decisions.select("run_id", "step", "val_loss", "improved", "best_step", "best_loss", "counter",
                               "n_warnings", "stop_now", "stopped", "late"))


# ---- sources ------------------------------------------------------------------------------

def q_scored_files(spark, d):
    """Scored rows written as JSON lines, loaded again: samples with their copy number, and quarantine."""
    path = f"{scratch(spark, 'scored-files')}/lines"
    fx.raw_scored_rows(spark, d).select(F.to_json(F.struct("prompt", "response", "score")).alias("value")).write.text(path)
    ok, bad = scored_files.load_scored(spark, path)
    ok = ok.select("prompt", "response", F.col("human_score").alias("score"), F.lit("ok").alias("status"),
                   F.substring_index("sample_id", "-", -1).cast("bigint").alias("copy"))
    bad = bad.select("prompt", "response", "score", "status", F.lit(0).cast("bigint").alias("copy"))
    return r6(ok.unionByName(bad))


def q_mapped_fields(spark, d):
    """Lines whose fields have other names, with broken and blank lines between them: every row and its status."""
    path = f"{scratch(spark, 'mapped-fields')}/lines"
    raw = fx.raw_scored_rows(spark, d).withColumn("u", md5_unit(F.lit("line"), F.col("sample_id")))
    line = F.when(F.col("u") < 0.1, F.lit('{"input": "broken')).otherwise(
        F.to_json(F.struct(F.col("prompt").alias("input"), F.col("response").alias("output"), F.col("score").alias("rating"))))
    lines = raw.select(F.explode(F.when(F.col("u") > 0.9, F.array(line, F.lit(""))).otherwise(F.array(line))).alias("value"))
    lines.write.text(path)
    names = {"prompt_field": "input", "response_field": "output", "score_field": "rating"}
    rows = scored_files.parse_required_fields(scored_files.read_scored_lines(spark, path, **names), **names)
    return r6(rows.select("prompt", "response", "score", "status"))


def q_prompt_files(spark, d):
    """Prompts written as documents and read again, sections in order."""
    path = f"{scratch(spark, 'prompt-files')}/prompts"
    scored_files.write_prompt_files(fx.prompt_sections(spark, d), path)
    return scored_files.read_prompt_lines(spark, path, id_type="bigint")[0]


def q_run_history(spark, d):
    """A run log saved, its even runs saved again with half the loss, and each run read as last saved."""
    path = f"{scratch(spark, 'run-history')}/history"
    h = fx.eval_history(spark, d).select("run_id", "step", "val_loss")
    scored_files.write_history(h, path)
    again = h.filter(F.col("run_id") % 2 == 0).withColumn("val_loss", F.col("val_loss") / F.lit(2.0))
    scored_files.write_history(again, path)
    return r6(scored_files.read_history(spark, path).select("run_id", "step", "val_loss"))


def q_parse_required_fields(spark, d):
    raw = fx.raw_scored_rows(spark, d)
    return r6(scored_files.parse_required_fields(raw).select("sample_id", "prompt", "response", "score", "status"))


def q_synthetic_scores(spark, d):
    ids = fx.responses(spark, d).select("sample_id")
    return r6(synthetic.synthetic_scores(ids).select("sample_id", "quality", "response", "score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
