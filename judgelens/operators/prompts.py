"""Prompt versions as tables: section classes, edit application, rendering, diffs, version log.

A prompt is rows ``(prompt_id, version, pos, section, content, is_meta)``; ``pos`` is the
render order, so it is a real column and never a map key.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import (CLIP_DIFF_CHARS, CLIP_LOG_CHARS, VERSION_METRIC_LINE, VERSION_METRICS,
                               VERSION_RATIONALE, VERSION_SUMMARY, VERSION_TITLE, VERSION_TRAIN_LOSS,
                               VERSION_VAL_LOSS, clip_text)
from ..session import cut_lineage
from .keys import join_on


def section_classes(sections: DataFrame) -> DataFrame:
    """Meta (frozen) or editable per section; editable means present and not meta."""
    return sections.select("prompt_id", "version", "pos", "section", "is_meta",
                           (~F.col("is_meta")).alias("is_editable"))


def get_section(sections: DataFrame, prompt_id, section: str) -> DataFrame:
    return sections.filter((F.col("prompt_id") == F.lit(prompt_id)) & (F.col("section") == F.lit(section)))


def lookup_sections(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request ``(prompt_id, version, section, ...)`` the content of that section and whether
    it exists; a request for what does not exist keeps its row, with NULL content."""
    at = sections.select("prompt_id", "version", "section", "content", F.lit(True).alias("found"))
    out = join_on(requests, at, ["prompt_id", "version", "section"], "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def render_prompt(sections: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``## name`` / content / blank line per section in ``pos`` order, joined by newlines. A NULL content
    is an empty one: the section keeps its heading."""
    keys = keys or ["prompt_id", "version"]
    parts = F.sort_array(F.collect_list(F.struct("pos", "section", "content")))
    text = F.array_join(F.transform(parts, lambda s: F.concat(F.lit("## "), s["section"], F.lit("\n"),
                                                             F.coalesce(s["content"], F.lit("")), F.lit("\n"))), "\n")
    return sections.groupBy(*keys).agg(text.alias("text"), F.count(F.lit(1)).alias("n_sections"))


def newest_sections(sections: DataFrame) -> DataFrame:
    """The sections of each prompt's newest version."""
    base = sections.select("prompt_id", "version", "pos", "section", "content", "is_meta")
    newest = base.groupBy("prompt_id").agg(F.max("version").alias("version"))
    return base.join(newest, ["prompt_id", "version"], "left_semi")


def apply_edits(sections: DataFrame, edits: DataFrame, new_version: int | None = None) -> DataFrame:
    """Apply accepted edits in ``seq`` order to each prompt, as one set operation.

    ``edits(prompt_id, seq, action, section_name, content)`` holds only applicable actions
    (edit / add upsert a section, remove deletes it). Edit and add are both upserts; removing a
    missing section does nothing; meta sections are never changed. The final content of a
    section is its last action's; an updated section keeps its place, a new or re-added one goes
    after the existing ones in the order it was (re)inserted. Per-section facts come from
    aggregates (partial, map-side), not from replaying the sequence. Of several versions of a
    prompt the newest is edited.
    """
    base = newest_sections(sections)
    meta = base.filter("is_meta").select("prompt_id", F.col("section").alias("section_name"))
    # Read twice below (history and reinsertion point): materialise once, so an expensive
    # upstream (the proposal audit) is not derived twice.
    e = cut_lineage(edits.filter(F.col("action").isin("edit", "add", "remove"))
                    .join(meta, ["prompt_id", "section_name"], "left_anti")
                    .select("prompt_id", "seq", "action", "section_name", "content"))
    upsert = F.col("action").isin("edit", "add")
    hist = e.groupBy("prompt_id", F.col("section_name").alias("section")).agg(
        F.max_by("action", "seq").alias("_last_action"),
        F.max_by(F.when(upsert, F.col("content")), F.when(upsert, F.col("seq"))).alias("_last_content"),
        F.max(F.when(F.col("action") == "remove", F.col("seq"))).alias("_last_remove"))
    # The first upsert after the last remove is when the section was (re)inserted at the end.
    after = (e.select("prompt_id", F.col("section_name").alias("section"), "seq", "action")
             .join(hist.select("prompt_id", "section", "_last_remove"), ["prompt_id", "section"])
             .filter(upsert & (F.col("seq") > F.coalesce(F.col("_last_remove"), F.lit(-1))))
             .groupBy("prompt_id", "section").agg(F.min("seq").alias("_reinsert")))
    hist = hist.join(after, ["prompt_id", "section"], "left")
    versions = base.groupBy("prompt_id").agg(F.max("version").alias("_v"), F.max("pos").alias("_maxpos"))
    j = base.join(hist, ["prompt_id", "section"], "full_outer").join(versions, "prompt_id", "left")
    exists = F.col("pos").isNotNull()
    kept = F.when(F.col("_last_action").isNull(), exists).otherwise(F.col("_last_action") != "remove")
    in_place = exists & F.col("_last_remove").isNull()
    j = j.filter(kept).withColumn("_in_place", in_place)
    order_key = F.when(F.col("_in_place"), F.col("pos").cast("bigint")).otherwise(F.col("_reinsert"))
    w = Window.partitionBy("prompt_id").orderBy(F.col("_in_place").desc(), order_key)
    version = F.lit(new_version) if new_version is not None else F.coalesce(F.col("_v"), F.lit(0)) + 1
    return j.select(
        "prompt_id", version.cast("int").alias("version"),
        F.row_number().over(w).cast("int").alias("pos"), "section",
        F.when(F.col("_last_action").isin("edit", "add"), F.col("_last_content"))
        .otherwise(F.col("content")).alias("content"),
        F.coalesce(F.col("is_meta"), F.lit(False)).alias("is_meta"))


def applied_edit_counts(edits: DataFrame, sections: DataFrame) -> DataFrame:
    """Per prompt, how many edits were attempted and how many were applied to its newest version.

    Edits of a meta section and other actions are not applied, nor is the removal of a section that
    does not stand at that point: it does after an edit or add, or untouched in the prompt.
    """
    base = newest_sections(sections).select("prompt_id", F.col("section").alias("section_name"), "is_meta")
    w = Window.partitionBy("prompt_id", "section_name").orderBy("seq")
    known = F.col("action").isin("edit", "add", "remove")
    x = edits.select("prompt_id", "section_name", "seq", "action").join(base, ["prompt_id", "section_name"], "left")
    x = x.withColumn("_before", F.last(F.when(known, F.col("action")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    stands = F.when(F.col("_before").isNull(), F.col("is_meta").isNotNull()).otherwise(F.col("_before") != "remove")
    applied = known & ~F.coalesce("is_meta", F.lit(False)) & ((F.col("action") != "remove") | stands)
    return x.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_attempted"), F.count_if(applied).alias("n_applied"))


def section_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both texts of every section that stands in either version of a prompt, and its status: added,
    removed, changed or unchanged. A section whose content is NULL stands all the same."""
    o = old.select("prompt_id", "section", F.col("content").alias("old_content"), F.lit(True).alias("_old"))
    n = new.select("prompt_id", "section", F.col("content").alias("new_content"), F.lit(True).alias("_new"))
    j = join_on(o, n, ["prompt_id", "section"], "full_outer")
    status = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(~F.col("old_content").eqNullSafe(F.col("new_content")), "changed").otherwise("unchanged"))
    return j.select("prompt_id", "section", status.alias("status"), "old_content", "new_content")


def section_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added / removed / changed / unchanged sections between two versions of each prompt,
    with previews clipped to 100 characters plus ``...``."""
    return section_pairs(old, new).select(
        "prompt_id", "section", "status", clip_text(F.col("old_content"), CLIP_DIFF_CHARS).alias("old_preview"),
        clip_text(F.col("new_content"), CLIP_DIFF_CHARS).alias("new_preview"))


def _four(c: str) -> Column:
    """The value with 4 decimals; a missing one reads ``nan``."""
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v), "nan").otherwise(F.call_function("format_number", v, F.lit("0.0000")))


def _message(step: str, train_loss: str, val_loss: str, metrics: list[str]) -> Column:
    """The version message; lines of missing metrics and of an empty rationale are left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    metric = [F.when(F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")), F.format_string(VERSION_METRIC_LINE, F.lit(m), _four(m)))
              for m in metrics]
    why = F.when(text("rationale_clipped") != "", F.concat_ws("\n", F.lit(""), F.lit(VERSION_RATIONALE),
                                                             F.col("rationale_clipped")))
    return F.concat_ws("\n", F.format_string(VERSION_TITLE, F.col(step).cast("bigint")), F.lit(""),
                       F.format_string(VERSION_TRAIN_LOSS, _four(train_loss)),
                       F.format_string(VERSION_VAL_LOSS, _four(val_loss)), F.lit(""), F.lit(VERSION_METRICS), *metric,
                       F.lit(""), F.lit(VERSION_SUMMARY), text("summary_clipped"), why)


def version_log(evals: DataFrame, summary: str = "gradient_summary", rationale: str = "rationale",
                step: str = "step", train_loss: str = "train_loss", val_loss: str = "val_loss",
                metrics: list[str] | None = None) -> DataFrame:
    """Version-log rows: summary and rationale clipped to 200 characters plus ``...``, and the
    version message (title, both losses, the metrics present, summary, rationale if any)."""
    metrics = list(metrics or [])
    out = evals.select("*", clip_text(F.col(summary), CLIP_LOG_CHARS).alias("summary_clipped"),
                       clip_text(F.col(rationale), CLIP_LOG_CHARS).alias("rationale_clipped"))
    if train_loss in out.columns:
        out = out.withColumn("message", _message(step, train_loss, val_loss, metrics))
    return out


#: Columns that the version table adds: the commit that wrote a row, its time, and the run's folder.
_COMMIT = ["commit_key", "committed_in", "run_bucket"]


def append_versions(versions: DataFrame, path: str, commit_key: str | None = None, buckets: int = 64) -> int:
    """Commit rows to the version table once: a repeated commit of the same key changes nothing. Without a
    key each call is a commit of its own.

    Rows are appended as Parquet into ``buckets`` folders by the run's hash, whatever the number of runs,
    and never rewritten. A commit whose key is in the table already is skipped (a filter pushed to
    the scan of one column); of two that run at the same time both may write, and
    :func:`read_versions` shows the first. Returns the rows written, 0 if the commit was there.
    """
    spark, commit_key = versions.sparkSession, commit_key or uuid.uuid4().hex
    if table_exists(spark, path) and not spark.read.parquet(path).filter(F.col("commit_key") == commit_key).isEmpty():
        return 0
    # one attempt for the whole call tells concurrent writers of a key apart; the checkpoint fixes what is written and counted
    rows = cut_lineage(versions.withColumns({"commit_key": F.lit(commit_key), "committed_in": F.lit(uuid.uuid4().hex),
                                             "run_bucket": F.pmod(F.xxhash64("run_id"), F.lit(buckets))}))
    rows.repartition("run_bucket").write.mode("append").partitionBy("run_bucket").parquet(path)
    return rows.count()


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table can be read at ``path``, on any file system that Spark reads."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows, each commit once: where two writers of a key met, those of the smaller attempt."""
    rows = spark.read.parquet(path)
    first = rows.groupBy("commit_key").agg(F.min("committed_in").alias("committed_in"))
    return rows.join(first, ["commit_key", "committed_in"], "left_semi").drop(*_COMMIT)


def compact_versions(spark: SparkSession, path: str, to: str, buckets: int = 64) -> None:
    """Write the table anew at ``to``, a file for each of the folders; commits and their keys are kept, rows of writers
    that lost are not. Readers move to ``to`` once this returns; ``path`` is left as it is."""
    rows = spark.read.parquet(path)
    first = rows.groupBy("commit_key").agg(F.min("committed_in").alias("committed_in"))
    kept = rows.join(first, ["commit_key", "committed_in"], "left_semi").withColumn(
        "run_bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)))
    kept.repartition("run_bucket").write.partitionBy("run_bucket").parquet(to)


def version_history(versions: DataFrame, max_count: int = 10, keys: list[str] | None = None,
                    ts: str = "committed_at") -> DataFrame:
    """Latest ``max_count`` versions per run, newest first (a WindowGroupLimit top-k)."""
    keys = keys or ["run_id"]
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col("step").desc())
    return (versions.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= max_count)
            .withColumn("recency", F.col("recency").cast("bigint")))


def checkout_version(versions: DataFrame, tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve each request by tag, else step, else the ``best`` tag; latest tag row wins.

    ``requests(run_id, tag, step)``, ``tags(run_id, tag, step, tagged_at)``.
    """
    t = tags.groupBy("run_id", "tag").agg(
        F.max_by("step", F.struct("tagged_at", "step")).alias("step"))
    r = requests.select("run_id", F.col("tag").alias("_req_tag"), F.col("step").alias("_req_step"))
    by_tag = t.select("run_id", F.col("tag").alias("_req_tag"), F.col("step").alias("_tag_step"))
    best = t.filter(F.col("tag") == "best").select("run_id", F.col("step").alias("_best_step"))
    j = r.join(by_tag, ["run_id", "_req_tag"], "left").join(best, "run_id", "left")
    how = (F.when(F.col("_req_tag").isNotNull(), "tag").when(F.col("_req_step").isNotNull(), "step")
           .otherwise("best"))
    # A tag or step that does not exist checks nothing out: status "missing", no loss.
    step = (F.when(F.col("_req_tag").isNotNull(), F.col("_tag_step"))
            .when(F.col("_req_step").isNotNull(), F.col("_req_step")).otherwise(F.col("_best_step")))
    res = j.select("run_id", how.alias("resolved_by"), step.alias("step"))
    found = versions.withColumn("status", F.lit("found"))
    return res.join(found, ["run_id", "step"], "left").fillna("missing", subset=["status"])
