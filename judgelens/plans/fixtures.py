"""Deterministic judge-analysis inputs derived from the given tables.

Each builder turns the parquet tables into one of the library's input shapes (scored samples,
pair scores, run logs, proposals, prompt sections, judge replies, prompt/response pairs). The
same definitions are written as SQL in :mod:`judgelens.plans.oracle`, so DuckDB can check every
query. No wall clock and no ``rand()``: any noise comes from md5 of the row key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import md5_unit, round_half_up
from ..operators.prefix import Running, running
from ..session import cut_lineage
from ..sources.tables import table

SECTIONS = (("1-URGENT", 1, True), ("2-HIGH", 2, False), ("3-MEDIUM", 3, False))


def judged_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels as scored samples; two prompt versions' judge scores."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id")
    return j.select(
        F.col("doc_id").alias("sample_id"), "source", "lang", F.col("text").alias("response"),
        (F.lit(1) + F.lit(6) * F.col("quality") + F.lit(3) * (F.lit(1) - F.col("toxic"))).cast("double")
        .alias("human_score"),
        round_half_up(F.lit(1.0) + F.lit(9.0) * F.col("n_chars") / (F.col("n_chars") + F.lit(3000.0)), 1)
        .alias("judge_score"),
        F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.length("text") / F.lit(20.0) + F.lit(5.0)))
        .alias("judge_len"),
    )


def judged_versions(spark: SparkSession, d: str) -> DataFrame:
    """``judged_docs`` stacked by prompt version (1 = length-capped score, 2 = raw length score)."""
    j = judged_docs(spark, d)
    v = F.explode(F.array(
        F.struct(F.lit(1).alias("prompt_version"), F.col("judge_score").alias("score")),
        F.struct(F.lit(2).alias("prompt_version"), F.col("judge_len").alias("score"))))
    return (j.select("sample_id", "source", "lang", "response", "human_score", v.alias("v"))
            .select("sample_id", "source", "lang", "response", "human_score",
                    F.col("v.prompt_version").alias("prompt_version"),
                    F.col("v.score").alias("judge_score")))


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Line items grouped by supplier: heavily tied human scores, 0.1-grid judge scores."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("group_id"),
        (F.lit(1.0) + F.lit(9.0) * (F.col("l_quantity") - F.lit(1.0)) / F.lit(49.0)).alias("human_score"),
        round_half_up(F.lit(1.0) + F.lit(9.0) * F.col("l_extendedprice") / F.lit(105000.0), 1)
        .alias("judge_score"),
    )


def eval_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as evaluation logs: one run per user, steps numbered in (ts, event_id) order."""
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "value", "props")
    k = F.nullif(F.regexp_extract("props", r"([0-9]+)", 1), F.lit("")).try_cast("int")
    base = ev.select(
        F.col("user_id").alias("run_id"), "event_id", "ts", F.col("value").alias("val_loss"),
        ((k - F.lit(50)) / F.lit(50.0)).alias("kendall_tau"),
        (k / F.lit(50.0)).alias("score_entropy"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(k / F.lit(500.0))
        .alias("mean_self_consistency_var"),
        k.alias("k"), "props", F.lit(1.0).alias("_one"))
    numbered = running(base, ["run_id"], ["ts", "event_id"], [Running("step", "sum", "_one")])
    # Materialised once: every monitor query reads the run log several times.
    return cut_lineage(numbered).select("run_id", F.col("step").cast("bigint").alias("step"), "val_loss",
                           "kendall_tau", "score_entropy", "mean_self_consistency_var", "ts", "k",
                           "props")


def strata_samples(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.select(F.col("o_orderkey").alias("sample_id"),
                    round_half_up(F.lit(1.0) + F.lit(9.0) * F.col("o_totalprice") / F.lit(500000.0), 2)
                    .alias("human_score"))


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Edit proposals from orders: every rule of the audit cascade is hit."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    key = F.col("o_orderkey")
    action = (F.when(key % 5 == 0, "edit").when(key % 5 == 1, "add").when(key % 5 == 2, "remove")
              .when(key % 5 == 3, "rename").otherwise(F.lit(None).cast("string")))
    direction = (F.when(key % 3 == 0, F.lit(None).cast("string")).when(key % 3 == 1, F.lit(""))
                 .otherwise(F.concat(F.lit("tighten criteria for "), F.col("o_orderpriority"))))
    content = (F.when(key % 4 == 0, F.lit("   "))
               .when(key % 4 == 1, F.lit("NO_MODIFICATION"))
               .when(key % 4 == 2, F.concat(F.lit("Here you go:\n```text\n  rubric for "),
                                            F.col("o_orderpriority"), F.lit(" v"), key.cast("string"),
                                            F.lit("  \n```\nthanks")))
               .otherwise(F.concat(F.lit("  plain rubric "), key.cast("string"), F.lit("\n"))))
    return o.select(
        key.alias("proposal_id"), F.col("o_custkey").alias("prompt_id"), key.alias("seq"),
        action.alias("action"),
        F.when(key % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
        .alias("section_name"),
        direction.alias("opti_direction"), content.alias("content"),
        ((key % 11) / F.lit(10.0)).alias("learning_rate"))


def prompt_sections(spark: SparkSession, d: str) -> DataFrame:
    """Version-1 prompt per customer: one meta section and two editable ones."""
    c = table(spark, d, "customer").select("c_custkey")
    arr = F.array(*[F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("section"),
                             F.lit(meta).alias("is_meta")) for name, pos, meta in SECTIONS])
    return (c.select(F.col("c_custkey").alias("prompt_id"), F.explode(arr).alias("s"))
            .select("prompt_id", F.lit(1).alias("version"), F.col("s.pos").alias("pos"),
                    F.col("s.section").alias("section"),
                    F.concat(F.lit("criteria "), F.col("s.section"), F.lit(" for customer "),
                             F.col("prompt_id").cast("string")).alias("content"),
                    F.col("s.is_meta").alias("is_meta")))


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Free-text judge replies; each carries the whole document after the verdict."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    m, n = F.col("doc_id") % 6, (F.col("doc_id") % 10).cast("string")
    head = (F.when(m == 0, F.concat(F.lit("Score: "), n, F.lit(".5\nReasoning follows.")))
            .when(m == 1, F.concat(F.lit("The rating:"), n, F.lit(" seems fair")))
            .when(m == 2, F.concat(F.lit("Some text\n"), n, F.lit("\nmore text")))
            .when(m == 3, F.concat(F.lit("I think about "), n, F.lit(" out of 10")))
            .when(m == 4, F.lit("I give .5"))
            .otherwise(F.lit("no verdict given")))
    reply = F.concat(head, F.lit("\n"), F.col("text"))
    return docs.select(F.col("doc_id").alias("sample_id"), reply.alias("reply"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with the user turn just before them as the prompt, empty if there is none."""
    cv = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    a = cv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    u = cv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                   F.col("text").alias("prompt"))
    return (a.join(u, ["conv_id", "turn"], "left").withColumn("prompt", F.coalesce("prompt", F.lit("")))
            .select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                    .alias("sample_id"), "prompt", "response"))


def raw_scored_rows(spark: SparkSession, d: str) -> DataFrame:
    """``responses`` as loosely typed input rows: some responses missing, scores as text."""
    r = responses(spark, d)
    u = md5_unit(F.lit("raw"), F.col("sample_id"))
    score = (F.when(u < 0.1, F.lit(None).cast("string"))
             .when(u < 0.2, F.lit("abc"))
             .when(u < 0.3, F.lit("true"))
             .otherwise(F.format_string("%.2f", round_half_up(F.lit(1.0) + F.lit(9.0) * u, 2))))
    resp = F.when(md5_unit(F.lit("resp"), F.col("sample_id")) < 0.1,
                  F.lit(None).cast("string")).otherwise(F.col("response"))
    prompt = F.when(md5_unit(F.lit("prm"), F.col("sample_id")) < 0.2,
                    F.lit(None).cast("string")).otherwise(F.col("prompt"))
    return r.select("sample_id", prompt.alias("prompt"), resp.alias("response"), score.alias("score"))


def gradient_replies(spark: SparkSession, d: str) -> DataFrame:
    """Free-text replies carrying a JSON list of prompt modifications, one per order: fenced
    JSON, JSON inside prose with a Python literal and trailing commas, several edits, or none."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    reply = (F.when(k % 4 == 0, F.concat(
                F.lit('```json\n{"modifications": [{"action": "edit", "section_name": "'), prio,
                F.lit('", "opti_direction": "be stricter"}]}\n```')))
             .when(k % 4 == 1, F.concat(
                F.lit('Here is the gradient: {"modifications": [{"action": "add", "section_name": "Extra '),
                (k % 7).cast("string"), F.lit('", "opti_direction": "add rules", "structural": True},]} done')))
             .when(k % 4 == 2, F.lit('{"modifications": [{"action": "remove", "section_name": "3-MEDIUM"}, '
                                     '{"action": "edit", "section_name": "2-HIGH", "opti_direction": "tighten"}]}'))
             .otherwise(F.concat(F.lit("no json in this reply for "), prio)))
    return o.select(k.alias("reply_id"), F.col("o_custkey").alias("prompt_id"), reply.alias("reply"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Line items as ratings: parts scored by several suppliers, each with a bias of its own."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return li.select(F.col("l_partkey").alias("sample_id"), F.col("l_suppkey").alias("annotator"),
                     (F.lit(1.0) + F.lit(9.0) * (F.col("l_quantity") - F.lit(1.0)) / F.lit(49.0)
                      + (F.col("l_suppkey") % 7) / F.lit(10.0)).alias("score"))


MODALS = ("can", "should", "must", "always")


def section_updates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as prompt sections before and after an update, and the update's learning rate: sections left
    alone, with another modal word, with text added, emptied (NULL), removed and new."""
    cv = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").withColumn("k", (F.col("conv_id") * 7 + F.col("turn")) % 6)
    word = lambda off: F.element_at(F.array(*[F.lit(m) for m in MODALS]), ((F.col("conv_id") + F.col("turn") + off) % 4 + 1).cast("int"))
    body = lambda off: F.concat(F.lit("You "), word(off), F.lit(" reward detail. "), F.col("text"))
    old_text = F.when((F.col("conv_id") + F.col("turn")) % 17 != 0, body(0))
    new_text = (F.when(F.col("k") == 0, old_text).when(F.col("k") == 1, body(2))
                .when(F.col("k") == 2, F.concat(body(0), F.lit(" Scores MUST always follow the scale.")))
                .when(F.col("k") == 4, F.concat(body(0), F.repeat(F.lit(" Be strict."), (F.col("conv_id") % 30).cast("int")))))
    key = [F.col("conv_id").alias("prompt_id"), F.concat(F.substring("role", 1, 1), F.col("turn").cast("string")).alias("section")]
    old = cv.filter("role = 'assistant'").select(*key, old_text.alias("content"))
    new = cv.filter("k <> 3 and (role = 'assistant' or turn % 3 = 0)").select(*key, new_text.alias("content"))
    rates = cv.filter("conv_id % 13 <> 0").select(F.col("conv_id").alias("prompt_id"), ((F.col("conv_id") % 11) / F.lit(10.0)).alias("learning_rate")).distinct()
    return old, new, rates
