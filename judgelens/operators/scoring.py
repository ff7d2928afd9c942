"""Bulk scoring: pluggable scorers, repeated scoring for self-consistency, score parsing.

A scorer is either a Column expression (stays in whole-stage codegen) or an Arrow
``pandas_udf(prompt, response) -> double`` that is called once per batch of rows; Spark's
partitions replace the reference's thread pool. Order is carried by ``sample_id``, not by
row position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import extract_score, md5_normal
from .keys import join_on

Scorer = Column | Callable[[Column, Column], Column]


def length_judge(response: Column, *noise_key: Column | str) -> Column:
    """Length-based reference judge: clip(len/20 + N(5, 1), 1, 10), noise from md5 of the key."""
    noise = md5_normal(*noise_key) if noise_key else F.lit(0.0)
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.length(response) / F.lit(20.0) + F.lit(5.0) + noise))


def _apply(scorer: Scorer, df: DataFrame, prompt: str, response: str) -> Column:
    if isinstance(scorer, Column):
        return scorer
    return scorer(F.col(prompt), F.col(response))


def score_responses(df: DataFrame, scorer: Scorer, prompt: str = "prompt", response: str = "response",
                    out: str = "judge_score") -> DataFrame:
    """One score per row (an empty input gives an empty output)."""
    return df.withColumn(out, _apply(scorer, df, prompt, response))


def self_consistency(df: DataFrame, scorer_for_repeat: Callable[[Column], Column], n_samples: int = 3,
                     keys: list[str] | None = None, id_col: str = "sample_id") -> DataFrame:
    """Score every row ``n_samples`` times; per row the mean, population variance (0.0 when
    ``n_samples`` is 1) and the scores in repeat order.

    ``scorer_for_repeat(rep)`` returns the score Column for repeat number ``rep`` (1-based),
    so a stochastic judge can seed each repeat. Repeats are exploded from a sequence, never
    joined, and aggregated with map-side partial aggregation.
    """
    if n_samples < 1:
        raise ValueError("n_samples must be >= 1")
    keys = list(keys or [])
    rep = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    scored = rep.withColumn("_s", scorer_for_repeat(F.col("rep")))
    return scored.groupBy(*keys, id_col).agg(
        F.avg("_s").alias("mean_score"),
        F.var_pop("_s").alias("variance"),
        F.count("_s").alias("n_scores"),
        F.transform(F.sort_array(F.collect_list(F.struct("rep", "_s"))), lambda x: x["_s"]).alias("scores"))


def mean_self_consistency_variance(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg("variance").alias("mean_self_consistency_var"))


def extract_scores(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Parse the numeric score out of free-text judge replies (5.0 and a flag when none)."""
    score, fallback = extract_score(F.col(reply))
    return df.withColumns({"score": score, "used_fallback": fallback})


def judge_human_join(judge_scores: DataFrame, human_scores: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Judge and human scores of the same samples, matched by id instead of array position."""
    return judge_scores.join(human_scores, id_col)


def unscored_pairs(candidates: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate (version, sample) pairs that have no score yet: score only these."""
    return candidates.join(scored.select(*keys).distinct(), keys, "left_anti")


def prompt_version_compare(df: DataFrame, version_a, version_b, keys: list[str] | None = None,
                           id_col: str = "sample_id", version_col: str = "prompt_version",
                           human: str = "human_score", judge: str = "judge_score") -> DataFrame:
    """Per sample: both versions' scores and absolute errors, the change and its outcome."""
    keys = list(keys or [])
    a = df.filter(F.col(version_col) == F.lit(version_a)).select(
        *keys, id_col, human, F.col(judge).alias("score_a"))
    b = df.filter(F.col(version_col) == F.lit(version_b)).select(
        *keys, id_col, F.col(judge).alias("score_b"))
    j = join_on(a, b, [*keys, id_col])
    ea, eb = F.abs(F.col("score_a") - F.col(human)), F.abs(F.col("score_b") - F.col(human))
    return j.select(*keys, id_col, human, "score_a", "score_b", ea.alias("abs_error_a"),
                    eb.alias("abs_error_b"), (eb - ea).alias("abs_error_delta"),
                    F.when(eb < ea, "better").when(eb == ea, "same").otherwise("worse").alias("outcome"))


def version_compare_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("outcome") == "better", 1)).alias("n_better"),
        F.count(F.when(F.col("outcome") == "same", 1)).alias("n_same"),
        F.count(F.when(F.col("outcome") == "worse", 1)).alias("n_worse"),
        F.avg("abs_error_a").alias("mae_a"),
        F.avg("abs_error_b").alias("mae_b"))
