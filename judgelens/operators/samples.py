"""Error-sample selection, its statistics and its text rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keys import join_on, with_group_row
from ..functions.exprs import (CATEGORY_LABELS, CLIP_SAMPLE_CHARS, EMPTY_CATEGORY_FORMAT,
                               SAMPLE_FORMAT, clip_text)

CATEGORIES = ("overestimated", "underestimated", "well_aligned")


def error_samples(df: DataFrame, keys: list[str], k: int = 3, id_col: str = "sample_id",
                  human: str = "human_score", judge: str = "judge_score",
                  extra: list[str] | None = None) -> DataFrame:
    """Top-``k`` rows per group in three classes: largest positive error, most negative error,
    smallest absolute error (over all rows). Ties break on ``id_col``.

    ``row_number() <= k`` becomes a WindowGroupLimit: each partition keeps its own top k
    before the shuffle, so a hot group sends at most k rows per partition.
    """
    extra = extra or []
    e = F.col(judge) - F.col(human)
    # Only scored rows have an error; NULL and NaN scores are in no class.
    x = (df.select(*keys, id_col, human, judge, *extra, e.alias("error"), F.abs(e).alias("abs_error"))
         .filter(F.col("error").isNotNull() & ~F.isnan(F.col("error").cast("double"))))
    # One scan: a row stands once for its sign and once for its closeness, each with a sort key.
    classes = F.inline(F.filter(F.array(
        F.struct(F.when(F.col("error") > 0, "overestimated").when(F.col("error") < 0, "underestimated")
                 .alias("category"), (-F.col("abs_error")).alias("_by")),
        F.struct(F.lit("well_aligned").alias("category"), F.col("abs_error").alias("_by"))),
        lambda c: c["category"].isNotNull()))
    w = Window.partitionBy(*keys, "category").orderBy("_by", id_col)
    out = x.select("*", classes).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(*keys, id_col, human, judge, *extra, "error", "abs_error",
                      F.col("rank").cast("bigint").alias("rank"), "category")


def error_statistics(df: DataFrame, keys: list[str], k: int = 3, id_col: str = "sample_id",
                     human: str = "human_score", judge: str = "judge_score") -> DataFrame:
    """Counts and mean/extreme errors of the selected rows per class (0.0 for an empty class),
    the overall MAE / bias / population std of the error, and all-row class totals."""
    k_cols = list(keys)
    # Read by the selection and by the totals; often a join of judge and human scores, so kept, without texts.
    df = cut_lineage(df.select(*k_cols, id_col, human, judge))
    sel = error_samples(df, k_cols, k, id_col, human, judge)
    cat = F.col("category")

    def cond(c: str, expr):
        return F.when(cat == c, expr)
    chosen = sel.groupBy(*k_cols).agg(
        F.count(cond("overestimated", F.lit(1))).alias("over_count"),
        F.avg(cond("overestimated", F.col("error"))).alias("over_mean_error"),
        F.max(cond("overestimated", F.col("error"))).alias("over_max_error"),
        F.count(cond("underestimated", F.lit(1))).alias("under_count"),
        F.avg(cond("underestimated", F.col("error"))).alias("under_mean_error"),
        F.min(cond("underestimated", F.col("error"))).alias("under_min_error"),
        F.count(cond("well_aligned", F.lit(1))).alias("aligned_count"),
        F.avg(cond("well_aligned", F.col("abs_error"))).alias("aligned_mean_abs_error"))
    e = F.col(judge) - F.col(human)
    overall = df.groupBy(*k_cols).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg(F.abs(e)).alias("overall_mae"),
        F.avg(e).alias("overall_mean_error"),
        F.stddev_pop(e).alias("overall_std_error"),
        F.count(F.when(e > 0, 1)).alias("over_total"),
        F.count(F.when(e < 0, 1)).alias("under_total"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return with_group_row(overall, chosen, k_cols, "left").select(
        *k_cols, "total_samples",
        F.coalesce(F.col("over_count"), F.lit(0)).cast("bigint").alias("over_count"),
        z("over_mean_error"), z("over_max_error"),
        F.coalesce(F.col("under_count"), F.lit(0)).cast("bigint").alias("under_count"),
        z("under_mean_error"), z("under_min_error"),
        F.coalesce(F.col("aligned_count"), F.lit(0)).cast("bigint").alias("aligned_count"),
        z("aligned_mean_abs_error"), "overall_mae", "overall_mean_error", "overall_std_error",
        "over_total", "under_total")


def format_error_samples(df: DataFrame, keys: list[str], k: int = 3, id_col: str = "sample_id",
                         text_col: str = "response", human: str = "human_score",
                         judge: str = "judge_score") -> DataFrame:
    """One text block per (group, class): numbered samples (text clipped to 200 chars + '...')
    with both scores and the signed error, or the 'no samples' line for an empty class."""
    k_cols = list(keys)
    sel = error_samples(df, k_cols, k, id_col, human, judge, extra=[text_col])
    one = lambda c, pattern="0.0": F.call_function("format_number", F.col(c).cast("double"), F.lit(pattern))
    lines = sel.withColumn("_line", F.format_string(
        SAMPLE_FORMAT, F.col("rank"), F.coalesce(clip_text(F.col(text_col), CLIP_SAMPLE_CHARS), F.lit("")),
        one(human), one(judge), one("error", "+0.0;-0.0")))
    blocks = lines.groupBy(*k_cols, "category").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_line"))),
                                 lambda s: s["_line"]), "").alias("text"))
    cats = F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category")
    groups = df.groupBy(*k_cols).agg(F.count(F.lit(1))).select(*k_cols, cats)
    label = F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.lit(CATEGORY_LABELS[c]))])
    return join_on(groups, blocks, [*k_cols, "category"], "left").select(
        *k_cols, "category",
        F.coalesce(F.col("text"), F.format_string(EMPTY_CATEGORY_FORMAT, label[F.col("category")]))
        .alias("text"))
