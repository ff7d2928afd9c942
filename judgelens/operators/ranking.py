"""Exact rank statistics per group without emitting pairs.

Kendall's tau-b and the pairwise ranking loss are sums over all pairs of a group. Instead of a
self-join (quadratic, and quadratic in the hottest group), every pair count is a count of
rows below in both scores.

Groups that fit one task (checked) are dealt out whole, sorted once and counted block by block with
numpy (:mod:`.dominance`): each row is shuffled once and copied for no level.

Larger groups are counted with prefix sums over one ordered key (:func:`prefix_before`), which
splits hot keys across tasks:

* rows are first collapsed to cells ``(group, h, j) -> w`` (map-side combine, so tied scores
  cost nothing), and the cells are checkpointed once because every pass reads them;
* "h_a < h_b" alone is a prefix over ``h`` within the group;
* "h_a < h_b and j_a == j_b" is a prefix over ``h`` within ``(group, j)``;
* "h_a < h_b and j_a < j_b" (2-D dominance) is split over the bits of the dense rank of ``j``:
  ``r_a < r_b`` holds at exactly one bit level ``l`` where ``r_a`` and ``r_b`` agree above
  ``l``, ``r_a`` has 0 and ``r_b`` has 1. So per level it is a prefix over ``h`` within
  ``(group, l, r >> (l+1))``. Work is O(cells * log(distinct j)).

All three prefixes run as one pass over ``(group, level, part)`` keys (the first two as two
extra pseudo-levels). Dense ranks, tie counts and Spearman's average ranks come from distributed
running passes. Spearman is then a centred Pearson correlation of the average ranks. All
results are exact. Human scores at most 1e-6 apart (``CLEAR_GAP``) express no preference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .dominance import grouped_pairs
from .keys import join_on, with_group_row
from .prefix import Running, max_key_rows, prefix_before, running


#: Human scores at most this far apart express no preference in the pairwise loss (fixed value).
CLEAR_GAP = 1e-6

#: Rows that a group counted in one task stands for, at most: its pairs then fit 64 bits.
GROUP_ROWS = 1 << 31

#: Rows dealt to one task where whole groups are counted.
TASK_ROWS = 500_000

_EXACT = "decimal(18,0)"


def _scored(df: DataFrame, keys: list[str], human: str, judge: str, rows: str | None = None) -> DataFrame:
    """Rows with both scores and the number of rows each stands for; ``rows`` names a column that holds it."""
    h, j = F.col(human).cast("double"), F.col(judge).cast("double")
    w = F.col(rows) if rows else F.lit(1)
    return df.filter(h.isNotNull() & j.isNotNull()).select(  # adding 0 turns -0.0 into 0.0
        *keys, (h + F.lit(0.0)).alias("_h"), (j + F.lit(0.0)).alias("_j"), w.cast("double").alias("_w"))


def _cells(df: DataFrame, keys: list[str], human: str, judge: str, rows: str | None = None) -> DataFrame:
    """Cells of equal scores with their number of rows; ``rows`` names a column that holds numbers of rows."""
    return (_scored(df, keys, human, judge, rows).groupBy(*keys, "_h", "_j").agg(F.sum("_w").alias("_w"))
            .withColumn("_wh", F.col("_w") * F.col("_h")))


def _sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_w").alias("_of"))


def _too_large(limit: int) -> Column:
    return (F.col("_rows") > F.lit(limit)) | (F.col("_of") > F.lit(float(GROUP_ROWS)))


def _is_nan() -> Column:
    return F.isnan("_h") | F.isnan("_j")


def _pairs_of(count: Column) -> Column:
    """Number of pairs among ``count`` rows, exact (decimal)."""
    c = count.cast(_EXACT)
    return F.floor(c * (c - 1) / 2)


def _group_totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """n, tied-pair counts on h and on j (pairs, not rows) and whether a score is NaN, per group."""
    def tie_pairs(col: str, name: str) -> DataFrame:
        per = cells.groupBy(*keys, col).agg(F.sum("_w").alias("_c"))
        return per.groupBy(*keys).agg(F.sum(_pairs_of(F.col("_c"))).alias(name))
    n = cells.groupBy(*keys).agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("n"), F.max(_is_nan()).alias("has_nan"))
    out = with_group_row(n, tie_pairs("_h", "n_h_ties"), keys)
    return with_group_row(out, tie_pairs("_j", "n_j_ties"), keys)


_COUNTS = ("n_h_ties", "n_j_ties", "s", "clear_pairs")
_SUMS = ("mismatch_loss", "sxy", "sxx", "syy", "penalty")


def _statistics(df: DataFrame, keys: list[str], human: str, judge: str, spearman: bool = True, rows: str | None = None,
                margin: float = 0.0) -> DataFrame:
    """Per group: n, n_pairs, tie counts, S = concordant - discordant, clear pairs, the summed
    mismatch loss of the pairwise ranking loss (margin 0), the penalty of :func:`_margin_penalty` for a
    positive ``margin`` and, optionally, Spearman's sums.

    A NaN human score makes no clear pair, and no pair of a NaN judge score is concordant;
    ``has_nan`` marks the groups whose rank correlations are undefined for that reason.
    """
    return _by_size(df, keys, human, judge, rows, lambda x, count: _whole_groups(x, keys, count, spearman, margin),
                    lambda cells: _split_groups(cells, keys, spearman, margin))


def _by_size(df: DataFrame, keys: list[str], human: str, judge: str, rows: str | None,
             whole: Callable[[DataFrame, int], DataFrame], split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of the scored rows and their number, if every group fits one task, or of the cells, if those do;
    else ``split`` of the cells of the larger groups and ``whole`` of the others."""
    limit = max_key_rows(df.sparkSession)

    def measured(rows: DataFrame) -> tuple[int, bool]:
        row = _sizes(rows, keys).agg(F.sum("_rows").alias("all"), F.max(_too_large(limit)).alias("large")).first()
        return row["all"] or 0, bool(row["large"])
    scored = _scored(df, keys, human, judge, rows)
    count, large = measured(scored)
    if not large:
        return whole(scored, count)
    # Cells are read by every pass below: materialise them once in the checkpoint folder.
    cells = cut_lineage(_cells(df, keys, human, judge, rows))
    count, large = measured(cells)
    if not large:
        return whole(cells, count)
    if not keys:
        return split(cells)
    hot = _sizes(cells, keys).filter(_too_large(limit)).select(*keys)
    return split(join_on(cells, hot, keys, "left_semi")).unionByName(whole(join_on(cells, hot, keys, "left_anti"), count))


def _statistic_cols(spearman: bool, margin: float) -> list[str]:
    return ["n_pairs", "n_h_ties", "n_j_ties", "s", "has_nan", "clear_pairs", "mismatch_loss",
            *(["sxy", "sxx", "syy"] if spearman else []), *(["penalty"] if margin > 0.0 else [])]


def _whole_groups(rows: DataFrame, keys: list[str], count: int, spearman: bool, margin: float) -> DataFrame:
    """The statistics of groups that each fit one task: ``count`` rows, dealt out by group and sorted once."""
    if keys:
        few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(max(min(few, 1 + count // 10_000), 1 + count // TASK_ROWS), *keys)
    order = ["_h", "_j"]
    marked = rows.select(*keys, "_h", "_j", "_w",
                         (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1).alias("_first"))
    marked = marked.sortWithinPartitions(*keys, *order)  # the window's own order
    names = ["n", "has_nan", *_COUNTS, *_SUMS]
    kinds = {"n": T.LongType(), "has_nan": T.BooleanType(), **{c: T.LongType() for c in _COUNTS}, **{c: T.DoubleType() for c in _SUMS}}
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, kinds[c]) for c in names]])
    out = marked.mapInArrow(grouped_pairs(CLEAR_GAP, float(margin), names), schema)
    if not keys:  # one group, without rows too
        out = out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("has_nan").alias("has_nan"),
                      *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS], *[F.sum(c).alias(c) for c in _SUMS])
        out = out.fillna(0.0, subset=["mismatch_loss"])
    wide = [F.col(c).cast("decimal(38,0)").alias(c) for c in _COUNTS]
    out = out.select(*keys, F.col("n").cast("double").alias("n"), "has_nan", *wide, *_SUMS)
    return out.withColumn("n_pairs", _pairs_of(F.col("n"))).select(*keys, "n", *_statistic_cols(spearman, margin))


def _split_groups(cells: DataFrame, keys: list[str], spearman: bool, margin: float) -> DataFrame:
    """The statistics of groups that no single task can hold, from the cells of equal scores."""
    # Distributed running pass over the distinct j values, joined back.
    jd = cells.groupBy(*keys, "_j").agg(F.sum("_w").alias("_w"), F.lit(1.0).alias("_one"))
    jp = running(jd, keys, ["_j"], [Running("_jb", "sum", "_w", inclusive=False),
                                    Running("_jr", "sum", "_one", inclusive=False)], small=False)
    jp = jp.select(*keys, "_j", "_jb", F.col("_jr").cast("bigint").alias("_jr"))
    top = jp.groupBy(*keys).agg(F.max("_jr").alias("_maxr"))
    ranked = with_group_row(join_on(cells, jp, keys + ["_j"]), top, keys)
    totals = _group_totals(cells, keys)

    # All pair sums come from one prefix over h, keyed by (group, level, part):
    #   level -2, part = rank(j): pairs with h_a < h_b and equal j;
    #   level -1, part = 0:       pairs with h_a < h_b;
    #   level l >= 0, part = rank(j) >> (l + 1): pairs with h_a < h_b and j_a < j_b, split by
    #   the bit level at which the two dense ranks first differ.
    # Each row carries point weights (_p, _ph) and query weights: _q asks for h_a < h_b, _c and _ch
    # ask for clear pairs, h_a < h_b - CLEAR_GAP, from a row of their own at that score.
    levels = F.when(F.col("_maxr") >= 1, F.floor(F.log2(F.col("_maxr") + F.lit(0.5))).cast("int") + 1) \
        .otherwise(F.lit(0))
    ranked = ranked.withColumn("_levels", levels)
    exploded = (ranked.filter(~F.isnan("_h"))
                .withColumn("_l", F.explode(F.sequence(F.lit(-2), F.col("_levels") - 1)))
                .withColumn("_pk", F.when(F.col("_l") == -2, F.col("_jr")).when(F.col("_l") == -1, F.lit(0))
                            .otherwise(F.expr("shiftright(_jr, _l + 1)")))
                .withColumn("_bit", F.when(F.col("_l") < 0, F.lit(-1)).otherwise(F.expr("shiftright(_jr, _l) & 1"))))
    point, query = F.col("_bit") != 1, (F.col("_bit") != 0) & ~((F.col("_bit") == 1) & F.isnan("_j"))
    weigh = lambda c, w: F.when(c, F.col(w)).otherwise(F.lit(0.0))
    none = F.lit(0.0)

    def row(h, p, ph, q, c, ch):
        return F.struct(h.alias("_h"), p.alias("_p"), ph.alias("_ph"), q.alias("_q"), c.alias("_c"), ch.alias("_ch"))
    own = (F.col("_h"), weigh(point, "_w"), weigh(point, "_wh"), weigh(query, "_w"))
    asked = weigh(query, "_w"), weigh(query, "_wh")
    apart = F.array(row(*own, none, none), row(F.col("_h") - F.lit(CLEAR_GAP), none, none, none, *asked))
    rows = F.when(query & (F.col("_l") != -2), apart).otherwise(F.array(row(*own, *asked)))
    pts = exploded.select(*keys, "_l", "_pk", F.inline(rows))
    lv = prefix_before(pts, keys + ["_l", "_pk"], "_h", ["_p", "_ph", "_q", "_c", "_ch"], small=False)
    lvl = F.col("_l")
    count = lambda q: F.col(q).cast(_EXACT) * F.col("_p_before").cast(_EXACT)  # noqa: E731  exact pair counts
    sums = lv.groupBy(*keys).agg(
        F.sum(F.when(lvl == -1, count("_q"))).alias("a_lh"),                         # pairs with h_a < h_b
        F.sum(F.when(lvl == -2, count("_q"))).alias("a_ej"),                         # equal j, h below
        F.sum(F.when(lvl >= 0, count("_q"))).alias("a_ll"),                          # concordant
        F.sum(F.when(lvl == -1, count("_c"))).alias("clear"),
        F.sum(F.when(lvl == -1, F.col("_ch") * F.col("_p_before"))).alias("b_lh"),   # over clear pairs, h_b
        F.sum(F.when(lvl == -1, F.col("_c") * F.col("_ph_before"))).alias("c_lh"),   # h_a
        F.sum(F.when(lvl >= 0, F.col("_ch") * F.col("_p_before"))).alias("b_ll"),    # over the concordant ones, h_b
        F.sum(F.when(lvl >= 0, F.col("_c") * F.col("_ph_before"))).alias("c_ll"))    # h_a

    out = with_group_row(totals, sums, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    e = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)"))
    cols = [_pairs_of(F.col("n")).alias("n_pairs"), e("n_h_ties").alias("n_h_ties"), e("n_j_ties").alias("n_j_ties"),
            (e("a_ll") + e("a_ll") - e("a_lh") + e("a_ej")).alias("s"), "has_nan",
            e("clear").alias("clear_pairs"),
            ((z("b_lh") - z("b_ll")) - (z("c_lh") - z("c_ll"))).alias("mismatch_loss")]
    if spearman:
        # Average ranks from the two prefixes; centred so the sums stay well conditioned.
        rh = lv.filter((lvl == -1) & (F.col("_p") > 0)).select(
            *keys, "_h", (F.col("_p_before") + (F.col("_p") + F.lit(1.0)) / F.lit(2.0)).alias("_rh"))
        jw = ranked.groupBy(*keys, "_j").agg(F.first("_jb").alias("_jb"), F.sum("_w").alias("_jw"))
        rj = jw.select(*keys, "_j", (F.col("_jb") + (F.col("_jw") + F.lit(1.0)) / F.lit(2.0)).alias("_rj"))
        c = join_on(join_on(cells, rh, keys + ["_h"]), rj, keys + ["_j"])
        c = with_group_row(c, out.select(*keys, "n"), keys)
        mid = (F.col("n") + F.lit(1.0)) / F.lit(2.0)
        c = c.withColumn("_ch", F.col("_rh") - mid).withColumn("_cj", F.col("_rj") - mid)
        sums = c.groupBy(*keys).agg(
            F.sum(F.col("_w") * F.col("_ch") * F.col("_cj")).alias("sxy"),
            F.sum(F.col("_w") * F.col("_ch") * F.col("_ch")).alias("sxx"),
            F.sum(F.col("_w") * F.col("_cj") * F.col("_cj")).alias("syy"))
        out = with_group_row(out, sums, keys, "left")
        cols += ["sxy", "sxx", "syy"]
    if margin > 0.0:
        out = with_group_row(out, _margin_penalty(cells, keys, margin), keys, "left")
        cols += ["penalty"]
    return out.select(*keys, "n", *cols).select(*keys, "n", *_statistic_cols(spearman, margin))


def _margin_penalty(cells: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """Per group, the sum of ``margin - (j_b - j_a)`` over the clear pairs that the judge orders as the
    human does, by less than ``margin``: (keys, penalty).

    The pairs are those with j_a < j_b less those with j_a <= j_b - margin. Both are dominance counts as in
    :func:`_split_groups`, with the points and the two kinds of query ranked together by judge score.
    """
    cells = cells.filter(~_is_nan())
    kind = lambda h, j, tie, p, q: F.struct(h.alias("_h"), j.alias("_j"), F.lit(tie).alias("_tie"),
                                            (F.col("_w") * p).alias("_p"), (F.col("_w") * q).alias("_q"),
                                            F.col("_j").alias("_jv"))
    asks = F.col("_h") - F.lit(CLEAR_GAP)
    # At equal rank value: a strict query, then points, then a query that takes equal scores.
    events = cells.select(*keys, F.inline(F.array(
        kind(F.col("_h"), F.col("_j"), 1, F.lit(1.0), F.lit(0.0)),
        kind(asks, F.col("_j"), 0, F.lit(0.0), F.lit(1.0)),
        kind(asks, F.col("_j") - F.lit(float(margin)), 2, F.lit(0.0), F.lit(-1.0)))))
    events = cut_lineage(events)
    spots = events.select(*keys, "_j", "_tie").distinct().withColumn("_one", F.lit(1.0))
    spots = running(spots, keys, ["_j", "_tie"], [Running("_r", "sum", "_one", inclusive=False)], small=False)
    spots = spots.withColumn("_r", F.col("_r").cast("bigint")).drop("_one")
    top = spots.groupBy(*keys).agg(F.max("_r").alias("_top"))
    x = with_group_row(join_on(events, spots, [*keys, "_j", "_tie"]), top, keys)
    last = F.when(F.col("_top") >= 1, F.floor(F.log2(F.col("_top") + F.lit(0.5))).cast("int")).otherwise(F.lit(0))
    x = x.withColumn("_l", F.explode(F.sequence(F.lit(0), last)))
    x = x.filter((F.expr("shiftright(_r, _l) & 1") == 1) == (F.col("_tie") != 1))
    x = x.select(*keys, "_l", F.expr("shiftright(_r, _l + 1)").alias("_pk"), "_h", "_p", "_q",
                 (F.col("_p") * F.col("_jv")).alias("_pj"), (F.col("_q") * F.col("_jv")).alias("_qj"))
    lv = prefix_before(x, [*keys, "_l", "_pk"], "_h", ["_p", "_pj", "_q", "_qj"], small=False)
    short = (F.lit(float(margin)) * F.col("_q") - F.col("_qj")) * F.col("_p_before") + F.col("_q") * F.col("_pj_before")
    return lv.groupBy(*keys).agg(F.coalesce(F.sum(short), F.lit(0.0)).alias("penalty"))


def _split_ranks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman's sums alone of groups that no single task can hold: (keys, n, has_nan, sxy, sxx, syy)."""
    def avg_rank(col: str, out: str) -> DataFrame:
        pref = prefix_before(cells.select(*keys, col, "_w"), keys, col, ["_w"], small=False)
        return pref.select(*keys, col, (F.col("_w_before") + (F.col("_w") + F.lit(1.0)) / F.lit(2.0)).alias(out))
    n = cells.groupBy(*keys).agg(F.sum("_w").alias("n"))
    c = join_on(join_on(cells, avg_rank("_h", "_rh"), keys + ["_h"]), avg_rank("_j", "_rj"), keys + ["_j"])
    c = with_group_row(c, n, keys)
    mid = (F.col("n") + F.lit(1.0)) / F.lit(2.0)
    c = c.withColumn("_ch", F.col("_rh") - mid).withColumn("_cj", F.col("_rj") - mid)
    return c.groupBy(*keys).agg(
        F.coalesce(F.max("n"), F.lit(0.0)).alias("n"), F.max(_is_nan()).alias("has_nan"),
        F.sum(F.col("_w") * F.col("_ch") * F.col("_cj")).alias("sxy"),
        F.sum(F.col("_w") * F.col("_ch") * F.col("_ch")).alias("sxx"),
        F.sum(F.col("_w") * F.col("_cj") * F.col("_cj")).alias("syy"))


def pair_sums(df: DataFrame, keys: list[str], human: str = "human_score",
              judge: str = "judge_score") -> DataFrame:
    """Per group: n, n_pairs, tie counts, S = concordant - discordant, clear pairs and the
    summed mismatch loss of the pairwise ranking loss (margin 0)."""
    return _statistics(df, keys, human, judge, spearman=False)


def _tau_b() -> Column:
    untied = lambda ties: (F.col("n_pairs") - F.col(ties)).cast("double")
    tau = F.try_divide(F.col("s").cast("double"), F.sqrt(untied("n_h_ties") * untied("n_j_ties")))
    return F.when(~F.col("has_nan"), tau)


def _rho() -> Column:
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    return F.when((F.col("sxx") > 0) & (F.col("syy") > 0) & ~F.col("has_nan"), rho)


def _metric_cols(spearman: bool) -> list[Column]:
    small = F.col("n") < 2
    tau = _tau_b()
    cols = [F.col("n").cast("bigint").alias("n"),
            F.when(small, 0.0).otherwise(F.coalesce(tau, F.lit(0.0))).alias("kendall_tau"),
            F.when(small, 0.0).otherwise(F.coalesce(F.lit(1.0) - tau, F.lit(1.0))).alias("kendall_tau_loss"),
            F.col("clear_pairs").cast("bigint").alias("clear_pairs"),
            (F.col("mismatch_loss") / F.greatest(F.col("clear_pairs").cast("double"), F.lit(1.0))).alias("pairwise_loss")]
    if spearman:
        rho = _rho()
        cols += [F.when(small, 0.0).otherwise(F.coalesce(rho, F.lit(0.0))).alias("spearman_rho"),
                 F.when(small, 0.0).otherwise(F.coalesce(F.lit(1.0) - rho, F.lit(1.0))).alias("spearman_loss")]
    return cols


def rank_statistics(df: DataFrame, keys: list[str], human: str = "human_score",
                    judge: str = "judge_score", rows: str | None = None) -> DataFrame:
    """Kendall tau-b and its loss, the pairwise ranking loss and Spearman rho and its loss,
    all from one set of passes. Metrics are 0.0 when undefined or n < 2; losses are 1 - metric
    (1.0 when undefined; 0.0 for n < 2)."""
    return _statistics(df, keys, human, judge, spearman=True, rows=rows).select(*keys, *_metric_cols(True))


def rank_statistics_rollup(df: DataFrame, levels: list[str], human: str = "human_score",
                           judge: str = "judge_score") -> DataFrame:
    """:func:`rank_statistics` at every rollup level of ``levels``, the grand total included.

    Rank metrics of a level don't follow from those below it, but its score cells do: the cells of the
    finest level are counted once, each is expanded to the levels it belongs to, and all levels are
    re-aggregated and ranked in the same passes, with ``grouping_level`` (the grouping id, 0 the finest) as one
    more key. So the input is read once and no level is a job of its own.
    """
    h, j = F.col(human).cast("double"), F.col(judge).cast("double")
    fine = df.filter(h.isNotNull() & j.isNotNull()).groupBy(*levels, h.alias(human), j.alias(judge)).agg(F.count(F.lit(1)).alias("_rows"))
    per = [F.struct(*[(F.col(c) if i < n else F.lit(None).cast(fine.schema[c].dataType)).alias(c) for i, c in enumerate(levels)],
                    F.lit((1 << len(levels) - n) - 1).cast("bigint").alias("grouping_level")) for n in range(len(levels), -1, -1)]
    wide = fine.select(human, judge, "_rows", F.explode(F.array(*per)).alias("_level")).select("_level.*", human, judge, "_rows")
    return rank_statistics(wide, [*levels, "grouping_level"], human, judge, rows="_rows")


def pair_metrics(df: DataFrame, keys: list[str], human: str = "human_score",
                 judge: str = "judge_score") -> DataFrame:
    """Kendall tau-b, its loss and the pairwise ranking loss from one pass over the pairs."""
    return _statistics(df, keys, human, judge, spearman=False).select(*keys, *_metric_cols(False))


def kendall_tau(df: DataFrame, keys: list[str], human: str = "human_score",
                judge: str = "judge_score") -> DataFrame:
    """Kendall tau-b per group; metric 0.0 when undefined or n < 2, loss 1 - tau (1.0 when undefined)."""
    return pair_metrics(df, keys, human, judge).select(*keys, "n", "kendall_tau", "kendall_tau_loss")


def pairwise_ranking_loss(df: DataFrame, keys: list[str], human: str = "human_score",
                          judge: str = "judge_score", margin: float = 0.0) -> DataFrame:
    """Mean over clear pairs (human scores more than CLEAR_GAP apart) of |dh| where the judge disagrees
    (ties and NaN included) and of ``margin - |dj|`` where it agrees by less than ``margin``; 0.0 for n < 2."""
    out = _statistics(df, keys, human, judge, spearman=False, margin=margin)
    cost = F.col("mismatch_loss") + (F.coalesce(F.col("penalty"), F.lit(0.0)) if margin > 0.0 else F.lit(0.0))
    return out.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("clear_pairs").cast("bigint").alias("clear_pairs"),
                      (cost / F.greatest(F.col("clear_pairs").cast("double"), F.lit(1.0))).alias("pairwise_loss"))


def spearman_rho(df: DataFrame, keys: list[str], human: str = "human_score",
                 judge: str = "judge_score") -> DataFrame:
    """Spearman rho from average ranks; metric 0.0 when undefined or n < 2, loss 1 - rho.

    Groups that fit one task (checked) are counted whole; larger ones need only the two rank columns,
    not the pair sums, and take those from prefix sums.
    """
    names = ["n", "has_nan", "sxy", "sxx", "syy"]
    sums = _by_size(df, keys, human, judge, None, lambda x, count: _whole_groups(x, keys, count, True, 0.0).select(*keys, *names),
                    lambda cells: _split_ranks(cells, keys))
    small_n = F.col("n") < 2
    rho = _rho()
    return sums.select(*keys, F.col("n").cast("bigint").alias("n"),
                       F.when(small_n, 0.0).otherwise(F.coalesce(rho, F.lit(0.0))).alias("spearman_rho"),
                       F.when(small_n, 0.0).otherwise(F.coalesce(F.lit(1.0) - rho, F.lit(1.0)))
                       .alias("spearman_loss"))
