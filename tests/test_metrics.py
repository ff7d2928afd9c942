import math
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from judgelens.operators import dominance, metrics, ranking, sampling
from tests.reference_rules import pair_stats

GOLDEN = pd.DataFrame({"sample_id": [0, 1, 2, 3, 4], "judge_score": [8.0, 6.5, 7.0, 9.0, 5.5],
                       "human_score": [7.5, 6.0, 7.5, 8.5, 6.0], "variance": [0.10, 0.20, 0.15, 0.05, 0.30]})


def test_golden_vector(spark):
    df = spark.createDataFrame(GOLDEN)
    r = metrics.evaluation_report(df, [], variance="variance").toPandas().iloc[0]
    assert r.mae == pytest.approx(0.5) and r.mse == pytest.approx(0.25) and r.rmse == pytest.approx(0.5)
    assert r.kendall_tau == pytest.approx(8 / math.sqrt(80))
    assert r.spearman_rho == pytest.approx(0.9486832981)
    assert r.score_entropy == pytest.approx(math.log(5))
    assert r.score_std == pytest.approx(1.2083045974)
    assert r.mean_self_consistency_var == pytest.approx(0.16)
    assert r.rank_loss_component == pytest.approx(0.0) and r.total_loss == pytest.approx(0.5)
    h = metrics.huber_loss(df, []).toPandas().iloc[0]
    assert h.huber_loss == pytest.approx(0.125)
    e = metrics.error_metrics(df, []).toPandas().iloc[0]
    assert e.mean_error == pytest.approx(0.1)


def test_edge_cases(spark):
    one = spark.createDataFrame(pd.DataFrame({"g": [1], "judge_score": [5.0], "human_score": [5.5]}))
    r = metrics.evaluation_report(one, ["g"]).toPandas().iloc[0]
    assert r.mae == pytest.approx(0.5) and r.kendall_tau == 0.0 and r.rank_loss_component == 0.0
    assert r.score_entropy == 0.0
    const = spark.createDataFrame(pd.DataFrame({"g": [1] * 4, "judge_score": [5.0] * 4,
                                                "human_score": [1.0, 2.0, 3.0, 4.0]}))
    k = ranking.kendall_tau(const, ["g"]).toPandas().iloc[0]
    assert k.kendall_tau == 0.0 and k.kendall_tau_loss == 1.0
    s = ranking.spearman_rho(const, ["g"]).toPandas().iloc[0]
    assert s.spearman_rho == 0.0 and s.spearman_loss == 1.0
    ties = spark.createDataFrame(pd.DataFrame({"g": [1] * 4, "judge_score": [1.0, 2.0, 3.0, 4.0],
                                               "human_score": [5.0] * 4}))
    assert ranking.pairwise_ranking_loss(ties, ["g"]).toPandas().iloc[0].pairwise_loss == 0.0
    empty = spark.createDataFrame(pd.DataFrame({"g": [1], "judge_score": [1.0], "human_score": [1.0]})).limit(0)
    assert metrics.evaluation_report(empty, ["g"]).count() == 0


def _random_groups(seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(8):
        n = 120 if g == 0 else int(rng.integers(1, 30))
        h = rng.integers(1, 6, n).astype(float)
        j = np.round(rng.normal(5, 2, n), 0)
        rows += [(g, a, b) for a, b in zip(h, j)]
    return pd.DataFrame(rows, columns=["g", "human_score", "judge_score"])


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_rank_statistics_equal_brute_force(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    pdf = _random_groups()
    df = spark.createDataFrame(pdf)
    pm = ranking.pair_metrics(df, ["g"]).toPandas().set_index("g")
    sp = ranking.spearman_rho(df, ["g"]).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        exp = pair_stats(sub.judge_score.to_numpy(), sub.human_score.to_numpy())
        assert pm.loc[g, "kendall_tau"] == pytest.approx(exp["kendall_tau"], abs=1e-12)
        assert pm.loc[g, "kendall_tau_loss"] == pytest.approx(exp["kendall_tau_loss"], abs=1e-12)
        assert pm.loc[g, "pairwise_loss"] == pytest.approx(exp["pairwise_loss"], abs=1e-12)
        assert sp.loc[g, "spearman_rho"] == pytest.approx(exp["spearman_rho"], abs=1e-12)


def test_entropy_matches_histogram_rule(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(1, 10, 200), 1)
    df = spark.createDataFrame(pd.DataFrame({"judge_score": x}))
    got = metrics.score_entropy(df, []).toPandas().iloc[0].score_entropy
    hist, _ = np.histogram(x, bins=10)
    p = hist[hist > 0] / len(x)
    assert got == pytest.approx(float(-(p * np.log(p)).sum()))


def test_null_group_key_is_kept(spark):
    pdf = pd.DataFrame({"g": [None, None, None, "a", "a"], "judge_score": [1.0, 2.0, 3.0, 2.0, 1.0],
                        "human_score": [1.0, 3.0, 2.0, 1.0, 2.0]})
    r = metrics.evaluation_report(spark.createDataFrame(pdf), ["g"]).toPandas()
    assert len(r) == 2
    null_row = r[r.g.isna()].iloc[0]
    exp = pair_stats(pdf.judge_score[:3].to_numpy(), pdf.human_score[:3].to_numpy())
    assert null_row.kendall_tau == pytest.approx(exp["kendall_tau"])
    assert null_row.spearman_rho == pytest.approx(exp["spearman_rho"])


def _slow_pairwise(judge, human, margin):
    """The pairwise loss from full tables of differences."""
    dh, dj = (np.subtract.outer(x, x)[np.triu_indices(len(x), 1)] for x in (np.asarray(human), np.asarray(judge)))
    clear = np.abs(dh) > 1e-6
    wrong = clear & ~(np.sign(dh) == np.sign(dj))
    short = clear & ~wrong & (np.abs(dj) < margin)
    return (np.abs(dh[wrong]).sum() + (margin - np.abs(dj[short])).sum()) / max(1, clear.sum())


@pytest.mark.parametrize("margin", [0.0, 0.75, 3.0])
@pytest.mark.parametrize("path", ["window", "ranged"])
def test_pairwise_loss_margin_near_ties_and_nan(spark, request, path, margin):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    pdf = _random_groups(seed=13)
    rng = np.random.default_rng(2)
    pdf["human_score"] += rng.choice([0.0, 5e-7, -8e-7, 3e-6], len(pdf))
    pdf["judge_score"] += rng.choice([0.0, 0.25, 0.5], len(pdf))
    pdf.loc[(pdf.g == 3) & (pdf.index % 4 == 0), "judge_score"] = np.nan
    pdf.loc[(pdf.g == 4) & (pdf.index % 4 == 0), "human_score"] = np.nan
    got = ranking.pairwise_ranking_loss(spark.createDataFrame(pdf), ["g"], margin=margin).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        exp = _slow_pairwise(sub.judge_score, sub.human_score, margin)
        assert got.loc[g, "pairwise_loss"] == pytest.approx(exp, abs=1e-9), g
        assert got.loc[g, "n"] == len(sub)
    if margin == 0.0:
        rank = ranking.rank_statistics(spark.createDataFrame(pdf), ["g"]).toPandas().set_index("g")
        for g in (3, 4):  # undefined with a NaN score: metric 0, loss 1
            assert rank.loc[g, ["kendall_tau", "spearman_rho"]].tolist() == [0.0, 0.0]
            assert rank.loc[g, ["kendall_tau_loss", "spearman_loss"]].tolist() == [1.0, 1.0]


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_statistics_without_keys_plan_no_cross_join(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    pdf = _random_groups(seed=3)
    df = spark.createDataFrame(pdf)
    exp = pair_stats(pdf.judge_score.to_numpy(), pdf.human_score.to_numpy())
    out = metrics.evaluation_report(df, [])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
    r = out.toPandas().iloc[0]
    assert r.kendall_tau == pytest.approx(exp["kendall_tau"]) and r.spearman_rho == pytest.approx(exp["spearman_rho"])
    assert r.rank_loss_component == pytest.approx(exp["pairwise_loss"])


def test_report_keeps_groups_without_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", None, 1.0), ("b", None, 2.0)],
                               "g string, judge_score double, human_score double")
    r = metrics.evaluation_report(df, ["g"]).toPandas().set_index("g")
    assert sorted(r.index) == ["a", "b"] and r.loc["b", "n"] == 2 and math.isnan(r.loc["b", "mae"])
    assert r.loc["b", ["kendall_tau", "rank_loss_component", "score_entropy"]].tolist() == [0.0, 0.0, 0.0]


def test_margin_loss_copies_no_row_and_writes_no_checkpoint(spark):
    pdf = _random_groups(seed=21)
    folder = spark.sparkContext.getCheckpointDir()
    before = {f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names}
    out = ranking.pairwise_ranking_loss(spark.createDataFrame(pdf), ["g"], margin=0.75)
    assert {f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names} == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    got = {r.g: r.pairwise_loss for r in out.collect()}
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(_slow_pairwise(sub.judge_score, sub.human_score, 0.75), abs=1e-9)


def test_one_hot_group_leaves_the_others_whole(spark):
    """Groups over the limit are split over tasks, the rest counted whole; both by the same rules."""
    pdf = _random_groups(seed=5)
    pdf["human_score"] += np.random.default_rng(1).choice([0.0, 5e-7, 3e-6], len(pdf))
    spark.conf.set("judgelens.maxKeyRows", "40")
    try:
        out = ranking.pairwise_ranking_loss(spark.createDataFrame(pdf), ["g"])
    finally:
        spark.conf.unset("judgelens.maxKeyRows")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r for r in out.collect()}
    assert len(got) == pdf.g.nunique()
    for g, sub in pdf.groupby("g"):
        assert got[g].pairwise_loss == pytest.approx(_slow_pairwise(sub.judge_score, sub.human_score, 0.0), abs=1e-9)


def test_kendall_tau_over_blocks_of_rows(spark, monkeypatch):
    """No row is copied per bit level, and a group that ends within a block is counted once."""
    out = ranking.kendall_tau(spark.createDataFrame(_random_groups(seed=9)), ["g"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dominance, "BLOCK_ROWS", 10)
    pdf = _random_groups(seed=9).sort_values(["g", "human_score", "judge_score"])
    rows = pa.table({"g": pdf.g, "_h": pdf.human_score, "_j": pdf.judge_score, "_w": np.ones(len(pdf)), "_first": ~pdf.g.duplicated()},
                    schema=pa.schema([("g", pa.int64()), ("_h", pa.float64()), ("_j", pa.float64()), ("_w", pa.float64()), ("_first", pa.bool_())]))
    blocks = dominance.grouped_pairs(1e-6, 0.0, ["n", "s", "n_h_ties", "n_j_ties"])(iter(rows.to_batches(max_chunksize=7)))
    got = pa.Table.from_batches(list(blocks)).to_pylist()
    assert [r["g"] for r in got] == sorted(pdf.g.unique())
    for r, (_, sub) in zip(got, pdf.groupby("g")):
        dh, dj = (np.subtract.outer(x, x)[np.triu_indices(len(x), 1)] for x in (sub.human_score.to_numpy(), sub.judge_score.to_numpy()))
        assert [r["n"], r["s"], r["n_h_ties"], r["n_j_ties"]] == [len(sub), (np.sign(dh) * np.sign(dj)).sum(), (dh == 0).sum(), (dj == 0).sum()]


def test_loss_within_strata_copies_no_row(spark):
    pdf = _random_groups(seed=17)
    strata = sampling.score_strata(spark.createDataFrame(pdf), ["g"]).filter("stratum <> 'mid'")
    out = ranking.pairwise_ranking_loss(strata, ["g", "stratum"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "shiftright" not in plan
    kept = strata.toPandas()
    got = {(r.g, r.stratum): r.pairwise_loss for r in out.collect()}
    assert set(got) == set(map(tuple, kept[["g", "stratum"]].values))
    for key, sub in kept.groupby(["g", "stratum"]):
        assert got[key] == pytest.approx(_slow_pairwise(sub.judge_score, sub.human_score, 0.0), abs=1e-9)


def test_spearman_copies_no_row_and_writes_no_checkpoint(spark):
    """Ranks come from one sorted pass over whole groups, NULL key, NaN scores and constant scores included."""
    pdf = _random_groups(seed=23)
    pdf["g"] = pdf.g.astype("Int64").where(pdf.g != 2)
    pdf.loc[(pdf.g == 3).fillna(False) & (pdf.index % 4 == 0), "judge_score"] = np.nan
    pdf.loc[(pdf.g == 4).fillna(False), "human_score"] = 3.0
    df = spark.createDataFrame([(None if pd.isna(g) else int(g), h, j) for g, h, j in pdf.itertuples(index=False)],
                               "g bigint, human_score double, judge_score double")
    folder = spark.sparkContext.getCheckpointDir()
    before = {f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names}
    out = ranking.spearman_rho(df, ["g"])
    assert {f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names} == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == 1
    got = {r.g: r for r in out.collect()}
    assert len(got) == pdf.g.nunique(dropna=False)
    for g, sub in pdf.groupby("g", dropna=False):
        exp = pair_stats(sub.judge_score.to_numpy(), sub.human_score.to_numpy())
        key = None if pd.isna(g) else int(g)
        want = (0.0, 1.0) if key in (3, 4) else (exp["spearman_rho"], exp["spearman_loss"])
        assert (got[key].spearman_rho, got[key].spearman_loss) == pytest.approx(want, abs=1e-12)
        assert got[key].n == len(sub)
