"""Several human scores per sample, against least squares and plain ranks."""

import numpy as np
import pandas as pd
import pytest

from judgelens.operators import consensus


def some_ratings(seed=1, samples=25, annotators=7, n=160, hot=True):
    rng = np.random.RandomState(seed)
    rows = [(int(rng.randint(samples)), int(0 if hot and rng.rand() < 0.4 else rng.randint(annotators))) for _ in range(n)]
    bias = rng.randn(annotators)
    return pd.DataFrame([(s, a, float(rng.randint(1, 10) + bias[a])) for s, a in rows], columns=["sample_id", "annotator", "score"])


def least_squares(df):
    samples, annotators = sorted(df.sample_id.unique()), sorted(df.annotator.unique())
    x = np.zeros((len(df), len(samples) + len(annotators)))
    x[np.arange(len(df)), df.sample_id.map(samples.index)] = 1
    x[np.arange(len(df)), len(samples) + df.annotator.map(annotators.index)] = 1
    w = np.linalg.lstsq(x, df.score.to_numpy(), rcond=None)[0]
    effect, bias = w[:len(samples)], w[len(samples):]
    mean = (df.annotator.map(dict(zip(annotators, bias)))).mean()  # weighted mean 0
    return dict(zip(samples, effect + mean)), dict(zip(annotators, bias - mean))


def check(spark):
    df = some_ratings()
    fit = consensus.fit_annotators(consensus.rating_cells(spark.createDataFrame(df).repartition(3)), max_rounds=60, tol=1e-7)
    effects, biases = least_squares(df)
    assert fit.change <= 1e-7 and fit.rounds < 60
    got = {r.annotator: r for r in fit.annotators.collect()}
    assert np.allclose([got[a].bias for a in biases], list(biases.values()), atol=1e-5)
    assert sum(r.n_ratings for r in got.values()) == len(df)
    out = {r.sample_id: r for r in consensus.human_consensus(spark.createDataFrame(df), max_rounds=60, tol=1e-7).collect()}
    assert np.allclose([out[s].fitted_score for s in effects], list(effects.values()), atol=1e-5)
    means = df.groupby(["annotator", "sample_id"]).score.mean().round(9).reset_index()
    n = means.groupby("annotator").score.transform("size")
    means["place"] = np.where(n > 1, (means.groupby("annotator").score.rank() - 1) / (n - 1).clip(lower=1), 0.5)
    for s, g in means.groupby("sample_id"):
        assert out[s].borda == pytest.approx(g.place.mean()) and out[s].n_annotators == len(g)
        assert out[s].mean_score == pytest.approx(df[df.sample_id == s].score.mean())
        assert out[s].n_ratings == (df.sample_id == s).sum()


def test_fit_is_the_least_squares_solution(spark):
    check(spark)


def test_fit_with_hot_annotators(spark, hot_keys):
    check(spark)


def test_odd_ratings(spark):
    rows = [("a", "x", 1.0), ("a", None, 3.0), (None, "x", 2.0), ("b", "x", None), ("b", "x", float("nan")), ("c", "y", 5.0)]
    out = {r.sample_id: r for r in consensus.human_consensus(spark.createDataFrame(rows, "sample_id string, annotator string, score double")).collect()}
    assert set(out) == {"a", None, "c"}
    assert out["a"].n_ratings == 2 and out["c"].borda == 0.5 and out["c"].mean_score == 5.0
    assert consensus.human_consensus(spark.createDataFrame([], "sample_id string, annotator string, score double")).count() == 0


def test_more_rounds_never_fit_worse(spark):
    df = some_ratings(seed=4, hot=False)
    cells = consensus.rating_cells(spark.createDataFrame(df))
    errors = []
    for rounds in (1, 2, 3):
        fit = consensus.fit_annotators(cells, max_rounds=rounds, tol=0.0)
        e = {r.sample_id: r.effect for r in fit.samples.collect()}
        b = {r.annotator: r.bias for r in fit.annotators.collect()}
        errors.append(((df.score - df.sample_id.map(e) - df.annotator.map(b)) ** 2).sum())
    assert errors[0] >= errors[1] - 1e-9 and errors[1] >= errors[2] - 1e-9


def test_consensus_of_null_keys_by_every_path(spark, monkeypatch):
    """Whole samples with broadcast biases, without a broadcast, and samples split over tasks agree."""
    df = some_ratings(seed=8).astype({"annotator": "object", "sample_id": "object"})
    df.loc[df.annotator == 2, "annotator"] = None
    df.loc[df.sample_id == 3, "sample_id"] = None
    rows = spark.createDataFrame(list(df.itertuples(index=False, name=None)), "sample_id int, annotator int, score double")

    def run():
        return {r.sample_id: (r.n_annotators, round(r.borda, 9), round(r.fitted_score, 6)) for r in consensus.human_consensus(rows, tol=1e-8).collect()}
    cells, whole = consensus._by_sample(consensus.rating_cells(rows))
    assert whole and cells.filter("_first").count() == df.sample_id.nunique(dropna=False)
    blocks = run()
    monkeypatch.setattr(consensus, "BROADCAST_ANNOTATORS", 0)
    assert run() == blocks
    spark.conf.set("judgelens.maxKeyRows", "5")
    try:
        assert run() == blocks
    finally:
        spark.conf.unset("judgelens.maxKeyRows")


def test_a_round_shuffles_no_cell(spark):
    fit = consensus.fit_annotators(consensus.rating_cells(spark.createDataFrame(some_ratings())), max_rounds=2)
    plan = fit.annotators._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan  # the partial sums by annotator
