import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from judgelens.operators import sampling


def _scores(spark, n=50, seed=42):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(n), "human_score": rng.uniform(1, 10, n)}))


def test_percentiles_match_numpy(spark):
    df = _scores(spark, 37)
    pdf = df.toPandas()
    got = sampling.exact_percentiles(df, [], "human_score", [0.25, 0.75]).toPandas().iloc[0]
    assert got.p25 == np.percentile(pdf.human_score, 25)
    assert got.p75 == np.percentile(pdf.human_score, 75)


def test_split_exact_and_exhaustive(spark):
    s = sampling.train_val_split(_scores(spark, 101), val_fraction=0.2, seed=42).toPandas()
    assert len(s) == 101 and (s.split == "val").sum() == int(101 * 0.2)
    again = sampling.train_val_split(_scores(spark, 101), val_fraction=0.2, seed=42).toPandas()
    assert set(s[s.split == "val"].sample_id) == set(again[again.split == "val"].sample_id)


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_epoch_batches_properties(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    b = sampling.epoch_batches(_scores(spark, 50), batch_size=10, epochs=3).toPandas()
    for epoch, e in b.groupby("epoch"):
        assert sorted(e.sample_id) == list(range(50))            # every row once per epoch
        assert sorted(e.groupby("batch_no").size()) == [10] * 5   # full batches
    first = b[(b.epoch == 0) & (b.batch_no == 0)]
    assert first.stratum.value_counts().to_dict() == {"high": 4, "low": 3, "mid": 3}
    assert not b[b.epoch == 0].sort_values("position").sample_id.equals(
        b[b.epoch == 1].sort_values("position").sample_id.reset_index(drop=True))


def test_small_group_is_one_batch(spark):
    b = sampling.epoch_batches(_scores(spark, 3), batch_size=10, epochs=2).toPandas()
    assert len(b) == 3 and set(b.batch_no) == {0} and set(b.epoch) == {0}


def test_strata_each_row_once(spark):
    s = sampling.score_strata(spark.createDataFrame(pd.DataFrame({"human_score": [5.0] * 6}))).toPandas()
    assert (s.stratum == "high").all()


def test_gather_batch(spark):
    samples = _scores(spark, 50).withColumn("response", F.concat(F.lit("r"), F.col("sample_id").cast("string")))
    b = sampling.epoch_batches(samples, batch_size=10, epochs=1)
    got = sampling.gather_batch(b, samples, epoch=0, batch_no=2).toPandas()
    assert len(got) == 10 and set(got.response) == {f"r{i}" for i in got.sample_id}
    assert sorted(got.position) == list(range(20, 30))


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_global_sampling_plans_no_pair_join(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = _scores(spark, 60)
        batches = sampling.epoch_batches(df, batch_size=10, epochs=2)
        for out in (sampling.train_val_split(df), sampling.score_strata(df), batches, sampling.epoch_progress(batches)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
