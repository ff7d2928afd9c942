import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from judgelens.operators.prefix import Running, prefix_before, running


def _data(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 20, n)),
                        "o": rng.permutation(n), "v": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    return pdf


def _expected(pdf):
    e = pdf.sort_values(["g", "o"]).copy()
    e["s"] = e.groupby("g")["v"].transform(lambda x: x.fillna(0).cumsum())
    e["se"] = e["s"] - e["v"].fillna(0)
    e["mn"] = e.groupby("g")["v"].transform(lambda x: x.cummin().ffill().shift(1))
    return e


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_running_matches_pandas(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    pdf = _data()
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = running(df, ["g"], ["o"], [Running("s", "sum", "v"), Running("se", "sum", "v", inclusive=False),
                                     Running("mn", "min", "v", inclusive=False)]).toPandas()
    m = _expected(pdf).merge(got, on=["g", "o"], suffixes=("", "_r"))
    assert len(m) == len(pdf)
    for c in ["s", "se", "mn"]:
        np.testing.assert_allclose(m[c].fillna(-99).to_numpy(), m[c + "_r"].fillna(-99).to_numpy())


def test_prefix_before_aggregates_ties(spark, hot_keys):
    pdf = pd.DataFrame({"g": [1] * 8 + [2] * 3, "o": [3, 1, 3, 2, 2, 9, 1, 3, 5, 5, 4], "w": [1.0] * 11})
    got = prefix_before(spark.createDataFrame(pdf), ["g"], "o", ["w"]).toPandas()
    got = got.sort_values(["g", "o"]).reset_index(drop=True)
    assert got[["g", "o", "w", "w_before"]].values.tolist() == [
        [1, 1, 2.0, 0.0], [1, 2, 2.0, 2.0], [1, 3, 3.0, 4.0], [1, 9, 1.0, 7.0], [2, 4, 1.0, 0.0], [2, 5, 2.0, 1.0]]


def test_global_running_without_keys(spark, hot_keys):
    df = spark.range(0, 50).withColumn("one", F.lit(1.0))
    got = running(df, [], ["id"], [Running("pos", "sum", "one", inclusive=False)]).toPandas()
    assert sorted(zip(got["id"], got["pos"])) == [(i, float(i)) for i in range(50)]


def test_payload_passes_untouched_on_the_ranged_path(spark, hot_keys):
    rows = [(1, i, None if i % 3 else 2**53 + 2 * i + 1, float("nan") if i % 4 == 0 else None if i % 4 == 1 else 1.5)
            for i in range(40)]
    df = spark.createDataFrame(rows, "g int, o int, big bigint, x double").withColumn(
        "ts", F.expr("timestamp'9999-12-31 00:00:00'")).withColumn("one", F.lit(1.0))
    out = running(df, ["g"], ["o"], [Running("pos", "sum", "one"), Running("low", "min", "x")])
    assert dict(out.dtypes)["big"] == "bigint"
    assert out.filter("ts = timestamp'9999-12-31 00:00:00'").count() == 40
    got = {r.o: r for r in out.drop("ts").collect()}
    assert [got[i].big for i in range(40)] == [r[2] for r in rows]
    assert [got[i].pos for i in range(40)] == [float(i + 1) for i in range(40)]
    assert sum(got[i].x is None for i in range(40)) == 10 and sum(got[i].x is not None and np.isnan(got[i].x) for i in range(40)) == 10
