import math
import os

import numpy as np
import pandas as pd
import pytest

from judgelens.operators import monitor
from judgelens.streaming.monitor_stream import monitor_stream
from tests.reference_rules import early_stopping


def _history(seed=5, runs=6, steps=40):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(runs):
        loss = 2.0
        for s in range(1, steps + 1):
            loss = max(0.05, loss + rng.normal(-0.02, 0.08))
            k = int(rng.integers(0, 100))
            rows.append((r, s, round(loss, 3), (k - 50) / 50, None if s % 4 == 0 else k / 50,
                         None if k % 7 == 0 else k / 500))
    return pd.DataFrame(rows, columns=["run_id", "step", "val_loss", "kendall_tau", "score_entropy",
                                       "mean_self_consistency_var"])


def _expected(pdf, **kw):
    out = []
    for r, g in pdf.groupby("run_id"):
        rows = [(s, l, None if pd.isna(t) else t, None if pd.isna(e) else e, None if pd.isna(v) else v)
                for s, l, t, e, v in g[["step", "val_loss", "kendall_tau", "score_entropy",
                                        "mean_self_consistency_var"]].itertuples(index=False)]
        for d in early_stopping(rows, **kw):
            out.append(dict(run_id=r, **d))
    return pd.DataFrame(out)


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_early_stop_trace_matches_rules(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    pdf = _history()
    got = monitor.early_stop_trace(spark.createDataFrame(pdf), patience=5).toPandas()
    exp = _expected(pdf, patience=5)
    m = exp.merge(got, on=["run_id", "step"], suffixes=("", "_g"))
    assert len(m) == len(pdf)
    for c in ["improved", "best_step", "counter", "stop_now", "stopped"]:
        assert (m[c].astype("int64") == m[c + "_g"].astype("int64")).all(), c
    w = monitor.degeneration_warnings(spark.createDataFrame(pdf)).toPandas()
    m2 = exp.merge(w, on=["run_id", "step"])
    assert (m2.n_warnings_x == m2.n_warnings_y).all()


def test_stream_equals_batch_and_handles_min_delta(spark, tmpdir_path):
    pdf = _history(seed=9)
    src = os.path.join(tmpdir_path, "evals")
    spark.createDataFrame(pdf).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    q = (monitor_stream(stream, patience=5, min_delta=0.01).writeStream.format("memory")
         .queryName("monitor_out").outputMode("append")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM monitor_out").toPandas()
    exp = _expected(pdf, patience=5, min_delta=0.01)
    m = exp.merge(got, on=["run_id", "step"], suffixes=("", "_g"))
    assert len(m) == len(pdf)
    for c in ["improved", "best_step", "counter", "stop_now", "stopped"]:
        assert (m[c].astype("int64") == m[c + "_g"].astype("int64")).all(), c


def test_best_checkpoint_tie_rules(spark):
    pdf = pd.DataFrame({"run_id": [1] * 5, "step": [1, 2, 3, 4, 5], "val_loss": [3.0, 1.0, 2.0, 1.0, math.nan]})
    r = monitor.best_checkpoint(spark.createDataFrame(pdf)).toPandas().iloc[0]
    assert (r.best_step_latest, r.best_step_earliest, r.best_loss) == (4, 2, 1.0)


def test_lr_trace(spark):
    runs = spark.createDataFrame(pd.DataFrame({"run_id": [1], "max_steps": [100]}))
    lr = monitor.lr_trace(runs, initial_lr=0.1, min_lr=0.01, warmup_steps=10).toPandas().set_index("step")
    assert lr.loc[1, "learning_rate"] == pytest.approx(0.01)
    assert lr.loc[11, "learning_rate"] == pytest.approx(0.1)
    assert lr.loc[100, "learning_rate"] < lr.loc[50, "learning_rate"] < 0.1


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_two_decimal_taus_repeated_steps_and_string_keys(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    pdf = _history(seed=21, runs=8, steps=60)
    pdf["kendall_tau"] = np.round(np.random.default_rng(4).uniform(-0.3, 0.3, len(pdf)), 2)
    pdf.loc[pdf.step % 9 == 0, "val_loss"] = np.nan
    pdf["step"] = (pdf.step + 1) // 2                      # every step twice
    pdf["val_loss"] = pdf.groupby(["run_id", "step"]).val_loss.transform(lambda x: x.sort_values().to_numpy())
    pdf["who"] = "run " + pdf.run_id.astype(str)
    df = spark.createDataFrame(pdf)
    for min_delta in (0.0, 0.03):
        got = monitor.early_stop_trace(df, ["who", "run_id"], patience=4, min_delta=min_delta).toPandas()
        assert len(got) == len(pdf)
        exp = _expected(pdf.sort_values(["run_id", "step", "val_loss"], na_position="first"),
                        patience=4, min_delta=min_delta)
        for c in ["improved", "best_step", "counter"]:
            assert (exp.groupby("run_id")[c].sum() == got.groupby("run_id")[c].sum()).all(), (c, min_delta)
    assert len(monitor.degeneration_warnings(df).toPandas()) == len(pdf)


@pytest.mark.parametrize("path", ["window", "ranged"])
def test_min_delta_recurrence_in_batch(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("hot_keys")
    pdf = _history(seed=11)
    got = monitor.early_stop_trace(spark.createDataFrame(pdf), patience=4, min_delta=0.02).toPandas()
    exp = _expected(pdf, patience=4, min_delta=0.02)
    m = exp.merge(got, on=["run_id", "step"], suffixes=("", "_g"))
    assert len(m) == len(pdf)
    for c in ["improved", "best_step", "counter", "stop_now", "stopped"]:
        assert (m[c].astype("int64") == m[c + "_g"].astype("int64")).all(), c


def test_stream_takes_string_runs_flags_late_rows_and_ends_idle_runs(spark, tmpdir_path):
    pdf = pd.DataFrame({"who": "run a", "step": [1, 2, 2, 3], "val_loss": [3.0, 2.0, 2.5, 1.0], "kendall_tau": 0.1,
                        "score_entropy": 1.0, "mean_self_consistency_var": 0.0,
                        "ts": pd.to_datetime(["2024-01-01"] * 4)})
    src, out = (os.path.join(tmpdir_path, n) for n in ("evals", "out"))

    def batch(rows):
        spark.createDataFrame(rows).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        q = (monitor_stream(stream, run="who", ts="ts", watermark="1 hour", idle_hours=24).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", os.path.join(tmpdir_path, "ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        return spark.read.parquet(out).toPandas()

    first = batch(pdf.iloc[[0, 1, 3]])
    assert set(first.run_id) == {"run a"} and not first.late.any()
    second = batch(pdf.iloc[[2]])
    assert second[second.late][["step", "n_late", "best_loss"]].values.tolist() == [[2, 1, 1.0]]
    batch(pdf.iloc[[3]].assign(who="run b", ts=pd.Timestamp("2024-02-01")))
    batch(pdf.iloc[[3]].assign(who="run b", step=4, ts=pd.Timestamp("2024-02-02")))
    again = batch(pdf.iloc[[0]].assign(step=1, val_loss=9.0, ts=pd.Timestamp("2024-02-02")))
    fresh = again[(again.run_id == "run a") & (again.val_loss == 9.0)]
    assert fresh[["late", "counter", "best_loss"]].values.tolist() == [[False, 0, 9.0]]
