import os

import pandas as pd
from pyspark.sql import functions as F

from judgelens.plans import fixtures as fx
from judgelens.streaming.drift import windowed_drift, drift_stream
from tests.conftest import SF_SMALL


def test_drift_stream_matches_batch_for_closed_windows(spark, tmpdir_path):
    h = fx.eval_history(spark, SF_SMALL)
    x = h.select("ts", F.col("val_loss").alias("human_score"),
                 (F.col("val_loss") + (F.col("k") - F.lit(50)) / F.lit(50.0)).alias("judge_score"))
    src = os.path.join(tmpdir_path, "scores")
    x.write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = (drift_stream(stream, watermark="1 day").writeStream.format("memory").queryName("drift_out")
         .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM drift_out").toPandas().set_index(["window_start", "window_end"]).sort_index()
    exp = windowed_drift(spark.read.parquet(src)).toPandas().set_index(["window_start", "window_end"]).sort_index()
    # Append mode emits a window once the watermark has passed its end: every emitted window is
    # complete and equals the batch result; only the newest days may still be open.
    assert len(got) > 0 and set(got.index) <= set(exp.index)
    pd.testing.assert_frame_equal(got, exp.loc[got.index], check_dtype=False, atol=1e-9)
    assert list(exp.index[:len(got)]) == list(got.index)


def test_drift_windows_of_any_width_have_start_and_end(spark):
    h = fx.eval_history(spark, SF_SMALL)
    x = h.select("ts", F.col("val_loss").alias("human_score"), F.col("val_loss").alias("judge_score"))
    got = windowed_drift(x, width="6 hours").toPandas()
    assert got.window_start.is_unique and got.n.sum() == h.count()
    assert ((got.window_end - got.window_start).dt.total_seconds() == 6 * 3600).all()
