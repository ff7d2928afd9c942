import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.operators import scoring


@F.pandas_udf(T.DoubleType())
def word_count_judge(prompt: pd.Series, response: pd.Series) -> pd.Series:
    return response.str.split().str.len().clip(1, 10).astype("float64")


def _responses(spark):
    return spark.createDataFrame(pd.DataFrame({"sample_id": [1, 2, 3], "prompt": ["p"] * 3,
                                               "response": ["one", "one two three", " ".join(["w"] * 20)]}))


def test_pluggable_arrow_scorer(spark):
    got = scoring.score_responses(_responses(spark), word_count_judge).toPandas().sort_values("sample_id")
    assert got.judge_score.tolist() == [1.0, 3.0, 10.0]
    assert scoring.score_responses(_responses(spark).limit(0), word_count_judge).count() == 0


def test_self_consistency_repeats(spark):
    df = _responses(spark)
    sc = scoring.self_consistency(df, lambda rep: F.length("response") + rep, n_samples=3).toPandas()
    r = sc.sort_values("sample_id").iloc[0]
    assert r.mean_score == pytest.approx(5.0) and r.variance == pytest.approx(2 / 3) and list(r.scores) == [4, 5, 6]
    one = scoring.self_consistency(df, lambda rep: F.length("response"), n_samples=1).toPandas()
    assert (one.variance == 0.0).all()
