"""Synthetic scored responses: low / medium / high quality classes with repeated text.

The class mix, repeat counts and score ranges follow the reference's generator; the random
draws come from md5 of the row id, so any row count is generated in parallel and the same id
always gives the same row (not bit-equal to a NumPy stream).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import md5_unit, round_half_up

# Fixed values of the generator (class probabilities .2/.5/.3, repeats, score ranges, texts).
P_LOW, P_MEDIUM = 0.2, 0.5
LOW_TEXT = "Short response. "
MEDIUM_TEXT = "This is a medium quality response with some detail. "
HIGH_TEXT = "This is a high quality, comprehensive response with excellent detail and accuracy. "
LOW_REPEATS, MEDIUM_REPEATS, HIGH_REPEATS = (1, 2), (2, 4), (3, 5)
LOW_SCORES, MEDIUM_SCORES, HIGH_SCORES = (1.0, 4.0), (4.0, 7.0), (7.0, 10.0)
SAMPLE_PROMPT = "Evaluate this response"


def synthetic_columns(id_col: Column) -> dict[str, Column]:
    u_class = md5_unit(F.lit("class"), id_col.cast("string"))
    u_rep = md5_unit(F.lit("repeat"), id_col.cast("string"))
    u_score = md5_unit(F.lit("score"), id_col.cast("string"))
    quality = (F.when(u_class < P_LOW, "low").when(u_class < P_LOW + P_MEDIUM, "medium").otherwise("high"))

    def reps(lo_hi):
        lo, hi = lo_hi
        return F.lit(lo) + F.floor(u_rep * F.lit(float(hi - lo + 1))).cast("int")

    def score(lo_hi):
        lo, hi = lo_hi
        return F.lit(lo) + F.lit(hi - lo) * u_score
    response = (F.when(quality == "low", F.repeat(F.lit(LOW_TEXT), reps(LOW_REPEATS)))
                .when(quality == "medium", F.repeat(F.lit(MEDIUM_TEXT), reps(MEDIUM_REPEATS)))
                .otherwise(F.repeat(F.lit(HIGH_TEXT), reps(HIGH_REPEATS))))
    s = (F.when(quality == "low", score(LOW_SCORES)).when(quality == "medium", score(MEDIUM_SCORES))
         .otherwise(score(HIGH_SCORES)))
    return {"quality": quality, "response": response, "score": round_half_up(s, 2)}


def synthetic_scores(ids: DataFrame, id_col: str = "sample_id") -> DataFrame:
    cols = synthetic_columns(F.col(id_col))
    return ids.select(id_col, cols["quality"].alias("quality"), F.lit(SAMPLE_PROMPT).alias("prompt"),
                      cols["response"].alias("response"), cols["score"].alias("score"))


def generate(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """``n`` synthetic rows with ids 0..n-1, generated in parallel from ``spark.range``."""
    ids = spark.range(0, n, numPartitions=partitions).withColumnRenamed("id", "sample_id")
    return synthetic_scores(ids)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Write ``{"prompt", "response", "score"}`` lines, the scored-response file format."""
    df.select("prompt", "response", "score").write.mode("overwrite").json(path)
