"""Several human scores per sample: consensus by mean, by rank, and by a fit of the annotators.

Human scores are no gold standard: annotators differ in how high they score. Ratings are rows
``(sample_id, annotator, score)``. They are first collapsed to cells (map-side), so an annotator who
scored a sample several times counts with the mean weighted by the number of ratings. The cells are
dealt out by sample once and every further pass reads them so from the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .dominance import whole_groups
from .keys import join_on
from .prefix import all_keys_small, prefix_before


#: Decimal places to which two means of an annotator must agree to be a tie.
_TIE_PLACES = 9

#: Annotators whose biases a round sends to every executor, at most; more are joined by a shuffle.
BROADCAST_ANNOTATORS = 500_000


@dataclass(frozen=True)
class AnnotatorFit:
    """Additive fit ``score = sample effect + annotator bias``: the effects by sample, the biases by
    annotator (weighted mean 0), the rounds taken and the last round's largest change of a bias."""

    samples: DataFrame
    annotators: DataFrame
    rounds: int
    change: float


def rating_cells(ratings: DataFrame, sample: str = "sample_id", annotator: str = "annotator",
                 score: str = "score") -> DataFrame:
    """(sample_id, annotator, total, weight): sum and number of the scores of each pair. Missing and
    NaN scores are no ratings; a NULL sample or annotator is one of its own."""
    s = F.col(score).cast("double")
    return (ratings.filter(s.isNotNull() & ~F.isnan(s))
            .groupBy(F.col(sample).alias("sample_id"), F.col(annotator).alias("annotator"))
            .agg(F.sum(s).alias("total"), F.count(F.lit(1)).cast("double").alias("weight")))


def mean_consensus(cells: DataFrame) -> DataFrame:
    """Per sample: ratings, annotators, mean score and population spread of the annotators' means."""
    return cells.groupBy("sample_id").agg(
        F.sum("weight").cast("bigint").alias("n_ratings"), F.count(F.lit(1)).alias("n_annotators"),
        (F.sum("total") / F.sum("weight")).alias("mean_score"),
        F.stddev_pop(F.col("total") / F.col("weight")).alias("annotator_spread"))


def _place() -> Column:
    return F.when(F.col("_n") > 1, (F.col("_c_before") + (F.col("_c") - 1.0) / 2.0) / (F.col("_n") - 1.0)).otherwise(0.5)


def rank_consensus(cells: DataFrame) -> DataFrame:
    """Borda consensus: per sample the mean over its annotators of the sample's place among all that
    the annotator scored, from 0 (lowest) to 1; ties (means equal to nine places, so that the order in
    which scores were added up decides nothing) share the average place.

    Ranks come from a prefix sum within the annotator, so one who scored a third of all samples is
    cut into slices like any other long key. An annotator with a single sample says nothing of its
    place and counts 0.5.
    """
    means = cells.select("sample_id", "annotator", F.round(F.col("total") / F.col("weight"), _TIE_PLACES).alias("_v"), F.lit(1.0).alias("_c"))
    if all_keys_small(means, ["annotator"]):
        # Every annotator fits one task (checked): ranks and counts from windows, one shuffle.
        by = Window.partitionBy("annotator")
        placed = means.select("sample_id", (F.rank().over(by.orderBy("_v")) - 1.0).alias("_c_before"),
                              F.sum("_c").over(Window.partitionBy("annotator", "_v")).alias("_c"), F.sum("_c").over(by).alias("_n"))
        return placed.groupBy("sample_id").agg(F.avg(_place()).alias("borda"))
    ranks = prefix_before(means, ["annotator"], "_v", ["_c"], small=False)
    n = means.groupBy("annotator").agg(F.sum("_c").alias("_n"))
    placed = join_on(join_on(means.drop("_c"), ranks, ["annotator", "_v"]), n, ["annotator"])
    return placed.groupBy("sample_id").agg(F.avg(_place()).alias("borda"))


def fit_annotators(cells: DataFrame, max_rounds: int = 50, tol: float = 1e-9) -> AnnotatorFit:
    """Alternating least squares of ``score = effect(sample) + bias(annotator)``.

    A round takes each sample's mean of what the biases leave of its scores, and then each annotator's
    mean of what the effects leave. The cells stay where they were dealt by sample: the biases
    are brought to them (a broadcast of at most ``BROADCAST_ANNOTATORS`` rows, else a join), the effects
    are sums over the cells of whole samples, and only partial sums by annotator are shuffled, so an
    annotator with most of the ratings is never one task. Where a sample is too large for one task
    (checked) its effect comes from a keyed aggregate joined back, split by Spark's skew join.
    Only the table of biases is carried to the next round, by checkpoint. Rounds end once no
    bias moves by more than ``tol``, or after ``max_rounds``; the squared error falls with every round.
    Samples and annotators that no chain of ratings links are fitted apart.
    """
    return _fit(*_by_sample(cells), max_rounds, tol)


def _by_sample(cells: DataFrame) -> tuple[DataFrame, bool]:
    """The cells from the checkpoint folder, and whether each sample fits one task: then they are kept as one
    row per sample and come sample by sample, and ``_first`` marks a sample's first cell."""
    whole = all_keys_small(cells, ["sample_id"])
    if not whole:
        return cut_lineage(cells), whole
    packed = cut_lineage(cells.groupBy("sample_id").agg(F.collect_list(F.struct("annotator", "total", "weight")).alias("_cells")))
    return packed.select("sample_id", F.posexplode("_cells").alias("_at", "_cell")).select(
        "sample_id", "_cell.*", (F.col("_at") == 0).alias("_first")), whole


def _with_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of whole samples with the mean of what the biases leave of the sample's scores."""
    for block in whole_groups(batches):
        starts = np.flatnonzero(block["_first"].to_numpy())
        total, weight, bias = (block[c].to_numpy() for c in ("total", "weight", "bias"))
        effect = np.add.reduceat(total - weight * bias, starts) / np.add.reduceat(weight, starts)
        effect = np.repeat(effect, np.diff(starts, append=len(total)))
        yield from block.drop_columns(["_first"]).append_column("effect", pa.array(effect)).to_batches(max_chunksize=50_000)


def _fit(cells: DataFrame, whole: bool, max_rounds: int, tol: float) -> AnnotatorFit:
    bias = cut_lineage(cells.groupBy("annotator").agg(F.lit(0.0).alias("bias")))
    few = bias.count() <= BROADCAST_ANNOTATORS
    left = F.col("total") - F.col("weight") * F.col("bias")

    unnamed = 0.0  # the bias of the NULL annotator, so that the broadcast join is on the plain key

    def biased(bias: DataFrame) -> DataFrame:
        if not few:
            return join_on(cells, bias, ["annotator"])
        named = cells.join(F.broadcast(bias.filter(F.col("annotator").isNotNull())), "annotator", "left")
        return named.withColumn("bias", F.coalesce("bias", F.lit(unnamed)))

    def effects(bias: DataFrame) -> DataFrame:
        return biased(bias).groupBy("sample_id").agg((F.sum(left) / F.sum("weight")).alias("effect"))

    def fitted(bias: DataFrame) -> DataFrame:
        """The cells with their annotator's bias and their sample's effect."""
        if not whole:
            return join_on(biased(bias), effects(bias), ["sample_id"])
        if few:  # a broadcast leaves the cells in their order
            x = biased(bias).select("annotator", "total", "weight", "bias", "_first")
            return x.mapInArrow(_with_effects, T.StructType([*x.schema.fields[:-1], T.StructField("effect", T.DoubleType())]))
        of = Window.partitionBy("sample_id")
        return biased(bias).withColumn("effect", F.sum(left).over(of) / F.sum("weight").over(of))

    rounds, change = 0, float("inf")
    while rounds < max_rounds and change > tol:
        new = cut_lineage(fitted(bias).groupBy("annotator").agg(
            F.sum("weight").alias("weight"), F.max("bias").alias("_old"),
            (F.sum(F.col("total") - F.col("weight") * F.col("effect")) / F.sum("weight")).alias("_b")))
        # four numbers a round: the mean, the moves furthest up and down, and the NULL annotator's bias
        moved = F.col("_b") - F.col("_old")
        mean, up, down, unnamed = new.agg(F.sum(F.col("weight") * F.col("_b")) / F.sum("weight"), F.max(moved), F.min(moved),
                                          F.max(F.when(F.col("annotator").isNull(), F.col("_b")))).first()
        unnamed = 0.0 if unnamed is None else unnamed - mean
        change = 0.0 if mean is None else max(abs(up - mean), abs(down - mean))
        bias, rounds = new.select("annotator", (F.col("_b") - F.lit(mean or 0.0)).alias("bias")), rounds + 1
    error = F.col("total") / F.col("weight") - F.col("effect") - F.col("bias")
    annotators = fitted(bias).groupBy("annotator").agg(
        F.sum("weight").cast("bigint").alias("n_ratings"), F.max("bias").alias("bias"),
        F.sqrt(F.sum(F.col("weight") * error * error) / F.sum("weight")).alias("residual"))
    return AnnotatorFit(effects(bias), annotators, rounds, change)


def human_consensus(ratings: DataFrame, sample: str = "sample_id", annotator: str = "annotator", score: str = "score",
                    max_rounds: int = 50, tol: float = 1e-9) -> DataFrame:
    """Per sample every consensus: n_ratings, n_annotators, mean_score, annotator_spread, borda, and
    fitted_score (the effect of :func:`fit_annotators`, free of the annotators' biases)."""
    cells, whole = _by_sample(rating_cells(ratings, sample, annotator, score))
    fit = _fit(cells, whole, max_rounds, tol)
    out = join_on(mean_consensus(cells), rank_consensus(cells), ["sample_id"])
    return join_on(out, fit.samples.withColumnRenamed("effect", "fitted_score"), ["sample_id"])
