"""Splits, score strata and epoch-aware stratified batches as closed-form columns.

The reference draws batches one at a time from mutable pools. Here a batch number is a pure
function of the data and a seed: rows are ordered by ``md5(seed:epoch:id)`` inside their
stratum, dealt out in waves of the per-stratum quotas, and cut into batches of ``B``. Every
position is a running count computed by :func:`running`, so a huge stratum is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import md5_unit
from ..session import cut_lineage
from .keys import with_group_row
from .prefix import Running, all_keys_small, prefix_before, running


def exact_percentiles(df: DataFrame, keys: list[str], col: str, probs: list[float],
                      small: bool | None = None) -> DataFrame:
    """Per group, the linear-interpolation percentiles of ``col`` (the common default rule).

    Distinct values with their cumulative counts come from :func:`prefix_before`; each
    requested position is matched to the value whose rank range covers it.
    """
    k, src = list(keys), df.filter(F.col(col).isNotNull())
    if small is None:
        small = all_keys_small(src, k)
    pref = prefix_before(src.select(*k, F.col(col).alias("_v"), F.lit(1.0).alias("_c")), k, "_v", ["_c"],
                         small=small)
    n = src.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    # Two wanted ranks per probability, put beside each distinct value of the group.
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_n") - F.lit(1)).cast("double")).alias("_pos"))
        for i, p in enumerate(probs)])).alias("_w")
    want = (with_group_row(pref, n, k).select(*k, "_v", "_c", "_c_before", wanted)
            .select(*k, "_v", "_c", "_c_before", "_w._i", "_w._pos")
            .withColumn("_lo", F.floor("_pos").cast("double")).withColumn("_hi", F.ceil("_pos").cast("double"))
            .withColumn("_t", F.col("_pos") - F.floor("_pos")))
    covers = lambda r: (F.col("_c_before") <= F.col(r)) & (F.col(r) < F.col("_c_before") + F.col("_c"))
    hits = want.filter(covers("_lo") | covers("_hi"))
    ab = hits.groupBy(*k, "_i", "_t").agg(F.max(F.when(covers("_lo"), F.col("_v"))).alias("_a"),
                                         F.max(F.when(covers("_hi"), F.col("_v"))).alias("_b"))
    diff = F.col("_b") - F.col("_a")
    val = F.when(F.col("_t") >= 0.5, F.col("_b") - diff * (F.lit(1.0) - F.col("_t"))) \
        .otherwise(F.col("_a") + diff * F.col("_t"))
    per = ab.select(*k, "_i", val.alias("_val"))
    wide = per.groupBy(*k).agg(*[F.max(F.when(F.col("_i") == i, F.col("_val"))).alias(_pname(p))
                                 for i, p in enumerate(probs)])
    return with_group_row(n, wide, k).select(*k, F.col("_n").alias("n"), *[_pname(p) for p in probs])


def _pname(p: float) -> str:
    return "p" + str(round(p * 100, 6)).rstrip("0").rstrip(".").replace(".", "_")


def score_strata(df: DataFrame, keys: list[str] | None = None, score: str = "human_score",
                 high: float = 0.75, low: float = 0.25, small: bool | None = None) -> DataFrame:
    """``stratum`` = high (score >= p_high), low (score <= p_low), else mid.

    When both thresholds coincide a row qualifies for both; it goes to high, so every row is in
    exactly one stratum.
    """
    src, k = df, list(keys or [])
    q = exact_percentiles(src, k, score, [low, high], small=small).select(
        *k, F.col(_pname(low)).alias("low_threshold"), F.col(_pname(high)).alias("high_threshold"))
    j = with_group_row(src, q, k, "left")
    s = F.col(score)
    return j.withColumn("stratum", F.when(s >= F.col("high_threshold"), "high")
                       .when(s <= F.col("low_threshold"), "low").otherwise("mid"))


def train_val_split(df: DataFrame, keys: list[str] | None = None, id_col: str = "sample_id",
                    val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded exact split: the ``floor(n * val_fraction)`` rows first in ``md5(seed:id)`` order
    are validation, the rest train. Disjoint, exhaustive and deterministic."""
    src, k = df, list(keys or [])
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    x = src.withColumn("_h", h).withColumn("_one", F.lit(1.0))
    pos = running(x, k, ["_h", id_col], [Running("_pos", "sum", "_one", inclusive=False)],
                  small=all_keys_small(src, k))
    n = src.groupBy(*k).agg(F.floor(F.count(F.lit(1)) * F.lit(float(val_fraction))).alias("n_val"))
    return with_group_row(pos, n, k).withColumn(
        "split", F.when(F.col("_pos") < F.col("n_val"), "val").otherwise("train")).drop("_h", "_one", "_pos", "n_val")


def hash_split(df: DataFrame, id_col: str = "sample_id", val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded split in one pass: a row's side follows from ``md5(seed:id)`` alone.

    No count, sort or shuffle, so it also runs on a stream, and a row never changes sides when others
    are added or go; rows of equal id stay together. The share of ``val`` is ``val_fraction`` up to binomial
    noise (:func:`train_val_split` meets it exactly, at the cost of an order over all rows).
    """
    if not 0.0 <= val_fraction <= 1.0:
        raise ValueError("val_fraction must be from 0 to 1")
    u = md5_unit(F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return df.withColumn("split", F.when(u < F.lit(float(val_fraction)), "val").otherwise("train"))


def quotas(batch_size: int) -> dict[str, int]:
    """Per-batch slots: a third each; a remainder of 1 goes to high, of 2 to high and low."""
    base, rem = divmod(batch_size, 3)
    return {"high": base + (1 if rem > 0 else 0), "low": base + (1 if rem > 1 else 0), "mid": base}


def epoch_batches(df: DataFrame, keys: list[str] | None = None, id_col: str = "sample_id",
                  score: str = "human_score", batch_size: int = 32, epochs: int = 2,
                  seed: int = 42) -> DataFrame:
    """Assign every row once per epoch to a batch of ``batch_size`` with stratum quotas.

    Within its stratum a row gets position ``p`` in ``md5(seed:epoch:id)`` order and wave
    ``p // quota``; rows are dealt by (wave, high/low/mid, p) and cut every ``batch_size``.
    So batches keep the quotas while each stratum lasts, are full except the epoch's last,
    and no row repeats within an epoch. A group of at most ``batch_size`` rows is one batch.
    """
    if batch_size < 1 or epochs < 1:
        raise ValueError("batch_size and epochs must be positive")
    k = list(keys or [])
    # The size check, percentiles, strata and counts all read these columns: the source is read once.
    src = cut_lineage(df.select(*k, id_col, score))
    # Every key below (group, group+epoch, group+epoch+stratum) has at most as many rows as
    # its group, so one check on the input bounds them all.
    small = all_keys_small(src, k)
    strata = score_strata(src, k, score, small=small).select(*k, id_col, score, "stratum")
    n = src.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    x = (with_group_row(strata, n, k)
         .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("_n") <= batch_size, F.lit(0))
                                                   .otherwise(F.lit(epochs - 1)))))
         .withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                             F.col(id_col).cast("string"))))
         .withColumn("_one", F.lit(1.0)))
    p = running(x, k + ["epoch", "stratum"], ["_h", id_col], [Running("_p", "sum", "_one", inclusive=False)],
                small=small)
    q = quotas(batch_size)
    quota = F.greatest(F.lit(1), F.when(F.col("stratum") == "high", q["high"])
                       .when(F.col("stratum") == "low", q["low"]).otherwise(q["mid"]))
    srank = F.when(F.col("stratum") == "high", 0).when(F.col("stratum") == "low", 1).otherwise(2)
    p = p.withColumn("_wave", F.floor(F.col("_p") / quota)).withColumn("_srank", srank)
    pos = running(p, k + ["epoch"], ["_wave", "_srank", "_p"], [Running("_pos", "sum", "_one", inclusive=False)],
                  small=small)
    return pos.select(*k, id_col, score, "stratum", F.col("epoch").cast("int").alias("epoch"),
                     F.col("_pos").cast("bigint").alias("position"),
                     F.floor(F.col("_pos") / F.lit(batch_size)).cast("bigint").alias("batch_no"))


def epoch_progress(batches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per (epoch, batch): rows in the batch, rows seen so far in the epoch, and progress.

    Positions inside an epoch are contiguous from 0, so the rows seen up to a batch are its
    largest position plus one: a plain aggregate, no running pass needed.
    """
    k = list(keys or [])
    # Kept, so that the batches are derived once: the group size below comes from this small table too.
    per = cut_lineage(batches.groupBy(*k, "epoch", "batch_no").agg(F.count(F.lit(1)).alias("batch_rows"),
                                                               (F.max("position") + 1).alias("seen")))
    n = per.filter(F.col("epoch") == 0).groupBy(*k).agg(F.sum("batch_rows").alias("_n"))
    return with_group_row(per, n, k).select(
        *k, "epoch", "batch_no", F.col("batch_rows").cast("bigint").alias("batch_rows"),
        F.col("seen").cast("bigint").alias("seen"),
        F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("seen") / F.col("_n")).alias("progress"))


def gather_batch(batches: DataFrame, samples: DataFrame, epoch: int, batch_no: int | None = None,
                 id_col: str = "sample_id") -> DataFrame:
    """The sample rows (e.g. responses and human scores) of one batch, or of all batches of an epoch:
    an equi-join on the id, replacing lookup by array position. The batch side is filtered before the join."""
    chosen = batches.filter(F.col("epoch") == F.lit(epoch))
    if batch_no is not None:
        chosen = chosen.filter(F.col("batch_no") == F.lit(batch_no))
    return samples.join(chosen.select(id_col, "batch_no", "position", "stratum"), id_col)
