"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number for every key; the smallest draw wins the record. The draw is
exponential with the shard's weight as its rate (``-ln(u) / weight``, u from a digest of key and
shard), so a shard wins in proportion to its weight. A shard's draws don't depend on the other
shards: one that is added takes records only into itself, one that is removed gives up only its
own, and a changed weight moves records only to or from its shard.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import cut_lineage
from judgelens.operators.prefix import Running, running

#: Hex digits of the digest that make the draw: 52 bits, which a double holds exactly.
_DIGITS = 13


def key_text(cols: Sequence[str]) -> Column:
    """The key columns as one text; a null counts as the text ``\\N``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]
    return parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)


def race(key: Column, shards: Mapping[int, float]) -> Column:
    """The winner among ``shards`` (id to weight) as a struct (draw, shard). Equal draws go to the smaller id."""
    if not shards or any(not w > 0 for w in shards.values()):
        raise ValueError("shards need ids and weights above 0")
    runners = F.array(*[F.struct(F.lit(int(i)).alias("id"), F.lit(float(w)).alias("weight")) for i, w in sorted(shards.items())])

    def draw(s: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), s["id"].cast("string"))), 1, _DIGITS), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / float(1 << 4 * _DIGITS)) / s["weight"]).alias("draw"), s["id"].alias("shard"))

    return F.array_min(F.transform(runners, draw))


def assign(docs: DataFrame, shards: Mapping[int, float], added: Mapping[int, float] | None = None,
           key_cols: Sequence[str] = ("doc_id",), shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """``docs`` with the shard of each row and, if ``added`` names more shards, its shard once they are there too.

    Rows with equal keys get the same shard, a null key counts as a text of its own. The rows are
    neither moved nor read twice. New columns replace columns of the same name."""
    row = docs.select(F.struct(*docs.columns).alias("_in"), race(key_text(key_cols), shards).alias("_won"))
    out = {shard_col: F.col("_won.shard")}
    if added:
        row = row.select("_in", "_won", F.least("_won", race(key_text([f"_in.{c}" for c in key_cols]), added)).alias("_won_grown"))
        out[grown_col] = F.col("_won_grown.shard")
    return row.select(*[F.col(f"_in.{c}") for c in docs.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def shard_slots(docs: DataFrame, shards: Mapping[int, float], added: Mapping[int, float],
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot, grown_shard.

    The slots of a shard count from 0 without gaps, by ascending id (null first), size, text_crc32;
    rows that agree in all three take neighbouring slots in any order. A shard of any size, one id
    in every row included, is numbered in slices (see ``operators.prefix``). A null text is an
    empty one. An empty table gives no rows. Other columns are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = assign(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shards, added).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard", "grown_shard", F.lit(1).alias("_one"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "size", "text_crc32", "_row"]  # _row parts repeated rows; the checkpoint fixes it
    placed = running(cut_lineage(rows), ["shard"], order, [Running("slot", "sum", "_one", inclusive=False)])
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: Mapping[int, float], key_cols: Sequence[str] = ("doc_id",)) -> str:
    """Write whole rows as Parquet, a folder for each shard; returns the name of the folder column.

    It is ``shard``, or with as many underscores in front as keep it apart from the columns of
    ``docs``. Rows are dealt by shard and a digest of the row's place, so large shards get several
    files and no shard is one task."""
    name = "shard"
    while name in docs.columns or f"{name}_part" in docs.columns:
        name = "_" + name
    n = max(len(shards), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = f"{name}_part"
    placed = assign(docs, shards, key_cols=key_cols, shard_col=name).withColumn(
        part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-n // len(shards)))))
    placed.repartition(n, name, part).drop(part).write.partitionBy(name).parquet(path)
    return name
