"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are put in a seeded random order. A source that is to give ``target`` words
serves its documents one after the other, starting over when it has given all of them; a document
finishes at virtual time (words the source has given so far) / target. Sorting every service by
virtual finish time interleaves the sources in proportion to their targets, and the stream is cut
where its words reach the total budget.

Nothing is collected and no window holds a whole source or id: documents are range-partitioned in the
shuffled order of their source, and running sums are taken within each range and over the range totals.
So are those of the services, range-partitioned and sorted by virtual finish time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelens.operators.keys import with_group_row
from judgelens.operators.prefix import Running, running
from judgelens.session import cut_lineage

#: How often a document may be taken at most.
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: A word: characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """The seeded order: 60 bits of an MD5 as a number, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, target) for (source, size) rows.

    Sources in code point order, null last, take the weights in turn. A source's target is its
    share of all words, but at most ``max_repeats`` times its own; what is above goes to the others
    by weight until none is above. With the sources sorted by (limit / weight), those that end at
    their limit are a prefix, so running sums over the sources give the answer at once.
    One row per source goes through a single window: the sources are the mix's own parameter list.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (turn + 1).cast("int")).cast("long")
    limits = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    w_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    filled = limits.select("*", left.alias("left"), w_left.alias("w_left")).withColumn(
        "full", F.col("cap").cast("double") * F.col("w_left") <= F.col("left").cast("double") * F.col("w"))
    # for those not at their limit, what is left after the full ones is dealt by weight
    n_left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    nw_left = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("n_left")).cast("double") / F.col("nw_left").cast("double"))
    return (filled.withColumn("n_left", n_left).withColumn("nw_left", nw_left)
            .select("source", "source_size", "n_docs", target.alias("target")))


def fair_queue(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix",
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None) -> DataFrame:
    """Every document with its place in the mix.

    Returns one row per row of ``docs``: doc_id, source, size, source_size, target, taken (words
    the mix takes from it, repeats counted), starts (words its source gives before it in one round),
    and services: an array, one entry per time that it is served, of (virtual_finish, words).
    The services of all sources are sorted by virtual finish time, and the mix ends where its words
    reach ``budget``: by default the sum of the targets, each rounded down, which is virtual time 1.
    The service running in a source at virtual time 1 is two, parted there, so each source gives its
    target rounded down.

    Null texts and texts without a word have size 0 and are never served. Null sources are one
    source. Rows with equal ids come in an order fixed by size; equal rows are interchangeable.
    An empty table gives no rows. Columns other than the three named are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                       F.monotonically_increasing_id().alias("row"))
    return _queue(base, weights, max_repeats, seed, budget).drop("row")


def _queue(base: DataFrame, weights: Sequence[int], max_repeats: int, seed: str, budget: int | None) -> DataFrame:
    """The queue of (doc_id, source, size, row) rows; ``row`` is a number of their own."""
    # read by the targets, the running sums and the services; texts are read once
    base = cut_lineage(base.withColumn("k", shuffle_key(F.col("doc_id"), seed)))
    targets = source_targets(base, weights, max_repeats)
    # a source is cut into slices however many of its rows share an id: row parts them
    placed = running(_null_safe_join(base, targets.drop("n_docs"), "source"), ["source"], ["k", "doc_id", "size", "row"],
                     [Running("starts", "sum", "size", inclusive=False)], small=False).withColumn("starts", F.col("starts").cast("long"))
    total = (targets.agg(F.sum(F.floor("target").cast("long")).alias("budget")) if budget is None
             else targets.agg(F.lit(int(budget)).cast("long").alias("budget")))
    row = ["doc_id", "source", "row", "size", "source_size", "target", "starts"]
    return (_served(placed, total, max_repeats).groupBy(*row)
            .agg(F.sum("words").cast("long").alias("taken"),
                 F.sort_array(F.collect_list(F.when(F.col("words") > 0, F.struct("virtual_finish", "words")))).alias("services"))
            .select("row", "doc_id", "source", "size", "source_size", "target", "taken", "starts", "services"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix",
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None) -> DataFrame:
    """The rows of ``docs`` whole, each with its place in the mix: size, source_size, target, taken, and
    services as in ``fair_queue``. New columns replace columns of the same name. The rows are numbered
    and kept, so rows of equal or null id are told apart."""
    kept = cut_lineage(docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("row")))
    base = kept.select(F.col(f"whole.{id_col}").alias("doc_id"), F.col(f"whole.{source_col}").alias("source"),
                       word_count(F.col(f"whole.{text_col}")).alias("size"), "row")
    new = ["size", "source_size", "target", "taken", "services"]
    queue = _queue(base, weights, max_repeats, seed, budget).select("row", *new)
    return kept.join(queue, "row").select(*[F.col(f"whole.{c}").alias(c) for c in docs.columns if c not in new], *new)


def text_stream(mixed: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The training stream of ``mixed_documents``: a row per service, globally range-sorted by virtual finish time:
    doc_id, source, text, words (that the mix takes of it, from its start), virtual_finish."""
    return (mixed.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.explode("services").alias("s"))
            .select("doc_id", "source", "text", F.col("s.words").alias("words"), F.col("s.virtual_finish").alias("virtual_finish"))
            .orderBy("virtual_finish", F.col("source").asc_nulls_last(), "doc_id"))


def _served(placed: DataFrame, total: DataFrame, max_repeats: int) -> DataFrame:
    """``placed`` with a row per service, of virtual_finish and words: what is left of it by the cut
    where the words of all services, sorted by virtual finish time over all sources, reach the budget.
    Documents of size 0 have one row without words."""

    def parts(i: Column) -> Column:
        start = i.cast("long") * F.col("source_size") + F.col("starts")
        first = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")).cast("long") - start))
        return F.array(F.struct((start + first).alias("finish"), first.alias("words")),
                       F.struct((start + F.col("size")).alias("finish"), (F.col("size") - first).alias("words")))

    rounds = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), parts))
    services = placed.withColumn("s", F.explode_outer(F.filter(rounds, lambda s: s["words"] > 0))).select(
        *placed.columns, F.try_divide(F.col("s.finish").cast("double"), F.col("target")).alias("virtual_finish"), F.col("source").isNull().alias("unnamed"),
        F.col("s.finish").alias("finish"), F.coalesce("s.words", F.lit(0)).cast("long").alias("all_words"))
    # virtual time and source name a service; k spreads the rows without words
    before = running(services, [], ["virtual_finish", "unnamed", "source", "finish", "k"], [Running("before", "sum", "all_words", inclusive=False)], small=False)
    left = F.greatest(F.lit(0), F.col("budget") - F.col("before").cast("long"))
    return with_group_row(before, total, []).withColumn("words", F.least(F.col("all_words"), left))


def mix_stream(queue: DataFrame) -> DataFrame:
    """The training stream of a ``fair_queue``: one row per service, globally range-sorted by
    virtual finish time, whose words add up to the budget: doc_id, source, words, virtual_finish. At equal times a
    null source comes last; rows without words have no service, an empty queue gives no rows."""
    return (queue.select("doc_id", "source", F.explode("services").alias("s"))
            .select("doc_id", "source", F.col("s.words").alias("words"), F.col("s.virtual_finish").alias("virtual_finish"))
            .orderBy("virtual_finish", F.col("source").asc_nulls_last(), "doc_id"))


def _null_safe_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    for c in on[1:]:
        on[0] = on[0] & c
    return left.join(r, on[0]).drop(*[f"_r_{k}" for k in keys])
