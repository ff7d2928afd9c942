"""The prefix trie of conversations: which openings are shared, by how many, and what sharing saves.

A node is a distinct sequence of first turns. A prefix is named by a digest that running sums give:
each turn's hash is taken with its place, and the sums of the hashes up to a place name the prefix, so
a conversation of any length is cut into slices like any other long key and no text is shuffled.

A count-min sketch of all prefix digests screens them. It never counts too low, so an estimate of one
proves that a prefix has a single conversation, and so have all longer ones: those tails are nodes as
they stand, emitted where they are. Only prefixes that may be shared are shuffled and grouped exactly.

Sums over subtrees need no walk over the trie. The smallest conversation of a node speaks for it, and
from the first node for which a conversation speaks it speaks for all below. So what a conversation
saves below a node is a difference of its running word counts, a leaf is counted by the conversation
that speaks for it, and both are summed over the members of each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import batched, cut_lineage, fold_of, text_rows
from judgelens.llm.mixing import word_count
from judgelens.operators.prefix import Running, all_keys_small, running

#: Cells of each of the sketch's two rows: four for each prefix, within these bounds. The upper one bounds
#: what is broadcast (two bits a cell: 32 MB); beyond it more prefixes pass the screen, results stay.
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27
#: Cells of a slice of the sketch; cells that a task holds before it hands them on; characters of a piece of an id list.
SLICE, HELD_CELLS, PIECE_CHARS = 1 << 16, 1 << 22, 1 << 16
#: The contract's splice: conversations in families of this many, heads of this many kinds of length.
FAMILY, HEADS = 20, 4

_EXACT = "decimal(38,0)"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """(conv_id, place, content, words) of each turn, with ``texts`` also role and text.

    Turns are ordered by turn (null first), equal ones by the digest of role and text, and placed
    from 1. ``content`` is that digest. A null role or text is an empty one. Rows without a conv_id
    belong to no conversation and are left out. Other columns are not read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("content"), word_count(text).alias("words"),
        *([role.alias("role"), text.alias("text")] if texts else []), F.lit(1).alias("one"), F.monotonically_increasing_id().alias("row"))
    # row parts repeated turns, so that they too can be cut into slices; the checkpoint fixes it
    placed = running(cut_lineage(turns), ["conv_id"], ["turn", "content", "row"], [Running("place", "sum", "one")])
    return placed.select("conv_id", F.col("place").cast("long").alias("place"), "content", "words", *(["role", "text"] if texts else []))


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, length), and their turns by depth."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), turns.withColumnRenamed("place", "depth")


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 20, then its own after its
    first h, where h is crc32 of c as text, modulo 4. Conversations may end up without turns.
    Returns (conv_id, length) of all of them, and the rebuilt turns by depth."""
    extra = [c for c in turns.columns if c not in ("conv_id", "place")]
    heads = (turns.filter((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("first"))
             .agg(F.array_sort(F.collect_list(F.struct("place", *extra))).alias("lead")))  # three turns at most
    convs = (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
             .select("conv_id", "own", fold_of("conv_id", HEADS).cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
             .join(heads, "first", "left")
             .select("conv_id", "h", F.expr("slice(coalesce(lead, array()), 1, cast(h as int))").alias("lead"), F.greatest(F.lit(0), F.col("own") - F.col("h")).alias("rest"))
             .withColumn("kept", F.size("lead").cast("long")))
    taken = convs.select("conv_id", F.explode("lead").alias("t")).select("conv_id", F.col("t.place").alias("depth"), *[F.col(f"t.{c}").alias(c) for c in extra])
    own = turns.join(convs.select("conv_id", "h", "kept"), "conv_id").filter("place > h").select(
        "conv_id", (F.col("kept") + F.col("place") - F.col("h")).alias("depth"), *extra)
    return convs.select("conv_id", (F.col("kept") + F.col("rest")).alias("length")), taken.unionByName(own)


def _name(depth: Column, one: Column, two: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), one.cast(_EXACT).cast("string"), two.cast(_EXACT).cast("string"))))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, path_words) for each place of each conversation: 128-bit names
    of the prefix that ends there and of the one before, words of its last turn and of all of it."""
    tag = lambda k: F.xxhash64(F.lit(k), "depth", "content").cast("decimal(20,0)")
    tagged = turns.select("conv_id", "depth", "words", tag(1).alias("tag1"), tag(2).alias("tag2"))
    sums = running(tagged, ["conv_id"], ["depth"], [Running("sum1", "sum", "tag1", kind="decimal(20,0)"), Running("sum2", "sum", "tag2", kind="decimal(20,0)"),
                                                    Running("path_words", "sum", "words")], small=all_keys_small(tagged, ["conv_id"]))
    return sums.select("conv_id", "depth", _name(F.col("depth"), F.col("sum1"), F.col("sum2")).alias("node"),
                       _name(F.col("depth") - 1, F.col("sum1") - F.col("tag1"), F.col("sum2") - F.col("tag2")).alias("parent"),
                       "words", F.col("path_words").cast("long").alias("path_words"))


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in either row of the sketch; the second row's cells follow the first's."""
    u = keys.view(np.uint64)
    mask = np.uint64(cells - 1)
    return np.stack([u & mask, (u >> np.uint64(32) & mask) + np.uint64(cells)]).astype(np.int64)


def sketch(keys: DataFrame, cells: int) -> np.ndarray:
    """Count-min sketch of the long column ``key``: two rows of ``cells`` counters that stop at two, as the
    bits "two or more". Tasks count what they hold, slices of cells are merged, the bits (bounded by
    ``MAX_CELLS``) come to the driver."""
    part = pa.schema([("slice", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(held):
            at, n = np.unique(np.concatenate(held), return_counts=True)
            for piece in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // SLICE)) + 1):
                low = (at[piece] % SLICE).astype(np.uint16)
                yield int(at[piece[0]] // SLICE), low[n[piece] == 1].tobytes(), low[n[piece] > 1].tobytes()

        def rows():
            held, size = [], 0
            for batch in batches:
                held.append(_cells(batch.column(0).to_numpy(), cells).ravel())
                size += len(held[-1])
                if size >= HELD_CELLS:
                    yield from handed(held)
                    held, size = [], 0
            if size:
                yield from handed(held)

        yield from batched(rows(), part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, seen, twice = None, None, None
            for key, once, more in text_rows(batches, "slice", "once", "more"):
                if key != now:
                    if now is not None:
                        yield now, np.packbits(twice).tobytes()
                    now, seen, twice = key, np.zeros(SLICE, bool), np.zeros(SLICE, bool)
                once = np.frombuffer(once, np.uint16)
                twice[once[seen[once]]] = True
                seen[once] = True
                twice[np.frombuffer(more, np.uint16)] = True
            if now is not None:
                yield now, np.packbits(twice).tobytes()

        yield from batched(rows(), pa.schema([("slice", pa.int64()), ("bits", pa.binary())]))

    merged = (keys.select("key").mapInArrow(count, "slice long, once binary, more binary")
              .repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice long, bits binary"))
    bits = np.zeros(2 * cells // 8, np.uint8)
    for r in merged.toLocalIterator():
        bits[r["slice"] * SLICE // 8:(r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def may_be_shared(spark, bits: np.ndarray):
    """A column function of a long key: whether the sketch's estimate of it is above one."""
    cells, sent = len(bits) * 4, spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def above_one(key: pd.Series) -> pd.Series:
        at = _cells(key.to_numpy(np.int64), cells)
        one, two = sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        return pd.Series((one & two).astype(bool))

    return above_one


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) for (node, conv_id) rows: SHA-256 of the ids in ascending order, comma-joined.

    A list of any length: ranges of it become pieces of text, and the pieces of a node pass through
    its hash one by one."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            node, first, ids, size = None, None, [], 0
            for key, conv in text_rows(batches, "node", "conv_id"):
                if key != node or size >= PIECE_CHARS:
                    if ids:
                        yield node, first, ",".join(ids)
                    node, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if ids:
                yield node, first, ",".join(ids)

        yield from batched(rows(), pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            node, h = None, None
            for key, ids in text_rows(batches, "node", "ids"):
                if key != node:
                    if h:
                        yield node, h.hexdigest()
                    node, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if h:
                yield node, h.hexdigest()

        yield from batched(rows(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))

    pieces = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """A row per node of the conversations (conv_id, length) and their turns (conv_id, depth, content, words):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Without conversations there is no node, else the root always is one. Members of the trie are
    all conversations, those without turns included. Prefixes are equal if their 128-bit names are."""
    spark = convs.sparkSession
    root = _name(F.lit(0), F.lit(0), F.lit(0))
    convs, rows = cut_lineage(convs), cut_lineage(prefixes(turns))
    cells = min(max_cells, max(MIN_CELLS, 1 << (4 * rows.count()).bit_length()))
    shared = may_be_shared(spark, sketch(rows.select(F.xxhash64("node").alias("key")), cells))
    # the first place at which a conversation is proved alone; it is alone from there on
    alone = rows.filter(~shared(F.xxhash64("node"))).groupBy("conv_id").agg(F.min("depth").alias("alone"))
    convs = cut_lineage(convs.join(alone, "conv_id", "left"))
    rows = rows.join(convs, "conv_id")
    top, tails = rows.filter("depth = alone"), rows.filter("depth > alone")
    maybe = cut_lineage(rows.filter("alone is null or depth < alone").unionByName(convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("path_words"), "length", "alone")))
    nodes = cut_lineage(maybe.groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("longest"), F.min("parent").alias("parent"),
        F.min(F.col("path_words") - F.col("words")).alias("before")))
    # per conversation: the depth from which it speaks for its nodes, its words up to there, whether it speaks for a leaf
    speaks = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("s"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    voice = (maybe.groupBy("conv_id").agg(F.max("path_words").alias("all_words"), F.first("alone").alias("alone")).join(speaks, "conv_id", "left")
             .select("conv_id", F.col("s.depth").alias("speaks"), F.coalesce("s.before", "all_words").alias("up_to"),
                     (F.col("alone").isNotNull() | F.coalesce("leaf", F.lit(False))).cast("long").alias("leaf")))
    silent = F.col("speaks").isNull() | (F.col("depth") < F.col("speaks"))
    below = maybe.join(voice, "conv_id").select(
        "node", F.when(silent, F.col("up_to") - F.col("path_words") + F.col("words")).otherwise(0).alias("saved"), "leaf", F.lit(0).cast("long").alias("child"))
    children = nodes.select("parent").unionByName(top.select("parent")).filter("parent is not null").select(
        F.col("parent").alias("node"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"), F.lit(1).cast("long").alias("child"))
    sums = below.unionByName(children).groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))
    ends = ends_hashes(maybe.filter("depth = length").select("node", "conv_id"))
    own_end = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_NO_ENDS))
    single = [F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
              F.lit(0).cast("long").alias("saved_tokens"), own_end.alias("ends_sha256")]
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = nodes.join(sums, "node").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hung = grouped.select("conv_id", "depth", "parent", *out[3:]).unionByName(top.select("conv_id", "depth", "parent", *single))
    return hung.join(above, "parent", "left").select(*out).unionByName(tails.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *single))


def prefix_trie(conversations: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """The trie of the conversations as they stand: see ``numbered`` for odd rows and ``trie`` for the columns."""
    return trie(*whole(numbered(conversations)), max_cells=max_cells)


def with_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn, from turns by depth that carry them (``numbered(...,
    texts=True)``); null for the root."""
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")
