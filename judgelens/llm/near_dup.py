"""N-gram Jaccard join by MinHash banding.

Texts are sets of word 5-grams. Documents with equal sets are one class and go on as one row. Each
class gets a MinHash signature, cut into bands whose number and length are chosen for the target
recall at the threshold; classes that share a band are candidates, and a candidate pair is a link
if the Jaccard similarity of the full sets reaches the threshold.

No step lists the pairs of a bucket. First each member of a bucket is compared with the bucket's
least member, which ties large groups of near copies together with one comparison per member.
Buckets that then still hold members of several components are compared in full, in blocks inside
tasks that emit links only. Links are counted within each component: members close to its least
member are linked with each other by the triangle inequality, and only the others are compared in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelens.llm.common import WordHasher, batched, cut_lineage, text_rows

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Hash functions that the bands may use in all.
MAX_HASHES = 100
#: Classes, and set elements, that a block of a group holds on average when a group is compared in full.
BLOCK_ROWS, BLOCK_CELLS = 256, 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands with which a pair at the threshold shares one of them with
    probability ``recall``, within ``max_hashes`` hash functions. Longer bands mean fewer candidates."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def gram_set(hasher: WordHasher, text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams; of all its words if it has fewer than n."""
    words = hasher.words((text or "").lower().encode())
    return np.unique(hasher.grams(words, min(n, len(words)) or 1))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, ref, key, bands): ``key`` names the n-gram set, or the text itself if it has no word."""
    schema = pa.schema([("doc_id", pa.int64()), ("ref", pa.string()), ("key", pa.string()), ("bands", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rng = WordHasher(), np.random.RandomState(11)
        draw = lambda: rng.randint(1, 2**63 - 1, bands * rows, dtype=np.int64).astype(np.uint64)[:, None]
        xor, mul = draw(), draw() * np.uint64(2) + np.uint64(1)
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def out():
            for doc_id, ref, text in text_rows(batches, "doc_id", "ref", "text"):
                grams = gram_set(hasher, text, words)
                if not len(grams):
                    yield doc_id, ref, "t" + hashlib.blake2b((text or "").encode(), digest_size=16).hexdigest(), []
                    continue
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(grams), 2048):
                    np.minimum(low, ((grams[i:i + 2048] ^ xor) * mul).min(axis=1), out=low)
                band = number.copy()
                for j in range(rows):
                    band = hasher.mix(band * np.uint64(0xD1342543DE82EF95) + low[j::rows][:bands])
                yield doc_id, ref, "g" + hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest(), band.view(np.int64)

        yield from batched(out(), schema)

    return docs.select("doc_id", "ref", "text").mapInArrow(scan, "doc_id long, ref string, key string, bands array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """(key, comp): the least key that each key of the links (a, b) is joined with.

    Every key takes the least label among its neighbours, then its label's label, until nothing
    changes. Labels are grouped minima, combined before the shuffle, so hubs cost no more."""
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    state = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("key"), F.least("a", "least").alias("comp"))
    while True:
        state = cut_lineage(state)
        near = (edges.join(state, edges["b"] == state["key"]).groupBy("a").agg(F.min("comp").alias("near")))
        moved = state.join(near, state["key"] == near["a"]).select("key", F.least("comp", "near").alias("now"), F.col("comp").alias("was"))
        jump = moved.select(F.col("key").alias("_k"), F.col("now").alias("_next"))
        after = cut_lineage(moved.join(jump, moved["now"] == jump["_k"], "left")
                            .select("key", F.least("now", F.coalesce("_next", "now")).alias("comp"), "was"))
        if after.filter("comp != was").isEmpty():
            return after.select("key", "comp")
        state = after.select("key", "comp")


def in_blocks(members: DataFrame, threshold: float, apart: bool) -> DataFrame:
    """Compare the members (group, key, comp, weight, grams, near) of each group, all with all but near with near, in blocks.

    A group is dealt into blocks by a hash of the key, near members and others apart; each pair of blocks is
    one task group, so a member is copied once for each block that it is compared with, and pairs exist
    only inside a task. With ``apart``, members of different comp are compared and links (a, b)
    emitted; else the result is (key, n): the summed weight of the members it is linked with."""
    blocks = lambda near: F.greatest(F.ceil(F.count_if(near) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(near, F.size("grams"))), F.lit(0)) / BLOCK_CELLS))
    sizes = members.groupBy("group").agg(blocks(F.col("near")).alias("n_near"), blocks(~F.col("near")).alias("n_rest"))
    dealt = members.join(sizes, "group").withColumn("block", F.when(F.col("near"), F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.col("n_near"))))
                                                    .otherwise(F.col("n_near") + F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.col("n_rest")))))
    first, last = F.when(F.col("near"), F.col("n_near")).otherwise(F.lit(0)).cast("long"), (F.col("n_near") + F.col("n_rest") - 1).cast("long")
    copies = dealt.filter(first <= last).withColumn("other", F.explode(F.sequence(first, last))).select(
        "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "comp", "weight", "grams")
    out = "a string, b string" if apart else "key string, n long"

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        left = frame[frame["block"] == i]
        right = left if i == j else frame[frame["block"] == j]
        hit = jaccard(list(left["grams"]), list(right["grams"])) >= threshold
        if i == j:
            np.fill_diagonal(hit, False)
        if apart:
            hit &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
            x, y = np.nonzero(np.triu(hit) if i == j else hit)
            # one link for each two components is enough to join them
            pairs = pd.DataFrame({"a": left["key"].to_numpy()[x], "b": right["key"].to_numpy()[y], "ca": left["comp"].to_numpy()[x], "cb": right["comp"].to_numpy()[y]})
            return pairs.drop_duplicates(["ca", "cb"])[["a", "b"]]
        found = pd.DataFrame({"key": left["key"], "n": hit @ right["weight"].to_numpy()})
        if i != j:
            found = pd.concat([found, pd.DataFrame({"key": right["key"], "n": hit.T @ left["weight"].to_numpy()})])
        return found

    done = copies.groupBy("group", "i", "j").applyInPandas(compare, out)
    return done if apart else done.groupBy("key").agg(F.sum("n").alias("n"))


def jaccard(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Similarities of all left with all right sets: indicator matrices multiplied, some columns at a time."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    cells, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    cut = int(sizes[0].sum())
    columns = [column[:cut], column[cut:]]
    both = np.intersect1d(columns[0], columns[1])  # other columns add nothing
    place = np.full(len(cells), -1, np.int64)
    place[both] = np.arange(len(both))
    at = [place[c] for c in columns]
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(both), width):
        m = []
        for side in (0, 1):
            inside = (at[side] >= low) & (at[side] < low + width)
            x = np.zeros((len(sizes[side]), min(width, len(both) - low)), np.float32)
            x[owner[side][inside], at[side][inside] - low] = 1
            m.append(x)
        common += m[0] @ m[1].T
    return common / (sizes[0][:, None] + sizes[1][None, :] - common)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of each document: doc_id, class_id, n_links, class_docs.

    Two documents are linked if the Jaccard similarity of their sets of lower-cased word n-grams is
    at least ``threshold``; a text with fewer than ``words`` words is the set of its one gram of all
    words. A class is a connected group; class_id is its smallest doc_id, n_links the number of other
    rows that the row is linked with directly, class_docs the rows of the class. Texts without a
    word (null counts as empty) are linked only with equal texts. Repeated rows are copies like any
    other; rows with a null id take part, and a class of such rows alone has a null class_id. A word of
    any length is one word. An empty table gives no rows. Other columns are not read."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_ref(F.col(id_col), F.col(text_col)).alias("ref"))
    signed, classes, comps, sets = linked(texts, words, threshold, recall)
    return counted(signed, classes, comps, sets, threshold)


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that ``near_duplicates`` leaves one of each class: that of the
    smallest doc_id (ids before nulls); of repeated rows one, the first by a hash of all columns. An empty table
    keeps none."""
    rows = docs.select(row_ref(F.col(id_col), F.col(text_col)).alias("ref"), F.struct(*docs.columns).alias("row"))
    texts = rows.select("ref", F.col(f"row.{id_col}").cast("long").alias("doc_id"), F.col(f"row.{text_col}").alias("text"))
    _, classes, comps, _ = linked(texts, words, threshold, recall)
    kept = (classes.join(comps, "key", "left").groupBy(F.coalesce("comp", "key"))
            .agg(F.min(F.struct("no_id", "rep", "ref")).alias("least")).select(F.col("least.ref").alias("ref")))
    first = F.row_number().over(Window.partitionBy("ref").orderBy(F.xxhash64("row")))
    return rows.join(kept, "ref", "left_semi").withColumn("nth", first).filter("nth = 1").select("row.*")


def row_ref(doc_id: Column, text: Column) -> Column:
    """Names a row's id and text; a row of the same name is an equal one."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def linked(texts: DataFrame, words: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For (doc_id, text, ref): the signed rows, the classes of equal sets, (key, comp) of the classes
    that have links, and (key, grams) of those that had candidates."""
    bands, rows = choose_bands(threshold, recall)
    signed = cut_lineage(signatures(texts, words, bands, rows))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "ref", "bands")).alias("least")
    classes = cut_lineage(signed.groupBy("key").agg(least, F.count(F.lit(1)).alias("weight"))
                          .select("key", "least.no_id", F.col("least.doc_id").alias("rep"), "weight", "least.bands", "least.ref"))
    buckets = cut_lineage(shared_buckets(classes))
    sets = cut_lineage(class_sets(texts, classes, buckets, words))
    hubs = buckets.groupBy("bucket").agg(F.min("key").alias("hub"))
    pairs = buckets.join(hubs, "bucket").filter("key != hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut_lineage(verified(pairs, sets, threshold))
    comps = components(links)
    more = cut_lineage(in_blocks(unresolved(buckets, comps, sets), threshold, apart=True))
    if not more.isEmpty():
        comps = components(links.union(more))
    return signed, classes, comps, sets


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, key) for the band values that more than one class has."""
    every = classes.select("key", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return every.join(shared, "bucket").select("bucket", "key")


def class_sets(texts: DataFrame, classes: DataFrame, buckets: DataFrame, words: int) -> DataFrame:
    """(key, grams) of the classes in shared buckets, each made from one of its texts."""
    schema = pa.schema([("key", pa.string()), ("grams", pa.list_(pa.int64()))])
    wanted = buckets.select("key").distinct().join(classes, "key").select("key", "ref")
    # repeated rows once; the join has dealt them by ref already
    chosen = texts.select("ref", "text").join(wanted, "ref").dropDuplicates(["ref"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        yield from batched(((k, gram_set(hasher, text, words).view(np.int64)) for k, text in text_rows(batches, "key", "text")), schema)

    return chosen.select("key", "text").mapInArrow(scan, "key string, grams array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda name: sets.select(F.col("key").alias(name), F.col("grams").alias(f"grams_{name}"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
            .filter(F.col("common") >= threshold * (F.size("grams_a") + F.size("grams_b") - F.col("common")))
            .select("a", "b"))


def unresolved(buckets: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, for ``in_blocks``.

    A bucket of two was compared in full with its hub; buckets with the same members count once."""
    placed = buckets.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    mixed = (placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"),
                                          F.expr("bit_xor(xxhash64(key))").alias("x"), F.expr("bit_xor(xxhash64('2', key))").alias("y"))
             .filter("lo != hi and n > 2").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"))
    return (placed.join(mixed, "bucket").join(sets, "key")
            .select(F.col("bucket").cast("string").alias("group"), "key", "comp", F.lit(1).cast("long").alias("weight"), "grams",
                    F.lit(False).alias("near")))


def near_hubs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(group, key, weight, near) of the members (group, key, weight): whether a member is within half of the
    distance 1 - threshold of its group's least key. The Jaccard distance is a metric, so any two near
    members are linked, whatever else they hold. One comparison a member."""
    hubs = members.groupBy("group").agg(F.min("key").alias("key")).join(sets, "key").select("group", F.col("grams").alias("hub_grams"))
    common = F.size(F.array_intersect("grams", "hub_grams"))
    distance = 1 - common / (F.size("grams") + F.size("hub_grams") - common)
    return members.join(sets, "key").join(hubs, "group").select(
        "group", "key", "weight", (distance <= (1 - threshold) / 2 - 1e-9).alias("near"))


def counted(signed: DataFrame, classes: DataFrame, comps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    members = comps.join(classes.select("key", "rep", "weight"), "key")
    totals = members.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("weight").alias("class_docs"), F.count(F.lit(1)).alias("n_keys"))
    # in a component of two classes each is linked with the other; in larger ones near members are linked with one
    # another, which is counted by sums, and the others are compared in full with all
    two = members.join(totals.filter("n_keys = 2"), "comp").select("key", (F.col("class_docs") - F.col("weight")).alias("n"))
    large = members.join(totals.filter("n_keys > 2").select("comp"), "comp").select(F.col("comp").alias("group"), "key", "weight")
    placed = cut_lineage(near_hubs(large, sets, threshold))
    sums = placed.groupBy("group").agg(F.sum(F.when(F.col("near"), F.col("weight"))).alias("near_weight"), F.max(~F.col("near")).alias("open"))
    alike = placed.filter("near").join(sums, "group").select("key", (F.col("near_weight") - F.col("weight")).alias("n"))
    rest = placed.join(sums.filter("open").select("group"), "group").join(sets, "key").withColumn("comp", F.col("group"))
    links = two.unionByName(alike).unionByName(in_blocks(rest, threshold, apart=False)).groupBy("key").agg(F.sum("n").alias("n"))
    by_key = (classes.select("key", "rep", "weight").join(members.select("key", "comp"), "key", "left").join(totals, "comp", "left").join(links, "key", "left")
              .select("key", F.coalesce("class_id", "rep").alias("class_id"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                      F.coalesce("class_docs", "weight").alias("class_docs")))
    return signed.select("doc_id", "key").join(by_key, "key").select("doc_id", "class_id", "n_links", "class_docs")
