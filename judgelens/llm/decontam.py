"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max WAND.

The index is of the benchmark, the queries are passages of the corpus: every document is cut into
overlapping windows of words. Postings are kept in blocks of items with the largest impact of each
term in each block. An item's threshold is a share of its own BM25 score, and impacts are kept
divided by it, so a window meets an item at 1. For a window the block maxima of its terms add up to an
upper bound; blocks whose bound stays below 1 are skipped, only the others are scored, and all
windows above a threshold are retrieved. A
retrieved pair is verified by what the window has of the item's question and of its answer, or of the
whole item if no answer is marked: the share of its n-grams or, if larger, of the words that are left
by the fewest edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import batched, text_rows

#: BM25's constants; the share of an item's own score that a window must reach.
K1, B, MIN_SHARE = 1.2, 0.75, 0.6
#: Items in a block of a postings list at least; more where the table of block maxima would pass MAX_CELLS.
BLOCK_ITEMS, MAX_CELLS = 4, 1 << 24
#: Words in an n-gram of the check; shares of question and answer that a window must hold.
GRAM, MIN_QUESTION, MIN_ANSWER = 3, 0.6, 0.6
#: Words of half a window at least; windows start at every half, so items up to that length lie within one.
HALF = 64
#: Windows that are scored at a time.
STRETCH = 512
#: Items that one index holds; larger benchmarks are queried shard by shard. Bytes of text that a task holds
#: while it opens the shards.
SHARD_ITEMS, HELD_BYTES = 2000, 1 << 25

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], ...]:
    """The words of an item's question and answer, parted behind the last question mark that words
    follow; an item without a marked answer is one part."""
    head, mark, tail = text.rpartition("?")
    if mark and words_of(tail) and words_of(head):
        return words_of(head), words_of(tail)
    return (words_of(text),)


def share_in_order(part: list[str], words: list[str]) -> float:
    """1 less the fewest edits (a word replaced, added or left out) that turn ``part`` into any stretch
    of ``words``, as a share of the part's words: an edit costs one word, not the n-grams around it."""
    name = {w: k for k, w in enumerate(part)}
    have = np.array([name.get(w, -1) for w in words], np.int64)
    at = np.arange(len(words) + 1)
    edits = np.zeros(len(words) + 1, np.int64)  # of the part so far, against the stretches that end here
    for w in part:
        step = edits + 1
        np.minimum(step[1:], edits[:-1] + (have != name[w]), out=step[1:])
        edits = np.minimum.accumulate(step - at) + at
    return 1 - int(edits.min()) / len(part)


@dataclass
class Statistics:
    """What all shards of a benchmark share: number of items, mean and largest words of an item, items by term."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


class Index:
    """Inverted index of test items: for each term the impact per item, and its maximum per block.
    The items of a shard take the ``statistics`` of the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        self.n = len(items)
        self.words = [words_of(t) for _, t in items]
        self.parts = [question_and_answer(t or "") for _, t in items]
        lengths = np.array([len(w) for w in self.words], np.float64)
        self.term = {t: k for k, t in enumerate(sorted({t for w in self.words for t in w}))}
        self.block_items = max(BLOCK_ITEMS, -(-len(items) * len(self.term) // MAX_CELLS))
        self.blocks = max(1, -(-len(items) // self.block_items))
        counts: dict[tuple[int, int], int] = {}
        for d, w in enumerate(self.words):
            for t in w:
                counts[self.term[t], d] = counts.get((self.term[t], d), 0) + 1
        cells = np.array(sorted(counts), np.int64).reshape(-1, 2)
        tf = np.array([counts[t, d] for t, d in cells.tolist()], np.float64)
        self.post_start = np.searchsorted(cells[:, 0], np.arange(len(self.term) + 1))
        df, n, mean, longest = np.diff(self.post_start), len(items), lengths.mean() if len(lengths) else 1.0, max(map(len, self.words), default=0)
        if statistics:
            df, n, mean, longest = np.array([statistics.df[t] for t in self.term], np.int64), statistics.n, statistics.mean, statistics.longest
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        self.post_item = cells[:, 1]
        self.post_impact = (idf[cells[:, 0]] * tf * (K1 + 1) / (tf + norm[cells[:, 1]])).astype(np.float32)
        own = np.zeros(len(items))
        np.add.at(own, self.post_item, self.post_impact)
        self.threshold = (MIN_SHARE * own).astype(np.float32)
        self.post_share = self.post_impact / self.threshold[self.post_item]  # an item without a word has no posting
        # the largest share of a threshold that each term brings in each block of items
        self.block_max = np.zeros((len(self.term), self.blocks), np.float32)
        np.maximum.at(self.block_max, (cells[:, 0], self.post_item // self.block_items), self.post_share)
        self.half = max(HALF, longest)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item, score) for all windows and items with a score at the item's threshold or
        above. Long texts are read in stretches that overlap by one half."""
        step = STRETCH * self.half
        for k in range(0, max(1, len(ids) - self.half), step):
            for window, item, score in self._stretch(ids[k:k + step + self.half]):
                yield window + k // self.half, item, score

    def _stretch(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        n = len(self.term)
        half, term = np.divmod(np.unique(at // self.half * n + ids[at]), n)  # the distinct terms of each half
        # a window's bound is that of its two halves together
        runs = np.flatnonzero(np.diff(half, prepend=-1))
        bounds = np.zeros(((len(ids) - 1) // self.half + 1, self.blocks), np.float32)
        bounds[half[runs]] = np.add.reduceat(self.block_max[term], runs, axis=0)
        if len(bounds) > 1:
            bounds = bounds[:-1] + bounds[1:]
        alive = bounds >= 0.9999
        open_ = alive.any(axis=1)
        if not open_.any():
            return []
        # exact scores, over the distinct terms of the windows where a block may reach its threshold
        own, before = half < len(open_), half > 0
        window, term = np.divmod(np.unique(np.concatenate([half[own] * n + term[own], (half[before] - 1) * n + term[before]])), n)
        some = open_[window]
        w, k = _expand(window[some], term[some], self.post_start)
        item = self.post_item[k]
        kept = alive[w, item // self.block_items]
        cells, slot = np.unique(w[kept] * self.n + item[kept], return_inverse=True)
        share = np.bincount(slot, self.post_share[k[kept]])
        good = share >= 1 - 1e-6
        return [(int(c // self.n), int(c % self.n), float(s * self.threshold[c % self.n])) for c, s in zip(cells[good], share[good])]

    def verify(self, words: list[str], item: int) -> tuple[float, float]:
        """Shares of the item's question and answer that the window's words hold; of an item in one
        part, its share as both. In-order shares are worked out where they can reach the threshold."""
        shares, held = [], set(words)
        for part, least in zip(self.parts[item], (MIN_QUESTION, MIN_ANSWER)):
            g = min(GRAM, len(part))
            have = {tuple(words[i:i + g]) for i in range(len(words) - g + 1)} if g else set()
            want = [tuple(part[i:i + g]) for i in range(len(part) - g + 1)] if g else []
            share = sum(x in have for x in want) / len(want) if want else 1.0
            if share < 1 and sum(w in held for w in part) >= least * len(part):
                share = max(share, share_in_order(part, words))
            shares.append(share)
        return shares[0], shares[-1]

    def matches(self, text: str | None) -> dict[int, tuple[float, float, float, float, int]]:
        """The verified items of a text: score, share of the item's own score, overlaps of question
        and answer, first word of the best window."""
        words = words_of(text)
        known = self.term.get
        ids = np.array([known(w, -1) for w in words], np.int64)
        best: dict[int, tuple[float, float, float, float, int]] = {}
        for window, item, score in self.search(ids):
            start = window * self.half
            q, a = self.verify(words[start:start + 2 * self.half], item)
            if q >= MIN_QUESTION and a >= MIN_ANSWER and (item not in best or score > best[item][0]):
                best[item] = (score, score * MIN_SHARE / float(self.threshold[item]), q, a, start)
        return best


def _expand(window: np.ndarray, term: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window with the positions of each of its terms' entries."""
    n = start[term + 1] - start[term]
    w = np.repeat(window, n)
    k = np.repeat(start[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(w))
    return w, k


def contaminated(docs: DataFrame, items: DataFrame, shard_items: int = SHARD_ITEMS, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The verified matches of documents and test items: doc_id, item_id, score, share (of the item's
    own score), question_overlap, answer_overlap, start_word (of the best window), one row for each
    row of ``docs`` and item that match.

    Nulls are empty texts and match nothing, as do items without a word; equal items match alike.
    Items with equal id are indexed apart. Either table may be empty. Other columns are not read.
    The benchmark travels to the tasks as its texts, in shards of ``shard_items`` whose indexes are made there, one
    at a time and in one Python node; so its texts must fit the driver and a worker, its indexes need
    not. The matches are the same for any number of shards."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("share", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start_word", pa.int64())])
    shards = shards_of(items, shard_items, item_id_col, item_text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for held, indexes in stretches(batches, shards, "text"):
                for listed, index in indexes:
                    for doc_id, text in text_rows(held, "doc_id", "text"):
                        best = index.matches(text)
                        for item in sorted(best):
                            yield (doc_id, listed[item][0], *best[item])

        yield from batched(out(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, "doc_id long, item_id long, score double, share double, question_overlap double, answer_overlap double, start_word long")


def keep_clean(docs: DataFrame, items: DataFrame, shard_items: int = SHARD_ITEMS, text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that match no test item. Rows are judged where they are read,
    by one shard of the benchmark after the other."""
    shards = shards_of(items, shard_items, item_id_col, item_text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, indexes in stretches(batches, shards, text_col):
            clean = [np.ones(batch.num_rows, bool) for batch in held]
            for _, index in indexes:
                for batch, mark in zip(held, clean):
                    texts = batch.column(batch.schema.get_field_index(text_col))
                    for i in np.flatnonzero(mark):
                        mark[i] = not index.matches(texts[int(i)].as_py())
            for batch, mark in zip(held, clean):
                yield batch.filter(pa.array(mark))

    return docs.mapInArrow(scan, docs.schema)


def stretches(batches: Iterator[pa.RecordBatch], shards: list, text_col: str) -> Iterator[tuple[list[pa.RecordBatch], Iterator[tuple[list, Index]]]]:
    """Batches whose texts take about ``HELD_BYTES``, with the shards' items and indexes. A task opens one shard
    after the other for each stretch, so it holds one index whatever the size of the benchmark; the
    index of a single shard is made once."""
    only = [(items, Index(items, stats)) for items, stats in shards] if len(shards) == 1 else None

    def indexes():
        yield from only or ((items, Index(items, stats)) for items, stats in shards)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text_col)).nbytes
        if only or size >= HELD_BYTES:
            yield held, indexes()
            held, size = [], 0
    if held:
        yield held, indexes()


def shards_of(items: DataFrame, shard_items: int, id_col: str, text_col: str) -> list[tuple[list[tuple[int, str]], Statistics | None]]:
    """The items in lists of about ``shard_items``, dealt by a hash of id and text, each in a fixed
    order, with the statistics of all items for the list's terms (None if one list holds all)."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    shards = max(1, -(-rows.count() // shard_items))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    lists: list[list[tuple[int, str]]] = [[] for _ in range(shards)]
    for r in dealt.toLocalIterator():  # the table is read once
        lists[r["shard"]].append((r["item_id"], r["text"]))
    lists = [sorted(part, key=str) for part in lists]
    if shards == 1:
        return [(lists[0], None)]
    whole = statistics_of(rows)
    return [(part, Statistics(whole.n, whole.mean, whole.longest, {t: whole.df[t] for _, text in part for t in words_of(text)})) for part in lists]


def statistics_of(rows: DataFrame) -> Statistics:
    """The statistics of the items in ``text``, counted by Spark; a row per term comes back."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for (text,) in text_rows(batches, "text"):
                words = words_of(text)
                yield None, len(words)
                yield from ((t, 1) for t in set(words))

        yield from batched(out(), schema)

    counted = rows.select("text").mapInArrow(scan, "term string, n long").groupBy("term").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).collect()
    df = {r["term"]: r["items"] for r in counted}
    of_items = next(r for r in counted if r["term"] is None)
    return Statistics(of_items["items"], of_items["words"] / of_items["items"], of_items["longest"], df)
