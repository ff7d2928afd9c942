"""Helpers shared by the operators: sampling of labelled rows, word hashing, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelens.session import cut_lineage  # noqa: F401  (re-exported for the operators)

#: Bytes that make words once A-Z are lower-cased: digits, a-z and every byte of a non-ASCII character.
WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Texts are hashed in pieces of at most this many bytes, so memory does not follow the longest text.
PIECE_BYTES = 1 << 19


def text_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each row as Python values, one row at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def batched(rows: Iterator[tuple], schema: pa.Schema, max_rows: int = 2000, max_cells: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows; ``max_cells`` bounds the list elements or characters a batch holds."""
    held, cells = [], 0
    for row in rows:
        held.append(row)
        cells += sum(len(v) for v in row if hasattr(v, "__len__"))
        if len(held) >= max_rows or cells >= max_cells:
            yield record_batch(held, schema)
            held, cells = [], 0
    if held:
        yield record_batch(held, schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def bounded_sample(rows: DataFrame, by: str, key: str, per_class: int) -> DataFrame:
    """At most ``per_class`` values of ``key`` for each value of ``by``, spread evenly over all rows.

    Every class is dealt into ``per_class`` buckets by a hash of the key, and each bucket gives its
    row of smallest hash: a plain grouped minimum, combined before the shuffle, so a class that
    holds most rows costs no more than another. Same rows, same sample.
    """
    h = F.xxhash64(F.col(key))
    picked = (rows.select(F.col(by), F.col(key), h.alias("_h"))
              .groupBy(by, F.pmod(F.shiftright("_h", 20), F.lit(per_class)).alias("_bucket"))
              .agg(F.min(F.struct("_h", key)).alias("_least")))
    return picked.select(F.col(by), F.col(f"_least.{key}").alias(key))


class WordHasher:
    """64-bit hashes of the words of a text, from one polynomial prefix sum over its bytes.

    With H[i] the running sum of scramble(byte) * m^j modulo 2^64, a word's hash is
    (H[end] - H[start]) * m^-start, so a text costs a handful of array operations. Texts are taken
    in pieces; a word across their borders has the hash that it has within one.
    """

    MULTIPLIER = 0x9E3779B97F4A7C15

    def __init__(self, piece: int = PIECE_BYTES, word_bytes: bytes = WORD_BYTES):
        self.piece = piece
        self.is_word = np.zeros(256, bool)
        self.is_word[list(word_bytes)] = True
        seeds = np.random.RandomState(20240501).randint(1, 2**62, 256, dtype=np.int64)
        self.scramble = seeds.astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.pow = self._powers(self.MULTIPLIER, piece + 1)
        self.inv = self._powers(pow(self.MULTIPLIER, -1, 1 << 64), piece + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        a = np.full(n, base, np.uint64)
        a[0] = 1
        return np.cumprod(a, dtype=np.uint64)

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))

    def words(self, data: bytes) -> np.ndarray:
        """Hash of every word of the (already lower-cased) UTF-8 text, in order."""
        return self.spans(data)[0]

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words of the text, in order, whatever their length.

        A word that a piece does not end is carried on: its parts' sums, each moved by the bytes
        before it, add up to the sum that one piece would have had."""
        a, found, start = np.frombuffer(data, np.uint8), [], 0
        open_sum, open_start = 0, -1  # of the word that runs into the piece
        while start < len(a):
            piece = a[start:start + self.piece]
            inside = np.zeros(len(piece) + 2, np.int8)
            inside[1:-1] = self.is_word[piece]
            edges = np.flatnonzero(np.diff(inside))
            starts, ends = edges[::2], edges[1::2]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(self.scramble[piece] * self.pow[:len(piece)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.inv[starts]
            starts, ends = starts + start, ends + start
            if open_start >= 0:
                if len(starts) and starts[0] == start:
                    moved = pow(self.MULTIPLIER, start - open_start, 1 << 64)
                    h[0] = (open_sum + int(h[0]) * moved) % (1 << 64)
                    starts[0] = open_start
                else:
                    h, starts, ends = (np.concatenate([x, y]) for x, y in ((np.array([open_sum], np.uint64), h), (np.array([open_start]), starts), (np.array([start]), ends)))
                open_start = -1
            start += len(piece)
            if len(ends) and ends[-1] == start < len(a):
                open_sum, open_start = int(h[-1]), int(starts[-1])
                h, starts, ends = h[:-1], starts[:-1], ends[:-1]
            found.append((self.mix(h + (ends - starts).astype(np.uint64)), starts, ends))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of ``k`` consecutive words."""
        if len(words) < k:
            return np.zeros(0, np.uint64)
        n = len(words) - k + 1
        h = words[:n].copy()
        for j in range(1, k):
            h = h * np.uint64(0xD1342543DE82EF95) + words[j:j + n]
        return self.mix(h)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, label, text) of at most ``per_class`` documents for each label, whole, spread over all
    labelled documents, and the number of labelled documents by label.

    Only ids and labels are shuffled; the chosen ids, bounded by ``per_class``, go to the texts.
    Null ids and labels are left out; a document with several labels counts for each."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").distinct()
             .join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per label
    chosen = bounded_sample(known, "label", "id", per_class)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text"), counts
