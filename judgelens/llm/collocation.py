"""Phrase collocation mining: frequent phrases by Misra-Gries summaries, then exact counts.

Pass one deals the hashes of all n-grams into hash partitions, counted within each task first. A
partition keeps a Misra-Gries summary whose capacity exceeds ``SLACK`` times its mass (all occurrences
dealt to it) divided by the threshold. A summary of k counters takes away less than mass / k from
any count, so each n-gram at the threshold still has a counter, and one whose counter plus all that
was taken away is below the threshold is not frequent. Summaries of parts of a partition are merged
as they arrive: counts are added, and what is over capacity is cut off by the same rule.

Pass two counts the survivors exactly, by phrase. A bitmap of their hashes, of bounded size, keeps
other n-grams in the task that reads them; what passes it by chance is counted and then falls below
the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelens.llm.common import WordHasher, batched, cut_lineage, text_rows

#: Words of a phrase, its least count, scale of the score, share of a phrase's count that a
#: longer one must reach to replace it (in hundredths), phrases listed for a language.
MAX_WORDS, MIN_COUNT, SCALE, REPLACED, TOP = 4, 30, 2_000_000, 80, 2000
#: Capacity of a summary in multiples of mass / threshold: what may be taken away is threshold / SLACK.
SLACK = 4
#: Counters of a summary (16 bytes each): there are as many hash partitions as this bound asks for.
MAX_COUNTERS = 1 << 21
#: Bytes of text whose n-grams a task holds at a time (some forty bytes of arrays each), phrases whose counts it
#: holds (some 200 bytes each); bits of the bitmap of survivors (8 MB).
HELD_BYTES, HELD_PHRASES, BITS = 1 << 20, 1 << 20, 1 << 26
#: Bytes of text that a task of the exact count reads at most, where there are more than two tasks a core.
COMBINED_BYTES = 1 << 29

_BREAKS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_KEY_BITS = 32


class Grams:
    """The n-grams of a batch of texts in one language: hashes by number of words, and where they stand."""

    def __init__(self, hasher: WordHasher, lang: str, texts: list[bytes]):
        self.data = b"\n".join(texts).translate(_LOWER)  # a line feed parts pieces, and so texts
        self.words, self.starts, self.ends = hasher.spans(self.data)
        breaks = np.flatnonzero(hasher.is_break[np.frombuffer(self.data, np.uint8)])
        self.piece = np.searchsorted(breaks, self.starts)
        self.seed = np.frombuffer(hashlib.md5(lang.encode()).digest()[:8], np.uint64)

    def of(self, n: int, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first words) of the runs of ``n`` words within a piece; only of those whose first and last
        ``n`` - 1 words are both runs that ``open_`` marks, if it is given."""
        if len(self.words) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        last = len(self.words) - n + 1
        alike = self.piece[:last] == self.piece[n - 1:]
        at = np.flatnonzero(alike if open_ is None else alike & open_[:last] & open_[1:last + 1])
        h = np.full(len(at), n, np.uint64) + self.seed
        for j in range(n):
            h = h * np.uint64(0xD1342543DE82EF95) + self.words[at + j]
        return WordHasher.mix(h), at

    def phrase(self, first: int, n: int) -> str:
        return b" ".join([self.data[self.starts[j]:self.ends[j]] for j in range(first, first + n)]).decode()


def gram_hasher() -> WordHasher:
    separators = set(_BREAKS + _BLANKS)
    hasher = WordHasher(word_bytes=bytes(b for b in range(256) if b not in separators))
    hasher.is_break = np.isin(np.arange(256), list(_BREAKS))
    return hasher


def held_texts(batches: Iterator[pa.RecordBatch], hasher: WordHasher, held_bytes: int | None = None) -> Iterator[list[tuple[str, Grams]]]:
    """The languages and n-grams of the texts read, whenever they reach ``held_bytes``. Texts stay whole."""
    held, size = {}, 0
    for lang, text in text_rows(batches, "lang", "text"):
        data = text.encode()
        held.setdefault(lang, []).append(data)
        size += len(data) + 1
        if size >= (held_bytes or HELD_BYTES):
            yield [(name, Grams(hasher, name, texts)) for name, texts in held.items()]
            held, size = {}, 0
    if held:
        yield [(name, Grams(hasher, name, texts)) for name, texts in held.items()]


def summarise(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries cut of (keys, counts) with repeated keys: keys are unique and sorted, at most ``capacity``
    counters are above 0, and the last value is what has been taken from each count."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])  # the largest that gets no counter
    stay = counts > taken
    return keys[stay], counts[stay] - taken, taken


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys and their counts as compressed bytes: gaps and counts, equal places of their bytes together."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0))
    planes = np.concatenate([gaps, counts.astype(np.uint32)]).view(np.uint8).reshape(2, len(keys), 4).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` keys and counts of ``packed``."""
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 4, n)
    gaps, counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32).reshape(2, n)
    return np.cumsum(gaps, dtype=np.uint32), counts.astype(np.int64)


def survivors(docs: DataFrame, n_parts: int, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, slack: int = SLACK) -> DataFrame:
    """(key): the first log2(n_parts) + 32 bits of the hash of every n-gram that may occur ``min_count`` times,
    for (lang, text) rows. The first log2(n_parts) of them are the hash partition."""
    bits = n_parts.bit_length() - 1
    part = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("mass", pa.int64()), ("size", pa.int32()), ("data", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            hasher = gram_hasher()
            for held in held_texts(batches, hasher):
                hashes = np.concatenate([grams.of(k)[0] for _, grams in held for k in range(1, max_words + 1)])
                key, n = np.unique(hashes >> np.uint64(64 - bits - _KEY_BITS), return_counts=True)
                ends = np.searchsorted(key, np.arange(1, n_parts + 1, dtype=np.uint64) << np.uint64(_KEY_BITS))
                low = key.astype(np.uint32)
                start = 0
                for p, end in enumerate(ends.tolist()):
                    if end > start:
                        mass = int(n[start:end].sum())
                        yield p, 0, mass, 0, None  # sorted ahead: a summary knows its mass before it begins
                        yield p, 1, mass, end - start, packed(low[start:end], n[start:end])
                    start = end

        yield from batched(rows(), part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, state = None, None

            def cut(capacity):
                nonlocal state
                keys, counts, taken, more, _ = state
                keys, counts, t = summarise(np.concatenate([keys, *more[::2]]), np.concatenate([counts, *more[1::2]]), capacity)
                state = [keys, counts, taken + t, [], 0]

            def kept():
                cut(capacity)
                frequent = state[0][state[1] + state[2] >= min_count]
                if len(frequent):
                    yield (frequent.astype(np.int64) + (now << _KEY_BITS)).tolist(),

            mass = 0
            for p, kind, m, size, data in text_rows(batches, "part", "kind", "mass", "size", "data"):
                if p != now:
                    if now is not None:
                        yield from kept()
                    now, mass, capacity = p, 0, 0
                    state = [np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, [], 0]
                if kind == 0:
                    mass += m
                    capacity = slack * mass // min_count + 1
                    continue
                state[3] += unpacked(data, size)
                state[4] += size
                if state[4] > max(capacity, 1 << 16):
                    cut(capacity)
            if now is not None:
                yield from kept()

        yield from batched(rows(), pa.schema([("keys", pa.list_(pa.int64()))]))

    dealt = docs.select("lang", "text").mapInArrow(count, "part int, kind byte, mass long, size int, data binary")
    return (dealt.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(merge, "keys array<bigint>")
            .select(F.explode("keys").alias("key")))


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """``bits`` bits, those at the keys' own places (key modulo ``bits``) set: merged by Spark in slices, bounded by its size."""
    slices = keys.select((F.pmod("key", F.lit(bits)) + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("slice")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in slices.toLocalIterator():  # of 4096 bytes; Spark counts slices and places from 1, the lowest bit of a byte comes first
        out[(r["slice"] - 1) * 4096:r["slice"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def count_phrases(docs: DataFrame, marked: np.ndarray, n_parts: int, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, words, phrase, count) for (lang, text) rows: exact counts of the n-grams whose hash is marked, and
    with 0 words and a null phrase all words of the language."""
    shift = np.uint64(64 - (n_parts.bit_length() - 1) - _KEY_BITS)
    sent, mask = docs.sparkSession.sparkContext.broadcast(marked), np.uint64(len(marked) * 8 - 1)
    out = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("count", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            hasher, flags, held = gram_hasher(), sent.value, {}
            for lang, grams in (x for texts in held_texts(batches, hasher) for x in texts):
                own = held.setdefault((lang, 0), {})
                own[None] = own.get(None, 0) + len(grams.words)
                open_ = None
                for n in range(1, max_words + 1):
                    h, at = grams.of(n, open_)  # a frequent run begins and ends with frequent shorter ones
                    bit = h >> shift & mask
                    hit = (flags[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    h, at = h[hit], at[hit]
                    open_ = np.zeros(len(grams.words) + 1, bool)
                    open_[at] = True
                    _, first, many = np.unique(h, return_index=True, return_counts=True)
                    own = held.setdefault((lang, n), {})
                    for i, c in zip(at[first].tolist(), many.tolist()):
                        phrase = grams.phrase(i, n)
                        own[phrase] = own.get(phrase, 0) + c
                if sum(map(len, held.values())) >= HELD_PHRASES:
                    yield from ((*key, phrase, c) for key, own in held.items() for phrase, c in own.items())
                    held.clear()
            yield from ((*key, phrase, c) for key, own in held.items() for phrase, c in own.items())

        yield from batched(rows(), out, max_rows=10_000)

    return (docs.select("lang", "text").mapInArrow(count, "lang string, words int, phrase string, count long")
            .groupBy("lang", "words", "phrase").agg(F.sum("count").alias("count")))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, slack: int = SLACK,
                     max_counters: int = MAX_COUNTERS, bits: int = BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, count): every phrase of 1 to ``max_words`` words that occurs ``min_count`` times or more in its
    language, with its exact count, and for each language a row of 0 words with the count of all its words.

    Texts are lower-cased in A-Z, split at .,;:!? and line ends into pieces, and those at spaces and tabs
    into words. A null language is ``und``, a null text an empty one; an empty text has no words. Words of
    any length are whole. Repeated rows count each time. An empty table gives no rows. Other columns are not read."""
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    mass = max_words * (size // 2 + 1)  # a word has a byte, and so has what follows it
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slack * mass // (min_count * max_counters))
    n_parts = 1 << max(0, parts - 1).bit_length()
    marked = bitmap(survivors(docs, n_parts, max_words, min_count, slack), bits)
    # most tasks hold most frequent phrases: fewer, longer tasks add up more before they hand on
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // COMBINED_BYTES))
    return count_phrases(docs.coalesce(tasks), marked, n_parts, max_words).filter((F.col("count") >= min_count) | (F.col("words") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words or more: the lowest score over all cuts,
    the first such cut. ``counts`` are ``frequent_phrases``; parts of a frequent phrase are frequent too."""
    parts = F.split("phrase", " ")
    phrases = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("count").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ").alias("tail"))
    of = counts.filter("words between 1 and 3").select("lang", "phrase", "count")
    heads, tails = (of.select("lang", F.col("phrase").alias(c), F.col("count").alias(n)) for c, n in (("head", "l"), ("tail", "r")))
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).groupBy("lang", "phrase", "words", "a").agg(best.alias("cut"))
            .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"))


def not_replaced(phrases: DataFrame, replaced: int = REPLACED) -> DataFrame:
    """``phrases`` without those inside a longer one that occurs at least ``replaced`` hundredths as often."""
    parts = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))))
    longest = (phrases.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    d = "cast({} as decimal(20,0)) * {}"
    return phrases.join(longest, ["lang", "phrase"], "left").filter(
        F.expr(f"longer is null or {d.format('longer', 100)} < {d.format('a', replaced)}")).drop("longer")


def top_phrases(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The ``top`` collocations of each language by score, count, phrase (as bytes): lang, rank, phrase, a, l, r, n, score."""
    counts = cut_lineage(frequent_phrases(docs, **options))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    listed = not_replaced(scored(counts)).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    words = counts.filter("words = 0").select("lang", F.col("count").alias("n"))
    return listed.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
