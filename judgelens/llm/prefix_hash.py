"""Document fingerprints from prefix polynomial hashes.

The prefix array H[i] = sum of (code point j + 1) * m^j for j < i, modulo a prime, answers the
equality of any two spans with one subtraction and one multiplication, and finds the longest common
extension of two positions by binary search. Two primes near 2^31 are used side by side. A
fingerprint keeps the hash of the whole text, the hashes of a fixed geometric ladder of prefixes
and suffixes, and the smallest hashes of the spans of a fixed length at all places of the text. The
likeness of two texts is read from their fingerprints alone: the longest common prefix and suffix on
the ladder, found by binary search, or what the share of common spans says that they have in common,
the larger, over the longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import batched, text_rows

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 999983)
#: Code points that are hashed at a time; the arrays of longer texts carry on from piece to piece.
PIECE = 1 << 18
#: The ladder: lengths 2^(j/4), rounded down.
LADDER = np.array(sorted({int(2 ** (j / 4)) for j in range(128)}), np.int64)
#: Bring the two hashes of a ladder step together in 32 bits.
SHORTENERS = np.array((0x3C6EF372, 0x1B873593), np.int64)
#: Code points of a span, and how many span hashes, the smallest, a fingerprint keeps.
SPAN, KEPT_SPANS = 12, 64
#: Bytes of text in a partition of the ordered pass, about.
PARTITION_BYTES = 16 << 20
#: Ranges at most: beyond, they grow instead; a range is sorted on disk and read as a stream.
MAX_PARTITIONS = 8192


class PrefixHashes:
    """Prefix arrays of a text modulo each prime, by piece; equality of spans and common extensions."""

    def __init__(self, powers: "Powers", text: str):
        self.powers, self.codes = powers, code_points(text)
        self.n = len(self.codes)
        marks = [np.zeros(2, np.int64)]  # H at each piece's start
        for low in range(0, self.n, PIECE):
            marks.append(self._carry(marks[-1], low, min(PIECE, self.n - low))[:, -1])
        self.marks, self.held = marks, (-1, None)

    def _carry(self, before: np.ndarray, low: int, length: int) -> np.ndarray:
        """(2, length + 1): the prefix array from ``low`` on."""
        terms = self.powers.scaled(self.codes[low:low + length], low)
        out = np.empty((2, length + 1), np.int64)
        out[:, 0] = 0
        np.cumsum(terms, axis=1, out=out[:, 1:])
        return (out + before[:, None]) % self.powers.primes

    def at(self, i: int) -> np.ndarray:
        """H[i] modulo each prime."""
        piece = min(i // PIECE, max(0, len(self.marks) - 2))
        if self.held[0] != piece:
            low = piece * PIECE
            self.held = (piece, self._carry(self.marks[piece], low, max(0, min(PIECE, self.n - low))))
        return self.held[1][:, i - piece * PIECE]

    def at_many(self, index: np.ndarray) -> np.ndarray:
        """(2, len(index)): H at each index, in any order; each piece is worked out once."""
        if self.n <= PIECE:
            self.at(0)
            return self.held[1][:, index]
        out, piece = np.empty((2, len(index)), np.int64), np.minimum(index // PIECE, len(self.marks) - 2)
        for k in np.unique(piece):
            self.at(int(k) * PIECE)
            out[:, piece == k] = self.held[1][:, index[piece == k] - k * PIECE]
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """H[end] - H[start]: the span's hash times m^start."""
        return (self.at(end) - self.at(start)) % self.powers.primes[:, 0]


class Powers:
    """Powers of the bases: a table for one piece, and fast exponentiation beyond."""

    def __init__(self):
        self.primes = np.array(PRIMES, np.int64)[:, None]
        self.table = self._table(BASES)
        self.inverses = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES))
        self.inverse_table = self._table(self.inverses)

    @staticmethod
    def _table(bases: tuple[int, ...]) -> np.ndarray:
        table = np.ones((2, PIECE + 1), np.int64)
        for k in range(2):  # doubling: m^(j + w) = m^j * m^w
            w = 1
            while w <= PIECE:
                n = min(w, PIECE + 1 - w)
                table[k, w:w + n] = table[k, :n] * pow(bases[k], w, PRIMES[k]) % PRIMES[k]
                w *= 2
        return table

    def inverse(self, j: np.ndarray) -> np.ndarray:
        """(2, len(j)): m^-j modulo each prime."""
        if not len(j) or int(j.max()) <= PIECE:
            return self.inverse_table[:, j]
        far = np.array([[pow(b, int(q) * PIECE, p) for q in j // PIECE] for b, p in zip(self.inverses, PRIMES)], np.int64)
        return self.inverse_table[:, j % PIECE] * far % self.primes

    def of(self, j: int) -> np.ndarray:
        return self.table[:, j] if j <= PIECE else np.array([pow(b, j, p) for b, p in zip(BASES, PRIMES)], np.int64)

    def scaled(self, codes: np.ndarray, low: int) -> np.ndarray:
        terms = (codes.astype(np.int64) + 1) * self.table[:, :len(codes)] % self.primes
        return terms if not low else terms * self.of(low)[:, None] % self.primes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def equal_spans(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether a[i:i + length] and b[j:j + length] are equal (up to a collision modulo both primes)."""
    pw, p = a.powers, a.powers.primes[:, 0]
    if i == j == 0:
        return bool((a.at(length) == b.at(length)).all())
    x, y = a.span(i, i + length), b.span(j, j + length)
    # bring both to the same power of the base
    if i < j:
        x = x * pw.of(j - i) % p
    elif j < i:
        y = y * pw.of(i - j) % p
    return bool((x == y).all())


def longest_common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """How many code points from a[i] and b[j] on are equal: binary search over span equality."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def ladder_hashes(h: PrefixHashes) -> tuple[str, str, str]:
    """Hash of the whole text, of its prefixes and of its suffixes on the ladder, as hex."""
    steps = LADDER[:int(np.searchsorted(LADDER, h.n, "right"))]
    marks = h.at_many(np.concatenate([h.n - steps[::-1], steps, [h.n]]))
    whole = marks[:, -1]
    # a suffix is brought down by the inverse of the power at its start
    back = (whole[:, None] - marks[:, :len(steps)]) % h.powers.primes * h.powers.inverse(h.n - steps[::-1]) % h.powers.primes
    short = (np.concatenate([marks[:, len(steps):-1], back[:, ::-1]], axis=1) * SHORTENERS[:, None]).sum(axis=0) & 0xFFFFFFFF
    text = short.astype(">u4").tobytes().hex()
    return f"{int(whole[0]):08x}{int(whole[1]):08x}", text[:8 * len(steps)], text[8 * len(steps):]


def span_hashes(h: PrefixHashes) -> np.ndarray:
    """The ``KEPT_SPANS`` smallest different hashes of the text's spans, modulo the first prime, ascending."""
    p, places, best = PRIMES[0], h.n - SPAN + 1, np.zeros(0, np.int64)
    for low in range(0, places, PIECE):
        n = min(PIECE, places - low)
        if h.n <= PIECE:
            h.at(0)
            marks = h.held[1][0]
            start, end = marks[:n], marks[SPAN:SPAN + n]
        else:
            at = np.arange(low, low + n)
            start, end = h.at_many(at)[0], h.at_many(at + SPAN)[0]
        # brought down by the inverse of the power at the span's start
        v = (end - start) * h.powers.inverse_table[0, :n] % p
        if low:
            v = v * pow(h.powers.inverses[0], low, p) % p
        small = np.unique(v[v < p // n * 4 * KEPT_SPANS])
        if len(small) < KEPT_SPANS:  # a short or repetitive text
            small = np.unique(v)
        best = np.union1d(best, small[:KEPT_SPANS])[:KEPT_SPANS]
    return best


def fingerprint(h: PrefixHashes) -> str:
    """length:hash of the whole:prefix ladder:suffix ladder:spans. Equal texts have equal fingerprints."""
    whole, prefixes, suffixes = ladder_hashes(h)
    return f"{h.n}:{whole}:{prefixes}:{suffixes}:{span_hashes(h).astype('>u4').tobytes().hex()}"


def common_spans(x: str, y: str) -> float:
    """The share of different spans of two texts that both have, from the smallest of both together."""
    a, b = ({s[i:i + 8] for i in range(0, len(s), 8)} for s in (x, y))
    smallest = sorted(a | b)[:KEPT_SPANS]
    return sum(s in a and s in b for s in smallest) / len(smallest) if smallest else 0.0


def likeness(x: str, y: str) -> float:
    """From two fingerprints alone: 1 if they are equal, else what the texts have in common over the
    longer length, at most the shorter over the longer; 0 if only one is empty. In common they have
    the longest common prefix and suffix on the ladder or, if larger, the length that the share of
    common spans stands for (an estimate from ``KEPT_SPANS`` spans)."""
    if x == y:
        return 1.0
    (n, _, *left, spans), (m, _, *right, others) = x.split(":"), y.split(":")
    longer, shorter = max(int(n), int(m)), min(int(n), int(m))
    found = 0
    for a, b in zip(left, right):
        low, high = 0, min(len(a), len(b)) // 8
        while low < high:  # equal up to a step means equal on all steps before
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[8 * mid - 8:8 * mid] == b[8 * mid - 8:8 * mid] else (low, mid - 1)
        found += int(LADDER[low - 1]) if low else 0
    share = common_spans(spans, others)
    found = max(found, share / (1 + share) * (longer + shorter))
    # texts that differ are never fully alike
    return min(found, shorter, longer - 1) / longer


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of ``following``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def ordered_with_heads(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(part, last, doc_id, text), partitioned by ``part`` and sorted: ranges of ascending doc_id, each
    closed by a copy (``last`` = 1) of the first row of the next range; the last by the first row of all.

    So each row finds its successor in its own partition, and texts are shuffled once. The range
    bounds come from approximate quantiles of the ids alone. Nulls come first; rows of one id are in
    one range, in the order of their texts."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n"))
    total, n = size.first()
    wanted = max(-(-int(total or 0) // partition_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, min(int(n or 0), wanted, MAX_PARTITIONS))
    bounds = [] if parts == 1 else docs.select(F.percentile_approx(
        "doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = sorted(set(bounds))
    # how many cuts lie at or below the id: the number of the partition that the row goes to
    part = F.lit(0) if not cuts else F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))), F.lit(0))
    placed = docs.select("doc_id", "text").withColumn("part", part.cast("int"))
    # one row per range, in order: no more rows than partitions
    heads = sorted(placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("h")).select("part", "h.doc_id").collect())
    where = {}
    for (p, _), (_, head) in zip(heads, [*heads[1:], *heads[:1]]):
        where.setdefault(head, []).append(p)
    rows = placed.withColumn("last", F.lit(0))
    if where:
        copies = docs.sparkSession.createDataFrame([(i, p) for i, ps in where.items() for p in ps], "_id long, part int")
        guests = docs.select("doc_id", "text").join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "part", F.lit(1).alias("last"))
        rows = rows.unionByName(guests)
    return rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its successor-edited text and their fingerprints.

    Per row: doc_id, n_chars (code points), edited_sha256 (of the edited text in UTF-8), fingerprint,
    edited_fingerprint, near_edited, near_next (likeness of the fingerprint to those of the edited
    text and of the next document), common_edited, common_next (longest common prefix in code
    points, by binary search). Null texts are empty texts; two empty texts are alike (1). The next
    document is that of the next doc_id, nulls first, rows of equal id in the order of their texts,
    the first after the last; a single row is followed by itself. An empty table gives no rows.
    Other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                        ("common_edited", pa.int64()), ("common_next", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = partial(PrefixHashes, Powers())

        def out():
            held = None  # the row before: its part, id, text, prefix arrays and fingerprint
            closed = None
            for part, last, doc_id, text in text_rows(batches, "part", "last", "doc_id", "text"):
                if part == closed:  # the head of the next range may repeat its id: the first one counts
                    continue
                text = text or ""
                h = hashes(text)
                print_ = fingerprint(h)
                if held is not None and held[0] == part:
                    _, id_, own, own_h, own_print = held
                    new = edited(own, text)
                    new_h = hashes(new)
                    new_print = fingerprint(new_h)
                    yield (id_, len(own), hashlib.sha256(new.encode()).hexdigest(), own_print, new_print, likeness(own_print, new_print),
                           likeness(own_print, print_), longest_common_extension(own_h, 0, new_h, 0), longest_common_extension(own_h, 0, h, 0))
                held, closed = ((part, doc_id, text, h, print_), closed) if not last else (None, part)

        yield from batched(out(), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ordered_with_heads(rows).mapInArrow(
        scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, common_edited long, common_next long")
