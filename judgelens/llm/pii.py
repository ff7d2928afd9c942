"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits), iban
(mod 97), ssn and secret (accepted by score: their own form plus the words around them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import batched, text_rows

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
#: Score of a confirmed span before its context is read, and what a kind needs to be kept.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.4, "secret": 0.4}
MIN_SCORE = 0.6
#: Words near a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"),
    "secret": ("token", "key", "secret", "password", "apikey", "api"),
}
AGAINST = ("example", "sample", "version", "isbn")
#: Characters read to each side of a span, and what a word there adds or takes.
REACH, STEP = 40, 0.25

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# a digit run is entered at its first digit only: a match from inside it would also match from there
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# the head of an account number, and ahead of it all that could belong to it
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
_ALNUM = re.compile(r"[A-Za-z0-9]")
#: Characters of an account number by country (ISO 13616).
IBAN_LENGTHS = {code: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for code in codes.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[A-Z0-9]{20})(?![A-Za-z0-9])")
_WORD = re.compile(r"[a-z]+")
#: The local part of an address is looked for in steps of this many characters to the left.
_LOOK_BACK = 64


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around each '@': the longest local part to its left that no earlier address has
    taken, and the domain to its right. Linear in the text, however long its runs of letters are."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done:
                low = max(done, start - _LOOK_BACK)
                begin = low + _LOCAL_END.search(text[low:start]).start()
                if begin == start:
                    break
                moved, start = begin > low, begin
                if moved:
                    break
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: the length that the country fixes, for other codes the longest of 15 to 34
    characters, that ends a word and meets the checksum, whatever words and numbers follow."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        places = [i for i in range(m.start(), m.end(1)) if text[i] != " "]  # of the characters
        fixed = IBAN_LENGTHS.get(m[0][:2])
        for n in (fixed,) if fixed else range(len(places), 14, -1):
            if n <= len(places) and not _ALNUM.match(text, end := places[n - 1] + 1) and mod97(text[m.start():end].replace(" ", "")):
                yield m.start(), end
                done = end
                break


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the proposed spans that their validators confirm."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in _ibans(text):
        yield "iban", s, e
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            yield "secret", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall(text[max(0, start - REACH):start].lower())) | set(_WORD.findall(text[end:end + REACH].lower()))
    s = PRIOR[kind] + STEP * bool(near & set(CONTEXT[kind])) - STEP * bool(near & set(AGAINST))
    return min(1.0, max(0.0, s))


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """All kept spans, by kind as listed, then start. Base kinds are kept once confirmed, whatever
    their score; the other kinds from ``MIN_SCORE`` on, unless they lie within a base span."""
    found = sorted((KINDS.index(k), s, e) for k, s, e in propose(text))
    base = sorted((s, e) for k, s, e in found if k < len(BASE_KINDS))
    kept = []
    for k, s, e in found:
        p = score(text, KINDS[k], s, e)
        if k < len(BASE_KINDS) or p >= MIN_SCORE and not any(s2 <= s and e <= e2 for s2, e2 in base):
            kept.append((KINDS[k], s, e, p))
    return kept


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, of the longest one's kind."""
    out, done, longest = [], 0, 0
    for s, e, kind in sorted((s, e, k) for k, s, e, _ in spans):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
            longest = e - s
        elif e - s > longest:
            out[-1], longest = f"[{kind.upper()}]", e - s
        done = max(done, e)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pii) of each row: an array of (kind, start, end, score), offsets in code points, end
    exclusive, by kind as listed, then start.

    Each row is scanned alone, in whole; equal texts give equal spans. A null text is an empty one
    and has none. An empty table gives no rows. Other columns are not read."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("pii", pa.list_(item))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((i, spans_of(text or "")) for i, text in text_rows(batches, "doc_id", "text")), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, "doc_id long, pii array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact_texts(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the spans in ``text_col`` replaced by their kinds; ``chars_col``, if there, is set to
    the new length where the text changed. All other values, and rows without spans, stay as they are."""
    names = docs.columns
    chars = names.index(chars_col) if chars_col in names else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = names.index(text_col)
            texts = [v.as_py() for v in batch.column(k)]
            found = [spans_of(t or "") for t in texts]
            columns = list(batch.columns)
            new = [redact(t, s) if s else t for t, s in zip(texts, found)]
            columns[k] = pa.array(new, batch.schema.types[k])
            if chars is not None:
                columns[chars] = pa.array([len(t) if s else n.as_py() for t, s, n in zip(new, found, columns[chars])], batch.schema.types[chars])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def digest(spans_found: DataFrame) -> DataFrame:
    """The digest columns of ``find_pii``'s rows: counts of the base kinds, SHA-256 of the base
    spans, and all spans as kind:start:end, comma-joined."""
    text = lambda kinds: F.array_join(F.transform(
        F.filter("pii", lambda s: s["kind"].isin(*kinds)),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.col("pii.kind"), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return spans_found.select("doc_id", *counts, F.sha2(text(BASE_KINDS), 256).alias("base_sha256"), text(KINDS).alias("spans"))
