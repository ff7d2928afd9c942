"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades 0 to K-1. One weight vector over the words that a text holds gives its
position on a line, ordered thresholds cut the line into grades:
P(grade <= k) = sigmoid(threshold[k] - position). The expected severity is the sum of
P(grade > k). Weights are shared by all thresholds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import batched, labelled_sample, text_rows

#: Texts sampled per grade for fitting, and word features kept, at most.
ROWS_PER_GRADE, FEATURES = 3000, 2000
#: A word becomes a feature if so many sampled texts hold it and its share among texts of higher grades
#: differs from its share among grade 0 by so many standard errors.
MIN_TEXTS, MIN_Z = 5, 5.0
EPOCHS, RATE, L2 = 300, 0.1, 1e-3
#: Texts of the labelled table that hold at least this many marked words are of the highest grade.
SEVERE_WORDS = 3

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending, one fewer than grades


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def select_features(texts: list[set[str]], high: np.ndarray) -> list[str]:
    """The words whose presence differs most between texts of grade above 0 and of grade 0."""
    n = {w: [0, 0] for t in texts for w in t}
    for t, h in zip(texts, high):
        for w in t:
            n[w][int(h)] += 1
    n1, n0 = max(1, int(high.sum())), max(1, int((~high).sum()))
    scored = []
    for w, (b, a) in n.items():
        if a + b >= MIN_TEXTS:
            p = (a + b) / (n1 + n0)
            z = (a / n1 - b / n0) / np.sqrt(max(1e-12, p * (1 - p) * (1 / n1 + 1 / n0)))
            if abs(z) >= MIN_Z:
                scored.append((-abs(z), w))
    return [w for _, w in sorted(scored)[:FEATURES]]


def fit(texts: list[set[str]], grades: np.ndarray, row_weights: np.ndarray, n_grades: int) -> Model:
    """Maximise the weighted cumulative-link likelihood by Adam; threshold gaps are kept positive by exp."""
    if n_grades < 2 or not len(texts):
        return Model({}, np.full(max(0, n_grades - 1), 10.0))
    words = select_features(texts, grades > 0)
    place = {w: k for k, w in enumerate(words)}
    lists = [[place[w] for w in t if w in place] for t in texts]
    col = np.array([c for x in lists for c in x], np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    g, weight = grades.astype(np.int64), row_weights / row_weights.sum()
    share = np.array([weight[g <= k].sum() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = [np.zeros(len(words)), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for epoch in range(1, EPOCHS + 1):
        w, free = params
        cuts = thresholds_of(free)
        position = np.bincount(row, w[col], len(lists)) if len(col) else np.zeros(len(lists))
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        lo, hi = sigmoid(edge[g] - position), sigmoid(edge[g + 1] - position)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_position = weight * (d_lo - d_hi)  # gradient of the log-likelihood
        d_cuts = np.zeros(n_grades + 1)
        np.add.at(d_cuts, g + 1, weight * d_hi)
        np.add.at(d_cuts, g, -weight * d_lo)
        d_cuts = d_cuts[1:-1]
        d_free = np.concatenate([[d_cuts.sum()], [d_cuts[k:].sum() * np.exp(free[k]) for k in range(1, n_grades - 1)]])
        d_w = (np.bincount(col, d_position[row], len(words)) if len(col) else np.zeros(len(words))) - L2 * w * 0.01
        for x, d, (m1, m2) in zip(params, (d_w, d_free), moments):
            m1 += 0.1 * (d - m1)
            m2 += 0.01 * (d * d - m2)
            x += RATE * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.99**epoch)) + 1e-8)
    return Model(dict(zip(words, params[0].tolist())), thresholds_of(params[1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def severity(model: Model, text: str | None) -> tuple[float, int, float]:
    """Expected severity, likeliest grade and probability of any toxicity."""
    position = sum(model.weights.get(w, 0.0) for w in sorted(words_in(text) & model.weights.keys()))
    above = 1 - sigmoid(model.thresholds - position)  # P(grade > k)
    if not len(above):
        return 0.0, 0, 0.0
    p = -np.diff(np.concatenate([[1.0], above, [0.0]]))
    return float(above.sum()), int(p.argmax()), float(above[0])


def graded_sample(docs: DataFrame, labels: DataFrame, per_grade: int = ROWS_PER_GRADE, id_col: str = "doc_id", text_col: str = "text",
                  grade_col: str = "grade") -> list[tuple[str, int, float]]:
    """(words, grade, rows it stands for) of at most ``per_grade`` documents of each grade, whole texts,
    spread over all labelled ones. Rows with a null grade or id are not learned from; a null text is
    an empty one."""
    picked, counts = labelled_sample(docs, labels, per_grade, id_col, text_col, grade_col)
    schema = pa.schema([("grade", pa.int32()), ("words", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((g, " ".join(sorted(words_in(t)))) for g, t in text_rows(batches, "grade", "text")), schema)

    found = picked.select(F.col("label").alias("grade"), "text").mapInArrow(scan, "grade int, words string").collect()
    taken = Counter(r["grade"] for r in found)
    return sorted((r["words"], r["grade"], counts[r["grade"]] / taken[r["grade"]]) for r in found)


def split_severe(sample: list[tuple[str, int, float]], severe_words: int = SEVERE_WORDS) -> list[tuple[str, int, float]]:
    """Grades 0, 1, 2 from toxic labels 0, 1: toxic texts that hold ``severe_words`` or more distinct
    words marked by the labels themselves (far likelier in toxic texts) are of grade 2."""
    sets = [set(t.split()) for t, _, _ in sample]
    high = np.array([g > 0 for _, g, _ in sample], bool)
    marked = set()
    if high.any() and not high.all():
        for w in select_features(sets, high):
            a, b = (sum(w in t for t, h in zip(sets, high) if h == side) / max(1, int((high == side).sum())) for side in (True, False))
            if a > 10 * b:
                marked.add(w)
    return [(t, 2 if g and len(s & marked) >= severe_words else int(g > 0), w) for (t, g, w), s in zip(sample, sets)]


def train(sample: list[tuple[str, int, float]]) -> Model:
    """Fit to (text, grade, weight) rows; grades are 0 to the largest one seen."""
    grades = np.array([g for _, g, _ in sample], np.int64)
    return fit([words_in(t) for t, _, _ in sample], grades, np.array([w for _, _, w in sample], float), int(grades.max()) + 1 if len(grades) else 1)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The toxicity of each text: doc_id, severity (expected grade), grade (the likeliest), p_toxic
    (probability of a grade above 0), toxic (p_toxic >= 0.5).

    Null texts are empty texts, judged by the thresholds alone. Each row is judged alone, equal texts
    alike; an empty table gives no rows. Other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for doc_id, text in text_rows(batches, "doc_id", "text"):
                s, g, p = severity(model, text)
                yield doc_id, s, g, p, p >= 0.5

        yield from batched(out(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
