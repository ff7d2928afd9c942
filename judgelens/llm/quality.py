"""Quality classification by naive Bayes support vectors.

A text is the set of its hashed byte n-grams (upper and lower case, punctuation and spacing count).
Each n-gram indicator is scaled by its class log-count ratio, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent. A logistic map, fitted on the margins,
turns the margin into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import batched, labelled_sample, text_rows

#: Lengths of the byte n-grams; hash buckets; texts sampled per class for fitting, at most.
GRAMS, BUCKETS, ROWS_PER_CLASS = (1, 2, 3), 1 << 15, 2000
#: Smoothing of the counts; penalty of the hinge loss; share of the learned weights against their mean size.
ALPHA, C, BETA = 1.0, 1.0, 0.9
EPOCHS = 12
#: Bytes that are hashed at a time.
PIECE = 1 << 18


@dataclass
class Model:
    scaled: np.ndarray  # (BUCKETS,) weight times log-count ratio
    square: np.ndarray  # (BUCKETS,) squared log-count ratio
    bias: float
    slope: float
    shift: float


def indicators(text: str | None) -> np.ndarray:
    """Which buckets the text's n-grams fall in; long texts are read in overlapping pieces."""
    seen = np.zeros(BUCKETS, bool)
    a = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    for low in range(0, len(a), PIECE):
        part = a[low:low + PIECE + max(GRAMS) - 1]
        for n in GRAMS:
            m = len(part) - n + 1
            if m <= 0:
                continue
            h = part[:m] + np.uint32(n * 7919)
            for j in range(1, n):
                h = h * np.uint32(0x9E3779B1) + part[j:j + m]
            h *= np.uint32(0x85EBCA6B)
            seen[h >> np.uint32(17)] = True
    return seen


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log of (share of the positive class's indicator mass) / (share of the negative class's)."""
    mass = {c: np.full(BUCKETS, ALPHA) for c in (-1, 1)}
    for idx, y, w in zip(rows, labels, weights):
        mass[int(y)][idx] += w
    return np.log((mass[1] / mass[1].sum()) / (mass[-1] / mass[-1].sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray,
                            epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM: one dual variable per row, clipped to [0, cost]."""
    w, bias, alpha, rng = np.zeros(BUCKETS), 0.0, np.zeros(len(rows)), np.random.RandomState(seed)
    diagonal = np.array([float(v @ v) + 1.0 for v in values])  # the bias is a feature that is always 1
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            y, idx, v = labels[i], rows[i], values[i]
            gradient = y * (float(w[idx] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                w[idx] += step * v
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-4:
            break
    return w, bias


def logistic_map(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by damped Newton steps."""
    a, b = 1.0, 0.0
    y = (labels > 0).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = weights * (p - y), weights * p * (1 - p) + 1e-9
        grad = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    return float(max(a, 1e-3)), float(b)


def fit(sample: list[tuple[np.ndarray, int, float]]) -> Model:
    """Fit to (indicator positions, label 0 or 1, weight) rows. The weight says how many rows of its
    class a sampled row stands for. Rows of one class alone give a model that always predicts it."""
    labels = np.array([1 if y else -1 for _, y, _ in sample], np.int64)
    if len(set(labels.tolist())) < 2:
        sure = 0.0 if not len(labels) else 10.0 * labels[0]
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(sure))
    weights = np.array([w for _, _, w in sample])
    weights = weights / weights.mean()
    rows = [r for r, _, _ in sample]
    r = log_count_ratio(rows, labels, np.ones(len(rows)))
    values = [unit(r[idx]) for idx in rows]
    cost = C * np.where(labels > 0, 0.5 * len(labels) / (labels > 0).sum(), 0.5 * len(labels) / (labels < 0).sum())
    # margins of rows that the fit has not seen: two halves judge each other
    half = np.arange(len(rows)) % 2 == 0
    margins = np.zeros(len(rows))
    for part in (half, ~half):
        pick = np.flatnonzero(part)
        w, bias = dual_coordinate_descent([rows[i] for i in pick], [values[i] for i in pick], labels[pick], cost[pick])
        w = interpolated(w)
        for i in np.flatnonzero(~part):
            margins[i] = float(w[rows[i]] @ values[i]) + bias
    slope, shift = logistic_map(margins, labels, weights)
    w, bias = dual_coordinate_descent(rows, values, labels, cost)
    w = interpolated(w)
    return Model((w * r).astype(np.float32), (r * r).astype(np.float32), bias, slope, shift)


def unit(x: np.ndarray) -> np.ndarray:
    return x / max(1e-9, float(np.sqrt(x @ x)))


def interpolated(w: np.ndarray) -> np.ndarray:
    """Between the learned weights and naive Bayes, where every ratio weighs the same."""
    return (1 - BETA) * np.abs(w).mean() + BETA * w


def margin(model: Model, text: str | None) -> float:
    seen = np.flatnonzero(indicators(text))
    norm = float(np.sqrt(model.square[seen].sum(dtype=np.float64)))
    return float(model.scaled[seen].sum(dtype=np.float64)) / norm + model.bias if norm > 0 else model.bias


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality") -> Model:
    """Fit on at most ``per_class`` documents of each label, whole texts, spread over all labelled ones.

    The tasks send the positions of the indicators; texts stay where they are. Rows with a null
    label or id are not learned from; a null text is an empty one."""
    picked, counts = labelled_sample(docs, labels, per_class, id_col, text_col, label_col)
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("seen", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((i, y, np.flatnonzero(indicators(t)).astype(np.int32)) for i, y, t in text_rows(batches, "id", "label", "text")), schema)

    sample = picked.mapInArrow(scan, "id long, label int, seen array<int>").toArrow()
    found = sorted(zip(sample["id"].to_pylist(), sample["label"].to_pylist(), range(sample.num_rows)))
    lists = sample["seen"]
    taken = Counter(y for _, y, _ in found)
    return fit([(np.asarray(lists[k].values.to_numpy(zero_copy_only=False), np.int64), y, counts[y] / taken[y]) for _, y, k in found])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The quality of each text: doc_id, score (0 to 1), predicted (1 if score >= 0.5, else 0), margin.

    Null texts are empty texts, whose margin is the bias. Each row is judged alone, equal texts
    alike; an empty table gives no rows. Other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("margin", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for doc_id, text in text_rows(batches, "doc_id", "text"):
                m = margin(model, text)
                p = float(1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -30, 30))))
                yield doc_id, p, int(p >= 0.5), m

        yield from batched(out(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, "doc_id long, score double, predicted int, margin double")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores 0.5 or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            kept = [model.slope * margin(model, texts[i].as_py()) + model.shift >= 0 for i in range(batch.num_rows)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
