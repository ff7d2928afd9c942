"""Scoring in bulk with a scorer that may fail: a failing call is a row with a reason, not the end of the job.

A scorer that calls out (a model server, a library that raises) gets one row at a time, several at
once within a task, and each call is repeated a stated number of times. Every input row comes back
once, in its partition's order, with its score or with what went wrong last.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Longest reason kept (characters).
REASON_CHARS = 500


def score_rows(df: DataFrame, scorer: Callable[..., float | None], inputs: list[str], attempts: int = 3, in_flight: int = 8,
               out: str = "judge_score", rows_per_batch: int = 1000) -> DataFrame:
    """``df`` with ``out``, ``status``, ``reason`` and ``n_attempts`` for each row.

    ``scorer(*values of inputs, attempt=n)`` returns a number; ``attempt`` counts from 1, so a scorer can
    back off or change its seed. Status is ``ok``; ``failed`` when all ``attempts`` calls raised (reason: type
    and text of the last error); or ``no_score`` when a call returned nothing that is a finite number, which is not
    repeated. A task holds ``in_flight`` calls and the rows between the oldest unfinished call and the
    newest one; rows leave in the order in which they came. Threads suit calls that wait; they don't
    speed up Python work. A lost executor's rows are scored again, so a scorer should be safe to call twice.
    """
    if attempts < 1 or in_flight < 1:
        raise ValueError("attempts and in_flight must be positive")
    added = [T.StructField(out, T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
             T.StructField("n_attempts", T.LongType())]
    taken = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in taken]
    schema = T.StructType(kept + added)
    arrow, n_kept = to_arrow_schema(schema), len(kept)

    def call(values: tuple) -> tuple:
        error = None
        for n in range(1, attempts + 1):
            try:
                score = scorer(*values, attempt=n)
            except Exception as e:  # noqa: BLE001  whatever a scorer raises is the row's reason
                error = f"{type(e).__name__}: {e}"[:REASON_CHARS]
                continue
            try:
                score = float(score)
            except (TypeError, ValueError):
                score = float("nan")
            if score - score != 0:  # NaN or infinite
                return None, "no_score", None, n
            return score, "ok", None, n
        return None, "failed", error, attempts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            waiting: deque = deque()
            with ThreadPoolExecutor(in_flight) as pool:
                for batch in batches:
                    names = batch.schema.names
                    rest = batch.select([f.name for f in kept])
                    columns = [batch.column(names.index(c)) for c in inputs]
                    for i in range(batch.num_rows):
                        waiting.append((rest.slice(i, 1), pool.submit(call, tuple(c[i].as_py() for c in columns))))
                        if len(waiting) >= 4 * in_flight:
                            row, done = waiting.popleft()
                            yield row, done.result()
                while waiting:
                    row, done = waiting.popleft()
                    yield row, done.result()

        def packed(held: list[tuple]) -> pa.RecordBatch:
            left = pa.Table.from_batches([r for r, _ in held]).combine_chunks().to_batches()[0].columns if kept else []
            right = [pa.array(v, arrow.field(n_kept + i).type) for i, v in enumerate(zip(*[s for _, s in held]))]
            return pa.RecordBatch.from_arrays([*left, *right], names=arrow.names)

        held = []
        for item in results():
            held.append(item)
            if len(held) >= rows_per_batch:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return df.mapInArrow(scan, schema)


def retry_queue(scored: DataFrame, ids: list[str]) -> DataFrame:
    """The rows whose calls failed, without what scoring added: the input of a later attempt."""
    return scored.filter("status = 'failed'").select(*ids)
