"""A corpus pipeline: documents go through five stages, each written as Parquet and read again.

Low-quality texts go, one document of each group of near duplicates stays, documents that hold
benchmark items go, personal data is replaced, and the rest is mixed to the sources' target weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from judgelens.llm import decontam, mixing, near_dup, pii, quality
from judgelens.llm.queries import quality_model
from judgelens.session import ensure_checkpoint_dir, remove_folder
from judgelens.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, unchanged. Rows with equal text are judged alike."""
    model = quality_model(spark, sf_dir, docs)
    return quality.keep_accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that match no benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in text is replaced by its kind in brackets, n_chars follows."""
    return pii.redact_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document whole, with its words in the mix (size, source_size, target, taken) and the services in which
    they are taken; ``mixing.text_stream`` reads them in the order of the mix."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("mix", mix_sources),
]

#: No SQL: the classifier is learned, and the joins are by MinHash and BM25.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each writes goes to the shared checkpoint folder, and goes once the
    next stage is written."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
