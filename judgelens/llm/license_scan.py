"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the k-gram hashes of the license
templates. A hit at word p of the document and word t of the template votes for the diagonal
p - t; an unbroken copy of a template puts all its votes on one diagonal, an inserted or dropped
word moves the rest to a neighbouring one. Votes are summed by diagonal, and diagonals at most
``max_drift`` apart form a run. From each diagonal on, as many of its run are merged as an allowed
span can hold; what they cover of the template's words is verified, and of overlapping spans the one
that covers most, then the shortest, stands. So fragments repeated around a notice don't hide it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelens.llm.common import WordHasher, batched, text_rows

#: The base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The wording of public license notices, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words in a k-gram; share of a template's words that a span must cover; words that diagonals may drift;
#: how much longer than its template a span may be.
K, MIN_COVER, MAX_DRIFT, MAX_STRETCH = 3, 0.8, 4, 1.5

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(hasher: WordHasher, text: str | None) -> np.ndarray:
    return hasher.words((text or "").encode().translate(_LOWER))


def base_places(docs: DataFrame, phrases=BASE_PHRASES) -> DataFrame:
    """Per row of (row_key, text): n_words, n_base, first_word, last_word, base (labels, an array).

    A place is a word from which on a phrase's words stand consecutively; places of several
    phrases all count. Nulls are empty texts: 0 words, 0 places, null first and last word."""
    schema = pa.schema([("row_key", pa.string()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                        ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        wanted = [(label, words_of(hasher, phrase)) for phrase, label in phrases]

        def rows():
            for key, text in text_rows(batches, "row_key", "text"):
                h, places, labels = words_of(hasher, text), [], set()
                for label, phrase in wanted:
                    n = len(h) - len(phrase) + 1
                    if n > 0:
                        at = np.flatnonzero(h[:n] == phrase[0])
                        for j in range(1, len(phrase)):
                            at = at[h[at + j] == phrase[j]]
                        if len(at):
                            places.append(at)
                            labels.add(label)
                at = np.concatenate(places) if places else None
                yield (key, len(h), 0 if at is None else len(at), None if at is None else int(at.min()),
                       None if at is None else int(at.max()), sorted(labels))

        yield from batched(rows(), schema)

    return docs.select("row_key", "text").mapInArrow(
        scan, "row_key string, n_words long, n_base long, first_word long, last_word long, base array<string>")


def rolling_hashes(docs: DataFrame, k: int = K) -> DataFrame:
    """(row_key, grams): the hashes of all runs of ``k`` words, one array element for each start."""
    schema = pa.schema([("row_key", pa.string()), ("grams", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        rows = ((key, hasher.grams(words_of(hasher, text), k).view(np.int64)) for key, text in text_rows(batches, "row_key", "text"))
        yield from batched(rows, schema)

    return docs.select("row_key", "text").mapInArrow(scan, "row_key string, grams array<bigint>")


def template_positions(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(gram, template, label, t, template_words) for each k-gram of each template: its size is the
    templates' words. A template shorter than ``k`` words has no k-gram and finds nothing."""
    hasher, rows = WordHasher(), []
    for i, (label, text) in enumerate(templates):
        h = words_of(hasher, text)
        rows += [(int(g), i, label, t, len(h)) for t, g in enumerate(hasher.grams(h, k).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, label string, t int, template_words int")


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = K, min_cover: float = MIN_COVER,
                  max_drift: int = MAX_DRIFT, max_stretch: float = MAX_STRETCH) -> DataFrame:
    """Verified license spans of (row_key, text): row_key, label, template, start_word, end_word
    (exclusive), cover (share of the template's words found in the span)."""
    places = template_positions(docs.sparkSession, templates, k)
    hits = (rolling_hashes(docs, k).select("row_key", F.posexplode("grams").alias("p", "gram"))
            .join(F.broadcast(places), "gram")  # one row per word of the fixed templates
            .select("row_key", "template", "label", "template_words", "p", "t", (F.col("p") - F.col("t")).alias("diagonal")))
    # equal rows share a row_key: their votes fall on the same words, and sets do not count them twice
    votes = hits.groupBy("row_key", "template", "label", "template_words", "diagonal").agg(
        F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("t").alias("ts"))  # at most the template's words
    by = Window.partitionBy("row_key", "template").orderBy("diagonal")
    runs = (votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > max_drift).cast("int"))
            .withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(by)))
    # diagonals that a span no longer than allowed can hold: words to spare over the template's length
    spare = F.col("template_words") * (max_stretch - 1) + max_drift
    reach = int(max((len(words_of(WordHasher(), text)) for _, text in templates), default=0) * (max_stretch - 1) + max_drift)
    ahead = Window.partitionBy("row_key", "template", "run").orderBy("diagonal").rangeBetween(0, reach)
    merged = runs.withColumn("held", F.collect_list(F.struct("diagonal", "first", "last", "ts")).over(ahead)).withColumn(
        "held", F.filter("held", lambda v: v["diagonal"] - F.col("diagonal") <= spare))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten("held.ts"), lambda t: F.sequence(t, t + k - 1)))))
    verified = merged.select("row_key", "label", "template", F.array_min("held.first").alias("start_word"), (F.array_max("held.last") + k).alias("end_word"),
                             (covered / F.col("template_words")).alias("cover")).filter(F.col("cover") >= min_cover)
    return best_spans(verified)


def best_spans(spans: DataFrame) -> DataFrame:
    """Of the overlapping spans of a text and template, the one of largest cover, then shortest, then first."""
    names = ["row_key", "label", "template", "start_word", "end_word", "cover"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held = None
            for row in text_rows(batches, *names):
                if held and row[0] == held[0] and row[2] == held[2] and row[3] < held[4]:
                    held = min(held, row, key=lambda r: (-r[5], r[4] - r[3], r[3]))
                else:
                    if held:
                        yield held
                    held = row
            if held:
                yield held

        yield from batched(rows(), pa.schema([("row_key", pa.string()), ("label", pa.string()), ("template", pa.int32()),
                                              ("start_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))

    return (spans.select(*[F.col(c).cast("long") if c.endswith("_word") else F.col(c) for c in names]).repartition("row_key", "template")
            .sortWithinPartitions("row_key", "template", "start_word", "end_word")
            .mapInArrow(pick, "row_key string, label string, template int, start_word long, end_word long, cover double"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The licenses named or quoted in each document.

    Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (base and found by
    voting; both distinct, sorted, comma-joined, empty if none), score (1 for a base phrase, else the
    largest cover of a verified template span, else 0). Nulls are empty texts. Rows with equal id and
    text get equal results, rows with equal id and different texts are scanned apart. An empty table
    gives no rows. A word of any length is one word. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", "text", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
                                   F.md5(F.coalesce("text", F.lit("")))).alias("row_key"))
    found = license_spans(rows, **options).groupBy("row_key").agg(F.collect_set("label").alias("voted"), F.max("cover").alias("cover"))
    base = base_places(rows)
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("voted", F.array().cast("array<string>")))))
    id_text = F.regexp_extract("row_key", "^(.*):", 1)
    return (base.join(found, "row_key", "left")
            .select(F.when(id_text != "-", id_text).cast("long").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                    F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                    F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score")))
