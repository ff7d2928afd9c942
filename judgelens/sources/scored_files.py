"""Scored-response files (JSON lines) and prompt files (JSON), read with quarantine.

Bad input never stops a job: unparseable lines, rows without a response or score, and
uncastable scores are kept in a quarantine table with the file, the raw text and a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import join_on
from ..operators.prefix import Running, running


def read_scored_lines(spark: SparkSession, path: str, prompt_field: str = "prompt",
                      response_field: str = "response", score_field: str = "score") -> DataFrame:
    """Raw JSON-lines read: every field as text, corrupt lines in ``_corrupt``.

    Reading the score as text first keeps ``"score": "7.0"`` (a string the reference accepts)
    instead of calling the line corrupt. Blank lines produce no row. A missing path raises.
    """
    fields = [prompt_field, response_field, score_field]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields]
                          + [T.StructField("_corrupt", T.StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    return df.select(*fields, "_corrupt", F.col("_metadata.file_path").alias("file_path"))


def parse_required_fields(raw: DataFrame, prompt_field: str = "prompt", response_field: str = "response",
                          score_field: str = "score") -> DataFrame:
    """Status per row: ok, corrupt, missing_response, missing_score or bad_score.

    ``prompt`` defaults to ''. ``score`` is the double value (NULL unless ok).
    """
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in raw.columns else F.lit(False)
    score = F.col(score_field).try_cast("double")
    status = (F.when(corrupt, "corrupt")
              .when(F.col(response_field).isNull(), "missing_response")
              .when(F.col(score_field).isNull(), "missing_score")
              .when(score.isNull(), "bad_score").otherwise("ok"))
    keep = [c for c in raw.columns if c not in (prompt_field, response_field, score_field)]
    return raw.select(*keep, F.coalesce(F.col(prompt_field), F.lit("")).alias("prompt"),
                      F.col(response_field).alias("response"),
                      F.when(status == "ok", score).alias("score"), status.alias("status"))


def load_scored(spark: SparkSession, path: str, **fields) -> tuple[DataFrame, DataFrame]:
    """(samples, quarantine) from a JSON-lines path.

    ``sample_id`` is the md5 of prompt, response and score, a dash, and the number of the copy (from
    1) among equal lines: every line has its own id, and ids do not change when files move or are
    cut differently. Copies are numbered by :func:`running`, so a line that fills a third of the
    input is spread over many tasks.
    """
    parsed = parse_required_fields(read_scored_lines(spark, path, **fields), **fields)
    content = F.md5(F.to_json(F.struct("prompt", "response", "score")))
    ok = parsed.filter(F.col("status") == "ok").select(
        content.alias("_content"), "prompt", "response", F.col("score").alias("human_score"),
        F.lit(1.0).alias("_one"), F.monotonically_increasing_id().alias("_at"))
    ok = running(ok, ["_content"], ["_at"], [Running("_copy", "sum", "_one")])
    samples = ok.select(F.concat_ws("-", "_content", F.col("_copy").cast("bigint")).alias("sample_id"),
                        "prompt", "response", "human_score")
    quarantine = parsed.filter(F.col("status") != "ok")
    return samples, quarantine


PROMPT_SCHEMA = T.StructType([
    T.StructField("sections", T.MapType(T.StringType(), T.StringType())),
    T.StructField("meta_sections", T.ArrayType(T.StringType())),
    T.StructField("editable_sections", T.ArrayType(T.StringType()))])


def read_prompt_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sections, quarantine) from a directory of prompt JSON files, one prompt per file.

    Section order is taken from the document (``json_object_keys`` keeps it); meta sections
    come from ``meta_sections``, or, in the legacy layout, are all sections not listed in
    ``editable_sections``. A file with neither key, or naming a meta section that does not
    exist, is quarantined with the reason.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("prompt_id"), F.lit(1).alias("version"), F.col("value").alias("raw"))
    return parse_prompts(files)


def parse_prompts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, quarantine) of prompt documents ``(prompt_id, version, raw)``."""
    p = files.withColumn("_obj", F.from_json("raw", PROMPT_SCHEMA)).withColumn(
        "_order", F.json_object_keys(F.get_json_object("raw", "$.sections")))
    has_meta = F.col("_obj.meta_sections").isNotNull()
    has_edit = F.col("_obj.editable_sections").isNotNull()
    names = F.coalesce(F.col("_order"), F.array().cast("array<string>"))
    meta = F.when(has_meta, F.col("_obj.meta_sections")).otherwise(
        F.array_except(names, F.coalesce(F.col("_obj.editable_sections"), F.array().cast("array<string>"))))
    unknown = F.size(F.array_except(F.coalesce(meta, F.array().cast("array<string>")), names)) > 0
    reason = (F.when(F.col("_obj").isNull() | F.col("_obj.sections").isNull(), "invalid_json")
              .when(~has_meta & ~has_edit, "no_meta_or_editable_key")
              .when(unknown, "unknown_meta_section"))
    p = p.withColumn("reason", reason).withColumn("_meta", meta)
    good = p.filter(F.col("reason").isNull())
    sections = (good.select("prompt_id", "version", "_obj", "_meta", F.posexplode("_order").alias("pos", "section"))
                .select("prompt_id", "version", (F.col("pos") + 1).cast("int").alias("pos"),
                        "section", F.col("_obj.sections")[F.col("section")].alias("content"),
                        F.array_contains("_meta", F.col("section")).alias("is_meta")))
    return sections, p.filter(F.col("reason").isNotNull()).select("prompt_id", "version", "raw", "reason")


def prompt_documents(sections: DataFrame) -> DataFrame:
    """One JSON document per prompt in the new layout (sections in order, then meta names)."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "section", "content", "is_meta")))
    g = sections.groupBy("prompt_id", "version").agg(ordered.alias("_s"))
    secs = F.map_from_entries(F.transform("_s", lambda s: F.struct(s["section"], s["content"])))
    meta = F.transform(F.filter("_s", lambda s: s["is_meta"]), lambda s: s["section"])
    return g.select("prompt_id", "version",
                    F.to_json(F.struct(secs.alias("sections"), meta.alias("meta_sections"))).alias("json"))


def write_prompt_files(sections: DataFrame, path: str) -> None:
    """Write prompts as JSON lines ``{prompt_id, version, prompt}`` (UTF-8, not ASCII-escaped), where
    ``prompt`` is the document as text: many prompts to a file, no folder per prompt."""
    line = F.to_json(F.struct("prompt_id", "version", F.col("json").alias("prompt")))
    prompt_documents(sections).select(line.alias("value")).write.mode("overwrite").text(path)


def read_prompt_lines(spark: SparkSession, path: str, id_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """(sections, quarantine) of what :func:`write_prompt_files` wrote. A line that is no such object
    is quarantined as a whole, without id."""
    schema = f"prompt_id {id_type}, version int, prompt string"
    rows = spark.read.text(path).select("value", F.from_json("value", schema).alias("_l"))
    return parse_prompts(rows.select("_l.prompt_id", "_l.version",
                                     F.coalesce("_l.prompt", "value").alias("raw")))


def write_history(history: DataFrame, path: str, run: str = "run_id", buckets: int = 64) -> None:
    """Append training history rows with the time of saving, in ``buckets`` folders by the run's hash.

    Rows of other runs, and earlier savings of the same run, stay; :func:`read_history` shows each
    run as last saved. All rows of one call carry one time.
    """
    saved = history.withColumns({"saved_at": F.current_timestamp(),
                                 "run_bucket": F.pmod(F.xxhash64(run), F.lit(buckets))})
    saved.write.mode("append").partitionBy("run_bucket").parquet(path)


def read_history(spark: SparkSession, path: str, run: str = "run_id") -> DataFrame:
    """Each run's rows as last saved."""
    rows = spark.read.parquet(path).drop("run_bucket")
    last = rows.groupBy(run).agg(F.max("saved_at").alias("saved_at"))
    return join_on(rows, last, [run, "saved_at"], "left_semi")
