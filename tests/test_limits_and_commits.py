"""Limits of an update, one-pass split, sketches, rollup ranks, failing scorers, version commits."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from judgelens.operators import bulk_scoring, edit_limits, metrics, prompts, ranking, sampling, sketches

WORDS = ["can", "Should", "MUST", "always", "scan", "mustard", "must-have", "reward", "não", "_must", "émust"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def versions(seed=3):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))])
    old = {(p, f"s{k}"): text() for p in range(60) for k in range(3) if rng.random() < 0.8}
    new = {key: (old[key] if key in old and rng.random() < 0.4 else text()) for key in {(p, f"s{k}") for p in range(60) for k in range(4)} if rng.random() < 0.8}
    return old, new


def frames(spark, old, new):
    schema = "prompt_id int, section string, content string"
    return [spark.createDataFrame([(*k, v) for k, v in x.items()], schema) for x in (old, new)]


def statuses(old, new):
    return {k: "added" if k not in old else "removed" if k not in new else "changed" if old[k] != new[k] else "unchanged" for k in {*old, *new}}


def test_sections_without_content_stand(spark):
    old, new = versions()
    got = {(r.prompt_id, r.section): r.status for r in prompts.section_diff(*frames(spark, old, new)).collect()}
    assert got == statuses(old, new) and (set(got.values()) == {"added", "removed", "changed", "unchanged"})
    sections = spark.createDataFrame([(1, 1, 1, "A", None), (1, 1, 2, "B", "b")], "prompt_id int, version int, pos int, section string, content string")
    row = prompts.render_prompt(sections).first()
    assert row.text == "## A\n\n\n## B\nb\n" and row.n_sections == 2


def test_edit_audit_equals_full_distances(spark):
    old, new = versions()
    rates = {p: (p % 11) / 10 for p in range(60) if p % 7}
    got = {(r.prompt_id, r.section): r for r in edit_limits.edit_audit(
        *frames(spark, old, new), spark.createDataFrame(list(rates.items()), "prompt_id int, learning_rate double"), initial_lr=0.8, max_chars=40).collect()}
    touched = {k: s for k, s in statuses(old, new).items() if s != "unchanged"}
    assert {k: r.status for k, r in got.items()} == touched
    for (p, s), r in got.items():
        limit = int(40.0 * min(1.0, rates.get(p, 0.0) / 0.8))
        d = distance(old.get((p, s)) or "", new.get((p, s)) or "")
        place = sorted(k for k in touched if k[0] == p).index((p, s)) + 1
        assert (r.char_limit, r.chars_changed, r.section_no) == (limit, d if d <= limit else None, place)
        assert r.verdict == ("too_many_sections" if place > 1 else "too_long" if d > limit else "ok")
    with pytest.raises(ValueError):
        edit_limits.char_limit(F.lit(1.0), 0.0, 10)


@pytest.mark.parametrize("built_in", [0, 2048])
def test_bounded_distance_equals_the_full_one(spark, monkeypatch, built_in):
    monkeypatch.setattr(edit_limits, "BUILT_IN_CHARS", built_in)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abé\U0001F600") for _ in range(n))
    rows = [("", ""), ("", "abc"), ("abc", ""), ("aaaa", "aaa"), ("abab", "baba")]
    for _ in range(200):
        a = text(rng.randint(0, 30))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            i = rng.randint(0, len(b))
            b[i:i + rng.randint(0, 1)] = text(rng.randint(0, 1))
        rows.append((a, "".join(b) if rng.random() < 0.8 else text(rng.randint(0, 30))))
    df = spark.createDataFrame(rows, "a string, b string")
    for limit in (0, 1, 5, 12):
        got = edit_limits.with_distance(df, "a", "b", limit, "d").collect()
        for r in got:
            d = distance(r.a, r.b)
            assert r.d == (d if d <= limit else -1), (r.a, r.b, limit)


def test_long_texts_stop_at_the_limit(spark):
    a = "x" * 150_000
    b = "".join(random.Random(1).choice("abcdef ") for _ in range(20_000))
    old = {(1, "a"): a, (2, "a"): a, (3, "a"): f"0{b}0"}
    new = {(1, "a"): a[:-3], (2, "a"): "y" * 150_000, (3, "a"): f"1{b[:9000]}{b[9007:]}1"}
    rates = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "prompt_id int, learning_rate double")
    got = {r.prompt_id: r for r in edit_limits.edit_audit(*frames(spark, old, new), rates, max_chars=100).collect()}
    assert got[1].chars_changed == 3 and got[2].chars_changed is None and got[2].verdict == "too_long"
    assert got[3].chars_changed == 9


def test_modal_strength_counts_whole_words(spark):
    old, new = versions(5)
    old[(99, "s0")], new[(99, "s0")] = "You can, and should.", "You must! ALWAYS."
    got = {(r.prompt_id, r.section): r for r in edit_limits.modal_strength(*frames(spark, old, new)).collect()}

    def counts(text):
        words = re.findall(r"\w+", (text or "").lower())
        return [words.count(w) for w in ("can", "should", "must", "always")]

    assert len(got) == sum(s != "unchanged" for s in statuses(old, new).values()) and any(r.soft_to_hard for r in got.values())
    for k, r in got.items():
        o, n = counts(old.get(k)), counts(new.get(k))
        weigh = lambda c: sum((i + 1) * x for i, x in enumerate(c))
        assert (r.old_strength, r.new_strength, r.rise) == (weigh(o), weigh(n), weigh(n) - weigh(o))
        assert (r.old_level, r.new_level) == tuple(max((i + 1 for i, x in enumerate(c) if x), default=0) for c in (o, n))
        assert r.soft_to_hard == (sum(n[:2]) < sum(o[:2]) and sum(n[2:]) > sum(o[2:]))


def test_hash_split_is_the_same_in_a_stream(spark, tmpdir_path):
    ids = spark.range(5000).withColumnRenamed("id", "sample_id").withColumn("sample_id", F.when(F.col("sample_id") != 7, F.col("sample_id")))
    batch = sampling.hash_split(ids, val_fraction=0.3)
    ids.repartition(4).write.parquet(f"{tmpdir_path}/ids")
    stream = sampling.hash_split(spark.readStream.schema(ids.schema).parquet(f"{tmpdir_path}/ids"), val_fraction=0.3)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmpdir_path}/c").option("path", f"{tmpdir_path}/o").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(f"{tmpdir_path}/o")
    assert back.count() == 5000 and back.exceptAll(batch).count() == 0
    n = batch.filter("split = 'val'").count()
    assert abs(n - 1500) < 5 * (5000 * 0.3 * 0.7) ** 0.5
    few = sampling.hash_split(ids.filter("sample_id < 100"), val_fraction=0.3)
    assert few.exceptAll(batch).count() == 0                    # other rows change nothing
    wider = {r.sample_id for r in sampling.hash_split(ids, val_fraction=0.5).filter("split = 'val'").collect()}
    assert {r.sample_id for r in batch.filter("split = 'val'").collect()} <= wider
    assert sampling.hash_split(ids, val_fraction=0.0).filter("split = 'val'").isEmpty()
    plan = batch._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_merged_sketches_meet_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 37).alias("part"), (F.col("id") % 2).alias("g"),
                                    F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 51 == 0, float("nan")).otherwise(F.pow(F.rand(3), 3)).alias("human_score"))
    parts = sketches.score_sketches(df, ["part", "g"], k=200)
    for keys in (["g"], []):
        thresholds = sketches.sketch_thresholds(sketches.merge_sketches(parts, keys, k=200), keys)
        errors = sketches.rank_errors(df, thresholds, keys).collect()
        assert len(errors) == (2 if keys else 1)
        assert all(max(r.low_error, r.high_error) <= sketches.rank_error_bound(200) for r in errors)
        assert sum(r.n for r in errors) == df.filter("human_score is not null and not isnan(human_score)").count()
    exact = spark.createDataFrame([(float(i),) for i in range(1, 101)], "human_score double")
    t = sketches.sketch_thresholds(sketches.merge_sketches(sketches.score_sketches(exact, []), []), [])
    strata = sketches.sketch_strata(exact, t, []).groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in strata} == {"low": 25, "mid": 49, "high": 26}


def test_rollup_ranks_equal_separate_runs(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([1.0, 2.0, 3.5, None]), round(rng.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "source string, lang string, human_score double, judge_score double")
    got = {(r.source, r.lang, r.grouping_level): r.asDict() for r in ranking.rank_statistics_rollup(df, ["source", "lang"]).collect()}
    n = 0
    for keys, level in ((["source", "lang"], 0), (["source"], 1), ([], 3)):
        for r in ranking.rank_statistics(df, keys).collect():
            mine = got[(r.asDict().get("source"), r.asDict().get("lang"), level)]
            assert all(mine[c] == pytest.approx(v) for c, v in r.asDict().items())
            n += 1
    assert n == len(got)


def test_contraction_is_paid_for(spark):
    rows = [("flat", h, 5.0) for h in (1.0, 5.0, 9.0)] + [("wide", h, h) for h in (1.0, 5.0, 9.0)] + [("same", 5.0, j) for j in (1.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, human_score double, judge_score double")
    got = {r.g: r for r in metrics.contraction_loss(df, ["g"], gamma=2.0).collect()}
    plain = {r.g: r.total_loss for r in metrics.composite_loss(df, ["g"]).collect()}
    assert {g: r.contraction for g, r in got.items()} == {"flat": 1.0, "wide": 0.0, "same": 0.0}
    assert all(r.total_loss == pytest.approx(plain[g] + 2.0 * r.contraction) for g, r in got.items())


def test_failing_calls_are_rows(spark):
    def scorer(text, attempt):
        if text is None or text == "down":
            raise ConnectionError("no route " + "x" * 1000)
        if text == "shaky" and attempt < 3:
            raise TimeoutError("later")
        return {"nan": float("nan"), "none": None, "words": "seven"}.get(text, len(text))

    texts = ["ok", "down", "shaky", None, "nan", "none", "words", ""] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id int, text string").withColumn("status", F.lit("clash")).coalesce(1)
    got = bulk_scoring.score_rows(df, scorer, ["text"], attempts=3, in_flight=4, rows_per_batch=7).collect()
    assert [r.sample_id for r in got] == list(range(240))       # order and count kept
    kinds = {t: (r.status, r.judge_score, r.n_attempts, (r.reason or "")[:24]) for t, r in zip(texts, got)}
    assert kinds == {"ok": ("ok", 2.0, 1, ""), "down": ("failed", None, 3, "ConnectionError: no rout"), "shaky": ("ok", 5.0, 3, ""), None: ("failed", None, 3, "ConnectionError: no rout"),
                     "nan": ("no_score", None, 1, ""), "none": ("no_score", None, 1, ""), "words": ("no_score", None, 1, ""), "": ("ok", 0.0, 1, "")}
    assert max(len(r.reason or "") for r in got) == bulk_scoring.REASON_CHARS
    scored = spark.createDataFrame(got)
    assert bulk_scoring.retry_queue(scored, ["sample_id", "text"]).count() == 60
    assert bulk_scoring.score_rows(df.limit(0), scorer, ["text"]).count() == 0


def test_a_repeated_commit_changes_nothing(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "versions")
    rows = spark.range(300).select(F.col("id").alias("run_id"), F.lit(1).alias("step"), (F.col("id") / 10).alias("val_loss"))
    assert prompts.append_versions(rows, path, "run-a", buckets=8) == 300
    assert prompts.append_versions(rows, path, "run-a", buckets=8) == 0
    assert prompts.append_versions(rows.withColumn("step", F.lit(2)), path, "run-b", buckets=8) == 300
    back = prompts.read_versions(spark, path)
    assert back.columns == rows.columns and sorted((r.run_id, r.step) for r in back.collect()) == sorted((i, s) for i in range(300) for s in (1, 2))
    assert len([f for f in os.listdir(path) if f.startswith("run_bucket=")]) == 8
    # two writers of one key that did not see each other
    spark.read.parquet(path).filter("commit_key = 'run-b'").withColumn("committed_in", F.lit("zzz")).write.mode("append").partitionBy("run_bucket").parquet(path)
    assert spark.read.parquet(path).count() == 900 and prompts.read_versions(spark, path).count() == 600
    prompts.compact_versions(spark, path, path + "-compact", buckets=4)
    files = [f for _, _, names in os.walk(path + "-compact") for f in names if f.endswith(".parquet")]
    assert len(files) == 4 and prompts.read_versions(spark, path + "-compact").exceptAll(back).count() == 0
    assert prompts.append_versions(rows, path + "-compact", "run-a") == 0
