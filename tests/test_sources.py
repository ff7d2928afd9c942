import json
import os

import pytest

from judgelens.sources import scored_files, synthetic

LINES = [
    '{"prompt": "p1", "response": "r1", "score": 7.5}',
    "",
    "   ",
    "{not json",
    '{"prompt": "p2", "response": "r2"}',
    '{"prompt": "p3", "score": 3}',
    '{"response": "r4", "score": "7.0"}',
    '{"prompt": "p5", "response": "r5", "score": null}',
    '{"prompt": "p6", "response": "r6", "score": "abc"}',
    '[1, 2, 3]',
    '{"prompt": "p7", "response": "r7", "score": 9}',
]


def test_jsonl_quarantine(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "data.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n")
    samples, quarantine = scored_files.load_scored(spark, path)
    s = samples.toPandas().sort_values("response")
    assert s.response.tolist() == ["r1", "r4", "r7"]
    assert s.human_score.tolist() == [7.5, 7.0, 9.0]
    assert s[s.response == "r4"].prompt.iloc[0] == ""
    q = quarantine.toPandas()
    assert sorted(q.status) == sorted(["corrupt", "corrupt", "missing_score", "missing_response",
                                       "missing_score", "bad_score"])


def test_renamed_fields(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "renamed.jsonl")
    with open(path, "w") as f:
        f.write('{"q": "a", "a": "b", "rating": 4}\n')
    s, _ = scored_files.load_scored(spark, path, prompt_field="q", response_field="a", score_field="rating")
    assert s.toPandas().human_score.tolist() == [4.0]


def _write(d, name, obj):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False)


def test_prompt_files_layouts(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "prompts")
    os.makedirs(d)
    _write(d, "new.json", {"sections": {"Criteria": "c", "Scale": "1-10", "Format": "f"},
                           "meta_sections": ["Scale", "Format"]})
    _write(d, "legacy.json", {"sections": {"B": "b", "A": "a"}, "editable_sections": ["A"]})
    _write(d, "bad.json", {"sections": {"A": "a"}})
    _write(d, "unknown.json", {"sections": {"A": "a"}, "meta_sections": ["Z"]})
    sections, quarantine = scored_files.read_prompt_files(spark, d)
    s = sections.toPandas()
    new = s[s.prompt_id.str.endswith("new.json")].sort_values("pos")
    assert new.section.tolist() == ["Criteria", "Scale", "Format"]
    assert new.is_meta.tolist() == [False, True, True]
    legacy = s[s.prompt_id.str.endswith("legacy.json")].sort_values("pos")
    assert legacy.section.tolist() == ["B", "A"] and legacy.is_meta.tolist() == [True, False]
    reasons = {os.path.basename(p): r for p, r in quarantine.select("prompt_id", "reason").collect()}
    assert reasons == {"bad.json": "no_meta_or_editable_key", "unknown.json": "unknown_meta_section"}
    docs = scored_files.prompt_documents(sections).toPandas()
    doc = json.loads(docs[docs.prompt_id.str.endswith("new.json")].json.iloc[0])
    assert list(doc["sections"]) == ["Criteria", "Scale", "Format"] and doc["meta_sections"] == ["Scale", "Format"]


def test_synthetic_generator(spark):
    g = synthetic.generate(spark, 2000).toPandas()
    share = g.quality.value_counts(normalize=True)
    assert abs(share["low"] - 0.2) < 0.04 and abs(share["medium"] - 0.5) < 0.04
    low = g[g.quality == "low"]
    assert low.score.between(1, 4).all() and low.response.str.count("Short response.").between(1, 2).all()
    high = g[g.quality == "high"]
    assert high.score.between(7, 10).all()


def test_prompt_round_trip_and_version_table(spark, tmpdir_path):
    import pandas as pd
    from judgelens.operators import prompts
    sections = spark.createDataFrame(pd.DataFrame({
        "prompt_id": ["p1"] * 3, "version": [1] * 3, "pos": [1, 2, 3], "section": ["Criteria", "Scale", "Format"],
        "content": ["评分 rules", "1-10", "Score: n"], "is_meta": [False, True, True]}))
    out = os.path.join(tmpdir_path, "prompt_out")
    scored_files.write_prompt_files(sections, out)
    back, quarantine = scored_files.read_prompt_lines(spark, out)
    b = back.toPandas().sort_values("pos")
    assert b.section.tolist() == ["Criteria", "Scale", "Format"]
    assert b.content.tolist() == ["评分 rules", "1-10", "Score: n"] and b.is_meta.tolist() == [False, True, True]
    assert quarantine.count() == 0
    rendered = prompts.render_prompt(sections).toPandas().text.iloc[0]
    assert rendered == "## Criteria\n评分 rules\n\n## Scale\n1-10\n\n## Format\nScore: n\n"
    table = os.path.join(tmpdir_path, "versions")
    v = spark.createDataFrame(pd.DataFrame({"run_id": [1, 1], "step": [5, 10], "val_loss": [0.5, 0.4]}))
    prompts.append_versions(v, table)
    prompts.append_versions(v.selectExpr("run_id", "step + 10 AS step", "val_loss"), table)
    assert sorted(r.step for r in spark.read.parquet(table).collect()) == [5, 10, 15, 20]


def test_equal_lines_keep_ids_of_their_own(spark, tmpdir_path, hot_keys):
    line = '{"prompt": "p", "response": "r", "score": 2}\n'
    ids = []
    for d, names in (("a", ["x.jsonl"]), ("b", ["y.jsonl", "z.jsonl"])):
        os.makedirs(os.path.join(tmpdir_path, d))
        for name in names:
            with open(os.path.join(tmpdir_path, d, name), "w") as f:
                f.write(line * (20 // len(names)))
        s, _ = scored_files.load_scored(spark, os.path.join(tmpdir_path, d))
        ids.append(sorted(r.sample_id for r in s.collect()))
    assert len(set(ids[0])) == 20 and ids[0] == ids[1]      # also after moving and cutting the files


def test_history_keeps_other_runs(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "history")
    h = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.9)], "run_id string, step long, val_loss double")
    scored_files.write_history(h.filter("run_id = 'a'"), path)
    scored_files.write_history(h.filter("run_id = 'b'"), path)
    scored_files.write_history(h.filter("step = 1 AND run_id = 'a'"), path)
    got = sorted((r.run_id, r.step) for r in scored_files.read_history(spark, path).collect())
    assert got == [("a", 1), ("b", 1)]


def test_prompt_versions_and_bad_lines(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "prompts")
    rows = [("p", v, i, n, f"{n}{v}", n == "S") for v in (1, 2) for i, n in ((1, "C"), (2, "S"))]
    sections = spark.createDataFrame(rows, "prompt_id string, version int, pos int, section string, content string, is_meta boolean")
    scored_files.write_prompt_files(sections, out)
    with open(os.path.join(out, "more.txt"), "w") as f:
        f.write("no json\n")
    back, bad = scored_files.read_prompt_lines(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert [(r.prompt_id, r.raw, r.reason) for r in bad.collect()] == [(None, "no json", "invalid_json")]
