import pandas as pd
import pytest
from pyspark.sql import functions as F

from judgelens.functions.exprs import extract_score
from judgelens.operators import audit, prompts


def test_extract_score_cases(spark):
    cases = [("Score: 8.5", 8.5, False), ("score:7", 7.0, False), ("分数：8.5", 8.5, False),
             ("評分 6", 6.0, False), ("Rating: 4", 4.0, False), ("text\n9\nmore", 9.0, False),
             ("I give .5", 0.5, False), ("minus -3", 3.0, False), ("nothing", 5.0, True),
             ("Score:　 7.5", 7.5, False), ("a 12 and Score 3", 3.0, False)]
    df = spark.createDataFrame(pd.DataFrame({"reply": [c[0] for c in cases]}))
    s, fb = extract_score(F.col("reply"))
    got = df.select(s.alias("s"), fb.alias("fb")).toPandas()
    assert got.s.tolist() == [c[1] for c in cases]
    assert got.fb.tolist() == [c[2] for c in cases]


def test_clean_section_text(spark):
    cases = [("edit", "  new rules \n", "new rules"), ("edit", "NO_MODIFICATION", None), ("edit", "   ", None),
             ("edit", "intro\n```text\n  body line  \n```\nafter", "body line"), ("remove", "x", None),
             ("skip", "x", None), ("add", "```\n\n```", None)]
    df = spark.createDataFrame(pd.DataFrame({"a": [c[0] for c in cases], "c": [c[1] for c in cases]}))
    got = df.select(audit.clean_section_text(F.col("a"), F.col("c")).alias("n")).toPandas().n.tolist()
    assert [None if pd.isna(x) else x for x in got] == [c[2] for c in cases]


def test_json_span_rules(spark):
    cases = [('```json\n{"modifications": []}\n```', '{"modifications": []}'), ('text {"a": {"b": 1}} tail', '{"a": {"b": 1}}'), ("[1, [2]] then {x}", "{x}"),
             ("no json", "no json"), ("a { b [1, [2]] c", "[1, [2]]"), ("} [ {", "} [ {"), ("", ""), (None, None), ("{}{}", "{}"), ("[ ] {", "[ ]")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, reply string")
    got = df.select("i", audit.json_span(audit.without_fence(F.col("reply"))).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [c[1] for c in cases]


def test_bad_elements_leave_the_others(spark):
    df = spark.createDataFrame([(1, '{"modifications": ["oops", {"action": "add", "section_name": "A"}, 3, null, {"action": {"x": [1]}}]}')], "prompt_id int, reply string")
    mods, bad = audit.parse_gradient_replies(df)
    assert [(r["seq"], r["action"]) for r in mods.orderBy("seq").collect()] == [(1, "add"), (4, '{"x":[1]}')]
    assert bad.count() == 0


def test_parse_gradient_replies(spark):
    replies = spark.createDataFrame(pd.DataFrame({"prompt_id": [1, 2, 3], "reply": [
        'Sure: {"modifications": [{"action": "edit", "section_name": "A", "opti_direction": "x", "ok": True},]}',
        "not json at all", '{"other": 1}']}))
    mods, bad = audit.parse_gradient_replies(replies)
    m = mods.toPandas()
    assert m.prompt_id.tolist() == [1] and m.action.tolist() == ["edit"]
    assert sorted(bad.toPandas().prompt_id) == [2, 3]


def _sections(spark):
    return spark.createDataFrame(pd.DataFrame({
        "prompt_id": [1, 1, 1], "version": [1, 1, 1], "pos": [1, 2, 3], "section": ["Scale", "Criteria", "Format"],
        "content": ["s", "c", "f"], "is_meta": [True, False, False]}))


def test_apply_edits_order_semantics(spark):
    edits = spark.createDataFrame(pd.DataFrame({
        "prompt_id": [1] * 6, "seq": [1, 2, 3, 4, 5, 6],
        "action": ["edit", "add", "remove", "add", "edit", "remove"],
        "section_name": ["Criteria", "New", "Criteria", "Criteria", "Scale", "Missing"],
        "content": ["c2", "n1", None, "c3", "hack", None]}))
    out = prompts.apply_edits(_sections(spark), edits).toPandas().sort_values("pos")
    assert out.section.tolist() == ["Scale", "Format", "New", "Criteria"]
    assert out.content.tolist() == ["s", "f", "n1", "c3"]
    assert set(out.version) == {2}


def test_audit_rules(spark):
    props = spark.createDataFrame(pd.DataFrame({
        "proposal_id": [1, 2, 3, 4, 5, 6], "prompt_id": [1] * 6, "seq": [1, 2, 3, 4, 5, 6],
        "action": [None, "rename", "add", "edit", "edit", "remove"],
        "section_name": ["Criteria", "Criteria", "New", "Scale", "Criteria", "Format"],
        "opti_direction": ["d", "d", "d", "d", None, None],
        "content": ["x", "x", "x", "x", "x", None], "learning_rate": [0.9, 0.9, 0.5, 0.9, 0.9, 0.6]}))
    a = audit.audit_proposals(props, _sections(spark), initial_lr=1.0).toPandas().sort_values("proposal_id")
    assert a.stage1_reason.tolist()[:5] == ["missing_fields", "invalid_action", "lr_threshold", "meta_section",
                                            "missing_direction"]
    assert pd.isna(a.stage1_reason.iloc[5]) and bool(a.applied.iloc[5])


def test_strip_equals_python(spark):
    from judgelens.functions.exprs import STRIP_CHARS, py_strip
    texts = [None, "", " ", STRIP_CHARS, f"{STRIP_CHARS}a {STRIP_CHARS} b{STRIP_CHARS}", "\u200b x \u200b", "评 分\u3000",
             "a" + " " * 5000 + "b \x85"] + [c + "x" + c for c in STRIP_CHARS]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", py_strip(F.col("t")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == [t if t is None else t.strip() for t in texts]
