"""Mixing and the Jaccard join against brute force."""

import math
import re
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from judgelens.llm import mixing, near_dup


def poured(sizes, weights, repeats=3):
    """Targets by rounds: whoever is above its limit stops there, the rest is dealt again."""
    total, full = sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left, w = total - sum(full.values()), sum(weights[i] for i in rest)
        over = {i: repeats * sizes[i] for i in rest if w and left * weights[i] / w > repeats * sizes[i]}
        if not over:
            return [full.get(i, left * weights[i] / w if w else 0) for i in range(len(sizes))]
        full |= over


def test_targets(spark):
    rng = np.random.RandomState(4)
    for _ in range(6):
        n = rng.randint(1, 12)
        sizes = [int(10 ** rng.uniform(0, 4)) for _ in range(n)]
        rows = [(None if i == n - 1 else f"s{i:02}", s) for i, s in enumerate(sizes)]
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        exp = poured(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)])
        assert np.allclose([got[s] for s, _ in rows], exp)


def test_mix_meets_its_targets(spark):
    rng = np.random.RandomState(5)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), ["a", "b", None, "c"][rng.randint(4) if i % 3 else 0]) for i in range(4000)]
    queue = mixing.fair_queue(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).cache()
    got = queue.collect()
    assert len(got) == 4000
    for source in ("a", "b", None, "c"):
        mine = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert sum(r["taken"] for r in mine) == math.floor(mine[0]["target"])
        starts = sorted((r["starts"], r["size"]) for r in mine)
        assert all(a + s == b for (a, s), (b, _) in zip(starts, starts[1:]) if s)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    stream = mixing.mix_stream(queue).collect()
    times = [r["virtual_finish"] for r in stream]
    assert times == sorted(times) and times[-1] <= 1
    # at any moment each source has had its share, within a document
    share = {r["source"]: r["target"] for r in got}
    given_, total, all_ = dict.fromkeys(share, 0), 0, sum(share.values())
    for r in stream:
        given_[r["source"]] += r["words"]
        total += r["words"]
        assert all(abs(given_[s] - total * share[s] / all_) < 120 for s in share)
    again = mixing.fair_queue(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_is_cut_in_the_order_of_all_sources(spark):
    rng = np.random.RandomState(6)
    rows = [(i, " ".join("w" * rng.randint(0, 20)), ["a", None, "c"][min(2, rng.randint(9))]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    whole = mixing.fair_queue(docs).collect()
    services = []
    for r in whole:
        for i in range(mixing.MAX_REPEATS):
            start, quota = i * r["source_size"] + r["starts"], math.floor(r["target"])
            cut = min(max(quota, start), start + r["size"])
            services += [(e / r["target"], r["source"] is None, r["source"] or "", e, e - b, r["doc_id"]) for b, e in ((start, cut), (cut, start + r["size"])) if e > b]
    everything = sum(math.floor(t) for t in {r["source"]: r["target"] for r in whole}.values())
    for budget in (None, 0, 1, 500, everything - 1, everything + 40):
        left, exp = everything if budget is None else budget, dict.fromkeys(range(300), 0)
        for *_, words, doc_id in sorted(services):
            exp[doc_id] += min(words, left)
            left -= min(words, left)
        got = mixing.fair_queue(docs, budget=budget).collect()
        assert {r["doc_id"]: r["taken"] for r in got} == exp
        assert all(r["taken"] == sum(s["words"] for s in r["services"]) for r in got)


def grams(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else {text})


def brute(texts):
    sets = [grams(t or "") for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label, n = list(range(len(texts))), [0] * len(texts)
    for i, j in links:
        n[i], n[j] = n[i] + 1, n[j] + 1
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label, n


def corpus(seed, n_base=25):
    rng = np.random.RandomState(seed)
    texts = []
    for _ in range(n_base):
        words = [f"w{x}" for x in rng.randint(0, 400, rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randint(len(copy))] = f"x{rng.randint(10**6)}"
            texts.append(" ".join(copy))
    return texts + ["", None, "...", "a", "A", texts[0], texts[0].upper()]


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 5)  # large groups are compared in several blocks
    for seed in (1, 2):
        texts = corpus(seed)
        got = sorted(near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), recall=0.99999, ).collect())
        label, n = brute(texts)
        assert [r["class_id"] for r in got] == label
        assert [r["n_links"] for r in got] == n


def test_chain_whose_ends_differ(spark):
    """Each text is linked with the next only; hubs that are compared first do not hide later links."""
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(words[15 * i:15 * i + 200]) for i in range(12)]
    got = sorted(near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    label, n = brute(texts)
    assert [r["class_id"] for r in got] == label and [r["n_links"] for r in got] == n


@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=6), st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_jaccard_matrix(left, right):
    got = near_dup.jaccard([np.array(sorted(s)) for s in left], [np.array(sorted(s)) for s in right], width=4)
    assert np.allclose(got, [[len(a & b) / len(a | b) for b in right] for a in left])


def test_bands_reach_their_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = near_dup.choose_bands(threshold, 0.999, 200)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 200


def test_links_of_large_components_equal_all_pairs(spark, monkeypatch):
    """A hub with near copies, copies farther off that reach only some of them, and chains; small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    rng = np.random.RandomState(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(40):
        ws = list(base)
        for _ in range(rng.randint(0, 4) if k < 28 else rng.randint(2, 5)):
            ws[rng.randint(120)] = f"x{rng.randint(10**6)}"
        texts += [" ".join(ws)] * (1 + k % 2)
    chain = list(base[:100]) + ["tail"]
    for k in range(14):  # each a step further from the first
        chain[k * 7] = f"c{k}"
        texts.append(" ".join(chain))
    texts += ["", "", "one word", "one word", " ".join(f"z{i}" for i in range(50))]
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = []
    for t in texts:
        ws = t.split()
        n = min(5, len(ws)) or 1
        sets.append(frozenset(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) or None)
    linked = lambda a, b: sets[a] is None and sets[b] is None or bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    exp = [sum(linked(i, j) for j in range(len(texts)) if j != i) for i in range(len(texts))]
    assert [got[i]["n_links"] for i in range(len(texts))] == exp
    sizes = {r["class_id"]: r["class_docs"] for r in got.values()}
    assert max(sizes.values()) > 40 and len({e for e in exp[:60]}) > 5  # a large component whose members differ in links


def test_near_copies_are_copied_in_proportion(spark):
    """The members of a class of near copies that a full comparison would copy for each block: none."""
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(900):
        ws = list(base)
        ws[(k * 37) % 400] = f"x{k}"
        texts.append(" ".join(ws))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = near_dup.near_duplicates(df).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 899)}
    sets = spark.createDataFrame([(str(i), [i, *range(10**6, 10**6 + 99)]) for i in range(600)], "key string, grams array<bigint>")
    placed = near_dup.near_hubs(spark.createDataFrame([("g", str(i), 1) for i in range(600)], "group string, key string, weight long"), sets, 0.8)
    assert placed.filter("near").count() == 600


def test_mix_of_one_id_and_one_source(spark):
    docs = spark.createDataFrame([(7, "a b c " * (i % 5), "s") for i in range(3000)], "doc_id long, text string, source string").repartition(6)
    queue = mixing.fair_queue(docs).collect()
    total = sum(3 * (i % 5) for i in range(3000))
    starts = sorted((r["starts"], r["size"]) for r in queue if r["size"])
    assert len(queue) == 3000 and sum(r["taken"] for r in queue) == total and starts[0][0] == 0
    assert all(a + s == b for (a, s), (b, _) in zip(starts, starts[1:]))
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string"))
    assert sum(r["taken"] for r in mixing.fair_queue(nulls).collect()) == total


def test_mixed_documents_are_whole(spark):
    rows = [(i % 40 if i % 7 else None, f"text {i} " + "w " * (i % 9), ["a", "b", None][i % 3], i) for i in range(300)] + [(None, None, "a", 5), (3, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").withColumn("size", F.lit("clash")).withColumn("row", F.lit("kept")).withColumn("whole", F.lit("kept"))
    mixed = mixing.mixed_documents(docs.repartition(3))
    got = mixed.collect()
    assert sorted((r["doc_id"], r["text"], r["source"], r["extra"]) for r in got if r["doc_id"] is not None and r["text"] and r["source"]) == sorted(
        x for x in rows if x[0] is not None and x[1] and x[2])
    assert len(got) == 302 and all(r["size"] == len((r["text"] or "").split()) and r["row"] == "kept" and r["whole"] == "kept" for r in got)
    queue = mixing.fair_queue(docs).collect()
    assert sum(r["taken"] for r in got) == sum(r["taken"] for r in queue)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), r["size"]) for r in queue)
    stream = mixing.text_stream(mixed).collect()
    times = [r["virtual_finish"] for r in stream]
    assert times == sorted(times) and sum(r["words"] for r in stream) == sum(r["taken"] for r in got)
    assert all(r["words"] <= len(r["text"].split()) for r in stream)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.text_stream(mixed.limit(0)).count() == 0
