"""Sharding, the prefix trie and collocations against brute force, on odd rows and with hot keys."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from judgelens.llm import collocation, prefix_trie, sharding
from judgelens.llm.queries import QUERIES
from tests.conftest import SF_SMALL


# ---- sharding

def winner(key, shards):
    draw = lambda i: -math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / shards[i]
    return min(sorted(shards), key=draw)


def test_shards_are_the_smallest_draws(spark):
    shards = {3: 1.0, 7: 2.5, 10: 0.5}
    docs = spark.range(3000).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r for r in sharding.assign(docs, shards, added={11: 1.0}).collect()}
    assert all(r["shard"] == winner(i, shards) and r["grown_shard"] == winner(i, shards | {11: 1.0}) for i, r in got.items())
    n = Counter(r["shard"] for r in got.values())
    assert all(abs(n[i] / 3000 - w / 4) < 0.04 for i, w in shards.items())
    assert {r["grown_shard"] for r in got.values() if r["grown_shard"] != r["shard"]} == {11}


def test_changes_of_shards_move_only_what_they_must(spark):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    of = lambda shards: {r["doc_id"]: r["shard"] for r in sharding.assign(docs, shards).collect()}
    before = of({i: 1.0 for i in range(6)})
    less, heavier = of({i: 1.0 for i in range(6) if i != 2}), of({i: 1.0 + (i == 4) for i in range(6)})
    assert all(less[k] == v for k, v in before.items() if v != 2) and 2 not in less.values()
    assert all(heavier[k] in (v, 4) for k, v in before.items()) and sum(heavier[k] != v for k, v in before.items()) > 100
    with pytest.raises(ValueError):
        sharding.assign(docs, {1: 0.0})


def odd_docs(spark):
    rows = [(1, "plain text"), (2, None), (3, ""), (None, "no id"), (None, "no id"), (4, "x" * 300_000), (5, "é\U0001F600"), (6, "a"), (6, "b"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows + [(8, "hot")] * 60, "doc_id long, text string")
    for c in ("shard", "size", "slot", "_row", "_one", "grown_shard", "_in", "lang", "key"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def slots_are_right(spark):
    docs = odd_docs(spark)
    got = sharding.shard_slots(docs, {i: 1.0 for i in range(3)}, {3: 1.0}).collect()
    assert len(got) == 71
    for s in range(3):
        mine = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["shard"] == s)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert texts == {(r["doc_id"], r["size"], r["text_crc32"]) for r in got}
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sharding.shard_slots(docs.limit(0), {0: 1.0}, {1: 1.0}).count() == 0


def test_slots_of_odd_rows(spark):
    slots_are_right(spark)


def test_slots_of_hot_shards(spark, hot_keys):
    slots_are_right(spark)


def test_written_shards_hold_all_rows(spark, tmpdir_path):
    docs = odd_docs(spark)
    name = sharding.write_shards(docs, f"{tmpdir_path}/s", {0: 1.0, 1: 3.0})
    back = spark.read.parquet(f"{tmpdir_path}/s")
    assert name == "_shard" and back.drop(name).select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert all(r[name] == winner("\\N" if r["doc_id"] is None else r["doc_id"], {0: 1.0, 1: 3.0}) for r in back.collect())


# ---- prefix trie

def plain_trie(rows, splice=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if splice else 0
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n and m for m in members)]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(paths[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves),
                    sum((len(members[n]) - 1) * words(n) for n in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([None, -41, -20, *range(0, 48)])
        rows.append((c, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, "user", "a"]), rng.choice([None, "", "hi there", "go on", "x"])))
    return rows + [(60 + k, t, "user", "same words here") for k in range(6) for t in range(7)] + [(80, t, "u", f"long {t % 3}") for t in range(40)]


def nodes_of(spark, rows, splice=True, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("depth", "node", "words", "place", "length", "content"):
        df = df.withColumn(c, F.lit("clash"))
    turns = prefix_trie.numbered(df.repartition(4))
    got = prefix_trie.trie(*(prefix_trie.spliced if splice else prefix_trie.whole)(turns), **options).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("splice", [True, False])
def test_trie_equals_brute_force(spark, splice):
    rows = random_rows(1)
    assert nodes_of(spark, rows, splice) == plain_trie(rows, splice)


def test_trie_with_hot_conversations(spark, hot_keys):
    rows = random_rows(2)
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_trie_if_the_sketch_proves_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "may_be_shared", lambda spark, bits: lambda key: F.lit(True))
    rows = random_rows(3)
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_trie_of_few_conversations(spark):
    assert nodes_of(spark, []) == [] and nodes_of(spark, [(None, 1, "a", "b")]) == []
    assert nodes_of(spark, [(5, 0, "u", "a b")], splice=False) == plain_trie([(5, 0, "u", "a b")], splice=False)


def test_sketch_never_counts_too_low(spark):
    rng = np.random.RandomState(1)
    keys = rng.randint(-2**62, 2**62, 60_000)
    keys = np.concatenate([keys, keys[:500]])
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(5)
    above = prefix_trie.may_be_shared(spark, prefix_trie.sketch(df, 1 << 17))
    got = {r["key"]: r["a"] for r in df.select("key", above("key").alias("a")).collect()}
    assert all(got[int(k)] for k in keys[:500])
    assert 0 < sum(got.values()) - 500 < 0.25 * len(keys)  # by chance: (1 - exp(-60000 / 131072)) squared


def test_node_texts(spark):
    conversations = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    nodes = prefix_trie.prefix_trie(conversations)
    turns = prefix_trie.whole(prefix_trie.numbered(conversations, texts=True))[1]
    told = {(r["conv_id"], r["depth"]): r["text"] for r in prefix_trie.with_texts(nodes, turns).collect()}
    rows = {(r["conv_id"], r["turn"] + 1): r["text"] for r in conversations.collect()}
    assert len(told) == nodes.count() and all(t == rows.get(k) for k, t in told.items())


# ---- collocations

def plain_phrases(rows, min_count=30, top=2000):
    f, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(ws)
            for n in range(1, 5):
                f[lang or "und"].update(" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= min_count and " " in p}
        longer = defaultdict(int)
        for p, a in cand.items():
            ws = p.split(" ")
            for n in range(2, len(ws)):
                for i in range(len(ws) - n + 1):
                    s = " ".join(ws[i:i + n])
                    longer[s] = max(longer[s], a)
        kept = []
        for p, a in cand.items():
            ws = p.split(" ")
            cuts = [(2_000_000 * a // (c[" ".join(ws[:k])] + c[" ".join(ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            if 100 * longer[p] < 80 * a:
                kept.append((-score, -a, p.encode(), c[" ".join(ws[:k])], c[" ".join(ws[k:])]))
        out += [(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_rows(seed, n=1500):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "cat", "sat", "on", "mat", "é", "日本", "a-b", "\xa0x", "\0", "of"] + [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        ws = [rng.choice(vocabulary[:12] if rng.random() < 0.9 else vocabulary) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "!?", "\x0b"] if rng.random() < 0.3 else [" "]) for w in ws)
        rows.append((rng.choice(["en", "en", "fr", None, "a.b"]), text))
    return rows + [("en", None), (None, ""), (None, None), ("en", "new york city hall " * 50), ("fr", "ab" * 700_000 + " mit " + "ab" * 700_000)] + [("en", "same row twice over")] * 40


def phrases_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string")
    for c in ("phrase", "count", "words", "key", "part", "a", "n", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    return sorted(tuple(r) for r in collocation.top_phrases(df.repartition(3), **options).collect())


def test_phrases_equal_brute_force(spark):
    rows = phrase_rows(1)
    exp = plain_phrases(rows)
    assert len(exp) > 100; assert phrases_of(spark, rows) == exp


def test_phrases_with_small_summaries_and_bitmap(spark, monkeypatch):
    monkeypatch.setattr(collocation, "HELD_BYTES", 1 << 12)
    monkeypatch.setattr(collocation, "HELD_PHRASES", 16)
    rows = phrase_rows(2)
    exp = plain_phrases(rows, top=20)
    assert phrases_of(spark, rows, top=20, slack=1, bits=1 << 16, max_counters=16) == exp
    assert phrases_of(spark, [], ) == [] and phrases_of(spark, [("en", None), (None, "one two")]) == []


@given(st.dictionaries(st.integers(0, 2**32 - 1), st.integers(1, 10**6), min_size=1, max_size=50))
@settings(max_examples=100, deadline=None)
def test_packed_counts_come_back(counts):
    keys = np.array(sorted(counts), np.uint32)
    got, n = collocation.unpacked(collocation.packed(keys, np.array([counts[k] for k in sorted(counts)])), len(keys))
    assert got.tolist() == sorted(counts) and dict(zip(got.tolist(), n.tolist())) == counts


@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=8), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_merged_summaries_keep_their_bound(batches, capacity):
    state, taken, mass, exact = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0, 0, Counter()
    for batch in batches:
        keys, counts = np.unique(np.array(batch, np.int64), return_counts=True)
        k, c, t = collocation.summarise(np.concatenate([state[0], keys]), np.concatenate([state[1], counts]), capacity)
        state, taken, mass = (k, c), taken + t, mass + len(batch)
        exact.update(batch)
    held = dict(zip(state[0].tolist(), state[1].tolist()))
    assert len(held) <= capacity and taken <= mass / (capacity + 1)
    assert all(n - taken <= held.get(k, 0) <= n for k, n in exact.items())


def test_collocations_are_native_to_their_language(spark):
    got = QUERIES["op13_collocations"](spark, SF_SMALL)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases([(r["lang"], r["text"]) for r in docs.collect()])
