"""The registered queries on the smallest data: columns, types, oracles, and each operator's odd inputs."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
import corpus_pipeline
from judgelens.llm import decontam, langid, license_scan, mixing, near_dup, pii, prefix_hash, quality, toxicity, warc
from judgelens.llm.queries import ORACLE_SQL, QUERIES
from judgelens.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.compare import canon

COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_prefix_hash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_warc_revisits": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_fair_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_decontaminate": "doc_id bigint, item_id bigint, score double",
    "op7_toxicity": "doc_id bigint, severity double, grade int",
    "op8_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op9_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11_rendezvous_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "pipeline": "doc_id bigint, size bigint, target double, taken bigint",
}
LONG = "the quick brown fox jumps over the lazy dog. " * 6000


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    wanted = dict(c.split(" ") for c in COLUMNS[name].split(", "))
    assert {k: v for k, v in df.dtypes if k in wanted} == wanted
    n = df.count()
    if name not in ("op6_decontaminate", "op12_prefix_trie", "op13_collocations", "pipeline"):
        table = "pages" if name.startswith("op4") else "documents"
        assert n == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got, exp = QUERIES[name](spark, SF_SMALL).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    plain = lambda df: df.astype(object).where(df.notna(), None)  # noqa: E731  nulls of all kinds
    assert canon(plain(got)) == canon(plain(exp))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated ids and rows, and columns with clashing names."""
    rows = [(1, "plain text with some words here", "en", "a", 31), (2, None, "en", "a", 0), (3, "", None, None, 0), (None, "no id at all", "de", "b", 12),
            (None, "no id at all", "de", "b", 12), (4, LONG, "en", "b", len(LONG)), (5, "?!  \t\n", "fr", "", 6), (6, "same id", "en", "a", 7), (6, "another text", "en", "a", 12),
            (7, "twice", "en", "a", 5), (7, "twice", "en", "a", 5), (8, "x" * 300_000, "en", None, None), (9, "Straße ÉCOLE 日本語 \U0001F600", None, "b", 20), (10, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "key", "ref", "row", "part", "last", "pii", "k", "size", "bands", "page_id", "label", "grade", "nth", "services", "target", "comp", "url", "row_key", "weight"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3, "doc_id")


def models(spark):
    good = [(f"word {i} and more of it", 1, 1.0) for i in range(20)]
    bad = [(f"### {i} $$$ %%%", 0, 1.0) for i in range(20)]
    return quality.fit([(quality.indicators(t).nonzero()[0], y, w) for t, y, w in good + bad])


OPERATORS = {
    "langid": lambda s, d: langid.identify(d, langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")])),
    "quality": lambda s, d: quality.score_quality(d, models(s)),
    "prefix_hash": lambda s, d: prefix_hash.fingerprints(d),
    "mixing": lambda s, d: mixing.fair_queue(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxicity.Model({"idiot": 3.0}, toxicity.thresholds_of(__import__("numpy").array([1.0, 0.0])))),
    "license": lambda s, d: license_scan.scan_licenses(d),
    "near_dup": lambda s, d: near_dup.near_duplicates(d),
    "pii": lambda s, d: pii.digest(pii.find_pii(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_give_one_result_each(spark, odd, name):
    got = OPERATORS[name](spark, odd).select("doc_id").collect()
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got)
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 9, 10]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "no id at all"), (None, "another text"), (2, None), (3, ""), (3, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    got = decontam.contaminated(odd, items).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, -1, 4, 6]
    assert decontam.contaminated(odd.limit(0), items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    assert decontam.keep_clean(odd, items).count() == 10
    assert decontam.contaminated(odd, items, shard_items=2).count() == 4


def test_warc_of_odd_rows(spark, tmpdir_path):
    big = "y" * 150
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", None), (2, None, ""), (None, "u", big), (3, "u", big), (3, "u", big), (4, "u", big), (5, "u", "WARC/1.1\r\n\r\n\r\n" * 20),
                                   (6, "é", "é" * 50), (7, "é", "é" * 50), (8, "u", "short"), (9, "u", "short")], "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    warc.write_archives(pages, f"{tmpdir_path}/w")
    got = sorted(warc.resolve_revisits(warc.read_archives(spark, f"{tmpdir_path}/w")).collect(), key=str)
    kinds = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == [(0, "response", None, 150), (1, "response", None, 0), (2, "response", None, 0), (3, "response", None, 150), (3, "response", None, 150), (4, "revisit", 3, 150),
                     (5, "response", None, 280), (6, "response", None, 100), (7, "revisit", 6, 100), (8, "response", None, 5), (9, "response", None, 5)]
    warc.write_archives(pages.limit(0), f"{tmpdir_path}/e")
    assert warc.read_archives(spark, f"{tmpdir_path}/e").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, odd, SF_SMALL)
    if k < 4:
        assert got.dtypes == odd.dtypes
    rows = got.collect()
    if k == 1:  # empty texts (2, 3, 10) are equal, repeated rows too
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows) == [-1, 1, 2, 4, 5, 6, 6, 7, 8, 9]
    elif k:
        assert len(rows) == 14
    assert stage(spark, odd.limit(0), SF_SMALL).count() == 0


def test_pipeline_stages_change_only_what_they_decide(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL)
    classes = near_dup.near_duplicates(docs)
    assert {r["doc_id"] for r in kept.collect()} == {r["class_id"] for r in classes.collect()}
    assert kept.exceptAll(docs).count() == 0
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF_SMALL)
    leaks = decontam.contaminated(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))
    assert clean.count() == docs.count() - leaks.select("doc_id").distinct().count()
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_pii(spark, docs, SF_SMALL).collect()}
    for r in docs.collect():
        spans = pii.spans_of(r["text"])
        assert redacted[r["doc_id"]] == (pii.redact(r["text"], spans) if spans else r["text"])


def test_warc_headers_of_revisits(spark, tmpdir_path):
    body = "same payload " * 20
    pages = spark.createDataFrame([(5, "http://a/5", body), (2, "http://a/2 x", body), (9, None, body), (7, "http://a/7", "other " * 30)], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmpdir_path}/w", date="2024-05-06T07:08:09Z")
    found = {}
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{tmpdir_path}/w").select("content").collect():
        for head, block in warc.parse_archive(warc.gunzip(bytes(row["content"]))):
            found[int(head["X-Page-Id"])] = head, block
    assert {i: h["WARC-Type"] for i, (h, _) in found.items()} == {2: "response", 5: "revisit", 7: "response", 9: "revisit"}
    for i in (5, 9):
        head = found[i][0]
        assert head["WARC-Refers-To"] == found[2][0]["WARC-Record-ID"] and head["WARC-Refers-To-Target-URI"] == "http://a/2_x"
        assert head["WARC-Refers-To-Date"] == head["WARC-Date"] == "2024-05-06T07:08:09Z" and body.encode() not in found[i][1]
    assert "WARC-Refers-To-Date" not in found[2][0] and "WARC-Target-URI" not in found[9][0]
    warc.write_archives(pages, f"{tmpdir_path}/now")
    [first] = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{tmpdir_path}/now").limit(1).select("content").collect()
    assert next(warc.parse_archive(warc.gunzip(bytes(first["content"]))))[0]["WARC-Date"] > "2025"
