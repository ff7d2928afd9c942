"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelens.llm import (collocation, decontam, langid, license_scan, mixing, near_dup, pii, prefix_hash, prefix_trie, quality, sharding,
                           toxicity, warc)
from judgelens.llm.common import cut_lineage, fold_of
from judgelens.session import ensure_checkpoint_dir, remove_folder
from judgelens.sources.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of("doc_id", 5) == 0
    model = langid.train(langid.training_sample(docs.filter(~held)))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "switches")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    return quality.fit_on(docs.filter(fold_of("doc_id", 3) != 1), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "margin")


def op3_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprints(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = cut_lineage(warc.read_archives(spark, path))
    remove_folder(spark, path)
    return warc.resolve_revisits(records)


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_queue(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = toxicity.graded_sample(docs, table(spark, sf_dir, "labels"), grade_col="toxic")
    return toxicity.score_toxicity(docs, toxicity.train(toxicity.split_severe(sample)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op11_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = {i: 1.0 for i in range(24)}
    rows = sharding.shard_slots(table(spark, sf_dir, "documents"), shards, added={24: 1.0})
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.spliced(prefix_trie.numbered(table(spark, sf_dir, "conversations"))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.top_phrases(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality, op3_prefix_hash, op4_warc_revisits, op5_fair_mix, op6_decontaminate,
                                   op7_toxicity, op8_license_scan, op9_jaccard_join, op10_pii, op11_rendezvous_shards, op12_prefix_trie,
                                   op13_collocations, pipeline)}

ORACLE_SQL = {
    "op4_warc_revisits": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
    "op5_fair_mix": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                          md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                     [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
        c AS (SELECT *, source_size * 3 AS cap FROM s),
        f AS (SELECT *, (cap::DOUBLE * sum(w) OVER up <= (sum(source_size) OVER () - (sum(cap) OVER down - cap))::DOUBLE * w) AS is_full
              FROM c WINDOW down AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING),
                            up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        t AS (SELECT source, source_size,
                     CASE WHEN is_full THEN cap::DOUBLE
                          ELSE (w * (sum(source_size) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()))::DOUBLE
                               / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
        o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (CASE WHEN size = 0 THEN 0 ELSE
                  greatest(0, least(size, floor(target)::BIGINT - before))
                  + greatest(0, least(size, floor(target)::BIGINT - before - source_size))
                  + greatest(0, least(size, floor(target)::BIGINT - before - 2 * source_size)) END)::BIGINT AS taken
        FROM o""",
    "op11_rendezvous_shards": r"""
        WITH t AS (SELECT list(v ORDER BY n) AS tbl FROM (
               SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(n))),
        d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, coalesce(doc_id::VARCHAR, '\N') AS k,
                     list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
        c AS (SELECT doc_id, size, k, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
                     lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1])))::BIGINT AS text_crc32 FROM d, t),
        r AS (SELECT *, list_transform(range(25), lambda s: {'draw': -ln((('0x' || substr(md5(k || ':' || s::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE),
                                                            'shard': s::INT}) AS draws FROM c),
        w AS (SELECT doc_id, size, text_crc32, list_min(draws[1:24]).shard AS shard, list_min(draws).shard AS grown_shard FROM r)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
        FROM w""",
    "op12_prefix_trie": r"""
        WITH n AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
        l AS (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS ts FROM n GROUP BY c),
        z AS (SELECT c, ts, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
                     lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda q, j: CASE WHEN q & 1 = 1 THEN xor(3988292384, q >> 1) ELSE q >> 1 END))) % 4 AS h FROM l),
        b AS (SELECT z.c, list_concat(coalesce(f.ts[1:z.h], []), coalesce(z.ts[z.h + 1:], [])) AS path
              FROM z LEFT JOIN l AS f ON f.c = z.c - z.c % 20),
        p AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM b),
        m AS (SELECT c, d, len(path) AS len, path[1:d] AS pre FROM p),
        nodes AS (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs,
                         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].text, '[^\x20\x09-\x0D]+')) END AS saved,
                         max(len) = d AS is_leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256
                  FROM m GROUP BY pre, d),
        up AS (SELECT saved, is_leaf, d, pre, unnest(range(0, d + 1)) AS ad FROM nodes),
        sub AS (SELECT pre[1:ad] AS pre, ad AS d, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (is_leaf) AS n_leaves,
                       count(*) FILTER (up.d = ad + 1) AS n_children FROM up GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM nodes n JOIN sub s ON n.d = s.d AND n.pre = s.pre LEFT JOIN nodes u ON u.d = n.d - 1 AND u.pre = n.pre[1:n.d - 1]""",
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
        w AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        e AS (SELECT lang, pid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
        v AS (SELECT lang, x, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4 FROM e WINDOW o AS (PARTITION BY pid ORDER BY i)),
        g AS (SELECT lang, 1 AS words, x AS phrase FROM v UNION ALL SELECT lang, 2, x || ' ' || x2 FROM v WHERE x2 IS NOT NULL
              UNION ALL SELECT lang, 3, x || ' ' || x2 || ' ' || x3 FROM v WHERE x3 IS NOT NULL
              UNION ALL SELECT lang, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM v WHERE x4 IS NOT NULL),
        f AS (SELECT lang, words, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
        q AS MATERIALIZED (SELECT lang, words, phrase, a FROM f WHERE a >= 30),
        c AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS ps FROM q WHERE words >= 2),
        u AS MATERIALIZED (SELECT lang, words, phrase, a, k, array_to_string(ps[1:k], ' ') AS head, array_to_string(ps[k + 1:], ' ') AS tail
              FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
        x AS (SELECT u.lang, u.words, u.phrase, u.a, u.k, h.a AS l, t.a AS r, ((2000000::HUGEINT * u.a) // (h.a + t.a))::BIGINT AS score
              FROM u JOIN q h ON h.lang = u.lang AND h.phrase = u.head JOIN q t ON t.lang = u.lang AND t.phrase = u.tail),
        b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, a, ps, m, unnest(range(1, words - m + 2)) AS i FROM c, range(2, 4) r(m) WHERE m < words),
        o AS (SELECT lang, array_to_string(ps[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
        k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
        SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, n.n, z.score FROM z JOIN n ON n.lang = z.lang WHERE z.rank <= 2000""",
}
