"""DuckDB SQL for every registered query (the independent correctness check).

The fixture CTEs repeat :mod:`judgelens.plans.fixtures` in SQL; rank statistics are computed
here by brute force over (h, j) cells, which is fine for a checker at small scale.
"""

from __future__ import annotations

import math

from ..functions.exprs import PY_SPACE

NL = "chr(10)"
TWO_PI = repr(2 * math.pi) + "e0" if "e" not in repr(2 * math.pi) else repr(2 * math.pi)


def md5u(*parts: str) -> str:
    return ("(((('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8))::BIGINT)::DOUBLE"
            " + 0.5e0) / 4294967296e0)")


def md5n(*parts: str) -> str:
    return (f"(sqrt(-2e0 * ln({md5u(*parts, repr('a'))})) * cos({TWO_PI} * {md5u(*parts, repr('b'))}))")


def r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def clip(expr: str, n: int) -> str:
    return f"(CASE WHEN length({expr}) > {n} THEN left({expr}, {n}) || '...' ELSE {expr} END)"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '\\A[{PY_SPACE}]+|[{PY_SPACE}]+\\z', '', 'g')"


def half_up(expr: str, places: int) -> str:
    s = f"{float(10 ** places)}e0".replace(".0e0", "e0")
    return f"(floor(({expr}) * {s} + 0.5e0) / {s})"


FIXTURES: dict[str, str] = {
    "judged_docs": f"""
SELECT d.doc_id AS sample_id, d.source, d.lang, d.text AS response,
       CAST(1 + 6 * l.quality + 3 * (1 - l.toxic) AS DOUBLE) AS human_score,
       {half_up("1e0 + 9e0 * d.n_chars / (d.n_chars + 3000e0)", 1)} AS judge_score,
       least(10e0, greatest(1e0, length(d.text) / 20e0 + 5e0)) AS judge_len
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "judged_versions": """
SELECT sample_id, source, lang, response, human_score, 1 AS prompt_version, judge_score FROM judged_docs
UNION ALL
SELECT sample_id, source, lang, response, human_score, 2 AS prompt_version, judge_len AS judge_score FROM judged_docs""",
    "pair_scores": f"""
SELECT l_suppkey AS group_id, 1e0 + 9e0 * (l_quantity - 1e0) / 49e0 AS human_score,
       {half_up("1e0 + 9e0 * l_extendedprice / 105000e0", 1)} AS judge_score
FROM lineitem""",
    "eval_history": """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS BIGINT) AS step,
       val_loss, (k - 50) / 50e0 AS kendall_tau, k / 50e0 AS score_entropy,
       CASE WHEN k % 7 = 0 THEN NULL ELSE k / 500e0 END AS mean_self_consistency_var, ts, k, props
FROM (SELECT user_id AS run_id, event_id, ts, value AS val_loss, props,
             TRY_CAST(NULLIF(regexp_extract(props, '([0-9]+)', 1), '') AS INTEGER) AS k FROM events)""",
    "strata_samples": f"""
SELECT o_orderkey AS sample_id, {half_up("1e0 + 9e0 * o_totalprice / 500000e0", 2)} AS human_score FROM orders""",
    "proposals": f"""
SELECT o_orderkey AS proposal_id, o_custkey AS prompt_id, o_orderkey AS seq,
  CASE o_orderkey % 5 WHEN 0 THEN 'edit' WHEN 1 THEN 'add' WHEN 2 THEN 'remove' WHEN 3 THEN 'rename' ELSE NULL END AS action,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderpriority END AS section_name,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'tighten criteria for ' || o_orderpriority END AS opti_direction,
  CASE o_orderkey % 4 WHEN 0 THEN '   ' WHEN 1 THEN 'NO_MODIFICATION'
    WHEN 2 THEN 'Here you go:' || {NL} || '```text' || {NL} || '  rubric for ' || o_orderpriority || ' v'
                || CAST(o_orderkey AS VARCHAR) || '  ' || {NL} || '```' || {NL} || 'thanks'
    ELSE '  plain rubric ' || CAST(o_orderkey AS VARCHAR) || {NL} END AS content,
  (o_orderkey % 11) / 10e0 AS learning_rate
FROM orders""",
    "prompt_sections": """
SELECT c_custkey AS prompt_id, 1 AS version, s.pos, s.section,
       'criteria ' || s.section || ' for customer ' || CAST(c_custkey AS VARCHAR) AS content, s.is_meta
FROM customer, (VALUES (1, '1-URGENT', true), (2, '2-HIGH', false), (3, '3-MEDIUM', false)) s(pos, section, is_meta)""",
    "judge_replies": f"""
SELECT doc_id AS sample_id, head || {NL} || text AS reply FROM (
  SELECT doc_id, text, CASE doc_id % 6
    WHEN 0 THEN 'Score: ' || n || '.5' || {NL} || 'Reasoning follows.'
    WHEN 1 THEN 'The rating:' || n || ' seems fair'
    WHEN 2 THEN 'Some text' || {NL} || n || {NL} || 'more text'
    WHEN 3 THEN 'I think about ' || n || ' out of 10'
    WHEN 4 THEN 'I give .5'
    ELSE 'no verdict given' END AS head
  FROM (SELECT doc_id, text, CAST(doc_id % 10 AS VARCHAR) AS n FROM documents))""",
    "responses": """
SELECT CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS sample_id, coalesce(u.text, '') AS prompt, a.text AS response
FROM conversations a LEFT JOIN conversations u ON a.conv_id = u.conv_id AND u.turn + 1 = a.turn AND u.role = 'user'
WHERE a.role = 'assistant'""",
    "raw_scored_rows": f"""
SELECT sample_id,
  CASE WHEN {md5u("'prm'", "sample_id")} < 0.2e0 THEN NULL ELSE prompt END AS prompt,
  CASE WHEN {md5u("'resp'", "sample_id")} < 0.1e0 THEN NULL ELSE response END AS response,
  CASE WHEN u < 0.1e0 THEN NULL WHEN u < 0.2e0 THEN 'abc' WHEN u < 0.3e0 THEN 'true'
       ELSE printf('%.2f', {half_up("1e0 + 9e0 * u", 2)}) END AS score
FROM (SELECT *, {md5u("'raw'", "sample_id")} AS u FROM responses)""",
    "gradient_replies": f"""
SELECT o_orderkey AS reply_id, o_custkey AS prompt_id, CASE o_orderkey % 4
  WHEN 0 THEN '```json' || {NL} || '{{"modifications": [{{"action": "edit", "section_name": "' || o_orderpriority
              || '", "opti_direction": "be stricter"}}]}}' || {NL} || '```'
  WHEN 1 THEN 'Here is the gradient: {{"modifications": [{{"action": "add", "section_name": "Extra '
              || CAST(o_orderkey % 7 AS VARCHAR) || '", "opti_direction": "add rules", "structural": True}},]}} done'
  WHEN 2 THEN '{{"modifications": [{{"action": "remove", "section_name": "3-MEDIUM"}}, '
              || '{{"action": "edit", "section_name": "2-HIGH", "opti_direction": "tighten"}}]}}'
  ELSE 'no json in this reply for ' || o_orderpriority END AS reply
FROM orders""",
}

DEPS = {"judged_versions": ["judged_docs"], "raw_scored_rows": ["responses"]}


def sql(fixtures: list[str], ctes: list[tuple[str, str]], final: str) -> str:
    names: list[str] = []

    def add(n: str) -> None:
        for dep in DEPS.get(n, []):
            add(dep)
        if n not in names:
            names.append(n)
    for f in fixtures:
        add(f)
    parts = [f"{n} AS ({FIXTURES[n]}\n)" for n in names] + [f"{n} AS ({body}\n)" for n, body in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + final) if parts else final


# ---- generic metric CTEs over a source with human_score / judge_score ---------------------------

def _k(keys, alias=None):
    return ", ".join(f"{alias}.{k}" if alias else k for k in keys)


def _on(keys, a="a", b="b"):
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def cells_cte(src: str, keys: list[str], name: str) -> tuple[str, str]:
    return name, (f"SELECT {_k(keys)}, human_score AS h, judge_score AS j, count(*) AS w FROM {src} "
                  f"WHERE human_score IS NOT NULL AND judge_score IS NOT NULL GROUP BY ALL")


def pair_ctes(src: str, keys: list[str], p: str) -> list[tuple[str, str]]:
    """CTEs ``{p}_pm`` (keys, n, kendall_tau, kendall_tau_loss, clear_pairs, pairwise_loss)."""
    c = f"{p}_c"
    K = _k(keys)
    n0 = "(CAST(t.n AS DOUBLE) * (t.n - 1) / 2e0)"
    den = f"nullif(sqrt(({n0} - th.n1) * ({n0} - tj.n2)), 0e0)"
    return [
        cells_cte(src, keys, c),
        (f"{p}_pairs", f"""SELECT {_k(keys, 'a')}, CAST(sum(a.w * b.w * sign(b.j - a.j)) AS DOUBLE) AS s,
  CAST(sum(CASE WHEN abs(b.h - a.h) > 1e-6 THEN a.w * b.w ELSE 0 END) AS DOUBLE) AS clear,
  sum(CASE WHEN abs(b.h - a.h) > 1e-6 AND b.j <= a.j THEN a.w * b.w * (b.h - a.h) ELSE 0e0 END) AS loss
FROM {c} a JOIN {c} b ON {_on(keys)} AND a.h < b.h GROUP BY {_k(keys, 'a')}"""),
        (f"{p}_t", f"SELECT {K}, CAST(sum(w) AS DOUBLE) AS n FROM {c} GROUP BY {K}"),
        (f"{p}_th", f"SELECT {K}, CAST(sum(cw * (cw - 1) / 2) AS DOUBLE) AS n1 FROM "
                    f"(SELECT {K}, h, sum(w) AS cw FROM {c} GROUP BY ALL) GROUP BY {K}"),
        (f"{p}_tj", f"SELECT {K}, CAST(sum(cw * (cw - 1) / 2) AS DOUBLE) AS n2 FROM "
                    f"(SELECT {K}, j, sum(w) AS cw FROM {c} GROUP BY ALL) GROUP BY {K}"),
        (f"{p}_pm", f"""SELECT {_k(keys, 't')}, CAST(t.n AS BIGINT) AS n,
  CASE WHEN t.n < 2 THEN 0e0 ELSE coalesce(coalesce(p.s, 0e0) / {den}, 0e0) END AS kendall_tau,
  CASE WHEN t.n < 2 THEN 0e0 ELSE coalesce(1e0 - coalesce(p.s, 0e0) / {den}, 1e0) END AS kendall_tau_loss,
  CAST(coalesce(p.clear, 0e0) AS BIGINT) AS clear_pairs,
  coalesce(p.loss, 0e0) / greatest(coalesce(p.clear, 0e0), 1e0) AS pairwise_loss
FROM {p}_t t JOIN {p}_th th ON {_on(keys, 't', 'th')} JOIN {p}_tj tj ON {_on(keys, 't', 'tj')}
LEFT JOIN {p}_pairs p ON {_on(keys, 't', 'p')}"""),
    ]


def spearman_ctes(src: str, keys: list[str], p: str) -> list[tuple[str, str]]:
    """CTE ``{p}_sp`` (keys, n, spearman_rho, spearman_loss) from average ranks."""
    K = _k(keys)
    part = f"PARTITION BY {K}"
    mid = "(n + 1) / 2e0"
    rho = "sxy / sqrt(sxx * syy)"
    return [
        (f"{p}_r", f"""SELECT {K},
  rank() OVER ({part} ORDER BY human_score) + (count(*) OVER ({part}, human_score) - 1) / 2e0 AS rh,
  rank() OVER ({part} ORDER BY judge_score) + (count(*) OVER ({part}, judge_score) - 1) / 2e0 AS rj,
  count(*) OVER ({part}) AS n
FROM {src} WHERE human_score IS NOT NULL AND judge_score IS NOT NULL"""),
        (f"{p}_a", f"""SELECT {K}, any_value(n) AS n, sum((rh - {mid}) * (rj - {mid})) AS sxy,
  sum((rh - {mid}) * (rh - {mid})) AS sxx, sum((rj - {mid}) * (rj - {mid})) AS syy FROM {p}_r GROUP BY {K}"""),
        (f"{p}_sp", f"""SELECT {K}, CAST(n AS BIGINT) AS n,
  CASE WHEN n < 2 THEN 0e0 WHEN sxx > 0 AND syy > 0 THEN {rho} ELSE 0e0 END AS spearman_rho,
  CASE WHEN n < 2 THEN 0e0 WHEN sxx > 0 AND syy > 0 THEN 1e0 - {rho} ELSE 1e0 END AS spearman_loss
FROM {p}_a"""),
    ]


def entropy_ctes(src: str, keys: list[str], p: str, n_bins: int = 10) -> list[tuple[str, str]]:
    """CTE ``{p}_en`` (keys, n, score_entropy)."""
    K = _k(keys)
    bins = " + ".join(f"CAST(x.judge_score >= {float(i)}e0 * st.step + st.lo AS INTEGER)".replace(".0e0", "e0")
                      for i in range(1, n_bins))
    return [
        (f"{p}_x", f"SELECT {K}, judge_score FROM {src} WHERE judge_score IS NOT NULL"),
        (f"{p}_st", f"""SELECT *, (hi - lo) / {n_bins}e0 AS step FROM (
  SELECT {K}, count(*) AS n,
    CASE WHEN min(judge_score) = max(judge_score) THEN min(judge_score) - 0.5e0 ELSE min(judge_score) END AS lo,
    CASE WHEN min(judge_score) = max(judge_score) THEN max(judge_score) + 0.5e0 ELSE max(judge_score) END AS hi
  FROM {p}_x GROUP BY {K})"""),
        (f"{p}_b", f"SELECT {_k(keys, 'x')}, {bins} AS bin FROM {p}_x x JOIN {p}_st st ON {_on(keys, 'x', 'st')}"),
        (f"{p}_cnt", f"SELECT {K}, bin, count(*) AS c FROM {p}_b GROUP BY ALL"),
        (f"{p}_en", f"""SELECT {_k(keys, 'st')}, CAST(st.n AS BIGINT) AS n,
  CASE WHEN st.n < 2 THEN 0e0 ELSE sum(-(c.c / st.n) * ln(c.c / st.n)) END AS score_entropy
FROM {p}_cnt c JOIN {p}_st st ON {_on(keys, 'c', 'st')} GROUP BY {_k(keys, 'st')}, st.n"""),
    ]


G = ["source", "prompt_version"]
GK = "source, prompt_version"
ERR = "(judge_score - human_score)"


def _basic(agg: str) -> str:
    return sql(["judged_versions"], [], f"SELECT {GK}, count(*) AS n, {agg} FROM judged_versions GROUP BY {GK}")


Q: dict[str, str] = {}

Q["error_columns"] = sql(["judged_docs"], [], f"""SELECT sample_id, source, {r('human_score', 'human_score')},
  {r('judge_score', 'judge_score')}, {r(ERR, 'error')}, {r(f'abs{ERR}', 'abs_error')} FROM judged_docs""")

Q["error_metrics"] = _basic(f"{r(f'avg(abs{ERR})', 'mae')}, {r(f'avg({ERR} * {ERR})', 'mse')}, "
                            f"{r(f'sqrt(avg({ERR} * {ERR}))', 'rmse')}, {r(f'avg{ERR}', 'mean_error')}")

Q["error_metrics_rollup"] = sql(["judged_docs"], [], f"""SELECT source, lang,
  CAST(grouping_id(source, lang) AS BIGINT) AS grouping_level, count(*) AS n, {r(f'avg(abs{ERR})', 'mae')},
  {r(f'avg({ERR} * {ERR})', 'mse')}, {r(f'sqrt(avg({ERR} * {ERR}))', 'rmse')}, {r(f'avg{ERR}', 'mean_error')},
  {r('stddev_pop(judge_score)', 'score_std')} FROM judged_docs GROUP BY ROLLUP (source, lang)""")

Q["huber_loss"] = _basic(r(f"avg(CASE WHEN abs{ERR} <= 1e0 THEN 0.5e0 * abs{ERR} * abs{ERR} "
                           f"ELSE 1e0 * (abs{ERR} - 0.5e0) END)", "huber_loss"))

Q["score_spread"] = _basic(f"{r('stddev_pop(judge_score)', 'score_std')}, {r('stddev_pop(human_score)', 'human_std')}")

Q["score_entropy"] = sql(["judged_versions"], entropy_ctes("judged_versions", G, "e"),
                         f"SELECT {GK}, n, {r('score_entropy', 'score_entropy')} FROM e_en")

Q["kendall_tau"] = sql(["pair_scores"], pair_ctes("pair_scores", ["group_id"], "k"),
                       f"SELECT group_id, n, {r('kendall_tau', 'kendall_tau')}, "
                       f"{r('kendall_tau_loss', 'kendall_tau_loss')} FROM k_pm")

Q["pairwise_ranking_loss"] = sql(["pair_scores"], pair_ctes("pair_scores", ["group_id"], "k"),
                                 f"SELECT group_id, n, clear_pairs, {r('pairwise_loss', 'pairwise_loss')} FROM k_pm")

Q["pairwise_ranking_loss_margin"] = sql(["pair_scores"], pair_ctes("pair_scores", ["group_id"], "k") + [
    ("short", """SELECT a.group_id, sum(a.w * b.w * (0.5e0 - (b.j - a.j))) AS penalty FROM k_c a JOIN k_c b
  ON a.group_id = b.group_id AND b.h - a.h > 1e-6 AND b.j > a.j AND b.j - a.j < 0.5e0 GROUP BY 1""")],
    f"""SELECT group_id, n, clear_pairs,
  {r('pairwise_loss + coalesce(penalty, 0e0) / greatest(clear_pairs, 1)', 'pairwise_loss')}
FROM k_pm LEFT JOIN short USING (group_id)""")

Q["spearman_rho"] = sql(["pair_scores"], spearman_ctes("pair_scores", ["group_id"], "s"),
                        f"SELECT group_id, n, {r('spearman_rho', 'spearman_rho')}, "
                        f"{r('spearman_loss', 'spearman_loss')} FROM s_sp")

_rank_ctes = pair_ctes("judged_versions", G, "k") + spearman_ctes("judged_versions", G, "s")
Q["composite_loss"] = sql(["judged_versions"], _rank_ctes + [
    ("m", f"SELECT {GK}, avg(abs{ERR}) AS mae FROM judged_versions GROUP BY {GK}"),
    ("all3", f"""SELECT m.source, m.prompt_version, m.mae, k.pairwise_loss, k.kendall_tau_loss, s.spearman_loss
FROM m JOIN k_pm k USING ({GK}) JOIN s_sp s USING ({GK})"""),
    ("per", f"""SELECT {GK}, 'pairwise' AS loss_type, mae, pairwise_loss AS rl FROM all3 UNION ALL
SELECT {GK}, 'kendall', mae, kendall_tau_loss FROM all3 UNION ALL
SELECT {GK}, 'spearman', mae, spearman_loss FROM all3""")],
    f"SELECT {GK}, loss_type, {r('1e0 * mae + 1e0 * rl', 'total_loss')}, {r('mae', 'mae_component')}, "
    f"{r('rl', 'rank_loss_component')} FROM per")

Q["evaluation_report"] = sql(["judged_versions"], _rank_ctes + entropy_ctes("judged_versions", G, "e") + [
    ("b", f"""SELECT {GK}, count(*) AS n, avg(abs{ERR}) AS mae, avg({ERR} * {ERR}) AS mse,
  sqrt(avg({ERR} * {ERR})) AS rmse, stddev_pop(judge_score) AS score_std FROM judged_versions GROUP BY {GK}""")],
    f"""SELECT b.source, b.prompt_version, b.n, {r('b.mae', 'mae')}, {r('b.mse', 'mse')}, {r('b.rmse', 'rmse')},
  {r('k.kendall_tau', 'kendall_tau')}, {r('s.spearman_rho', 'spearman_rho')}, {r('e.score_entropy', 'score_entropy')},
  {r('b.score_std', 'score_std')}, CAST(NULL AS DOUBLE) AS mean_self_consistency_var, {r('b.mae', 'mae_component')},
  {r('k.pairwise_loss', 'rank_loss_component')}, {r('1e0 * b.mae + 1e0 * k.pairwise_loss', 'total_loss')}
FROM b JOIN k_pm k USING ({GK}) JOIN s_sp s USING ({GK}) JOIN e_en e USING ({GK})""")

Q["judge_human_join"] = f"""SELECT d.doc_id AS sample_id,
  {r(half_up('1e0 + 9e0 * d.n_chars / (d.n_chars + 3000e0)', 1), 'judge_score')},
  {r('CAST(1 + 6 * l.quality + 3 * (1 - l.toxic) AS DOUBLE)', 'human_score')}
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

# ---- sampling ------------------------------------------------------------------------------

SPLIT = ("split", """SELECT sample_id, human_score,
  CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(sample_id AS VARCHAR)), sample_id)
            <= floor(count(*) OVER () * 0.2e0) THEN 'val' ELSE 'train' END AS split
FROM strata_samples""")

Q["train_val_split"] = sql(["strata_samples"], [SPLIT],
                           f"SELECT sample_id, {r('human_score', 'human_score')}, split FROM split")
Q["split_summary"] = sql(["strata_samples"], [SPLIT], f"""SELECT split, count(*) AS n,
  {r('min(human_score)', 'min_score')}, {r('max(human_score)', 'max_score')}, {r('avg(human_score)', 'mean_score')}
FROM split GROUP BY split""")


def _pct(p: str) -> str:
    return (f"(SELECT CASE WHEN t >= 0.5e0 THEN b - (b - a) * (1e0 - t) ELSE a + (b - a) * t END FROM "
            f"(SELECT q.t, (SELECT h FROM o WHERE rk = q.lo) AS a, (SELECT h FROM o WHERE rk = q.hi) AS b FROM "
            f"(SELECT floor(pos) AS lo, ceil(pos) AS hi, pos - floor(pos) AS t FROM "
            f"(SELECT {p} * (n - 1) AS pos FROM cnt)) q))")


STRATA = [
    ("s0", "SELECT sample_id, human_score AS h FROM strata_samples WHERE human_score IS NOT NULL"),
    ("o", "SELECT h, row_number() OVER (ORDER BY h) - 1 AS rk FROM s0"),
    ("cnt", "SELECT CAST(count(*) AS DOUBLE) AS n FROM s0"),
    ("thr", f"SELECT {_pct('0.25e0')} AS low_threshold, {_pct('0.75e0')} AS high_threshold"),
    ("strata", """SELECT s.sample_id, s.human_score, thr.low_threshold, thr.high_threshold,
  CASE WHEN s.human_score >= thr.high_threshold THEN 'high' WHEN s.human_score <= thr.low_threshold THEN 'low'
       ELSE 'mid' END AS stratum FROM strata_samples s, thr"""),
]
Q["score_strata"] = sql(["strata_samples"], STRATA, f"""SELECT sample_id, {r('human_score', 'human_score')},
  {r('low_threshold', 'low_threshold')}, {r('high_threshold', 'high_threshold')}, stratum FROM strata""")

BATCHES = STRATA + [
    ("e", "SELECT strata.*, CAST(t.epoch AS INTEGER) AS epoch FROM strata, range(0, 2) t(epoch)"),
    ("p", """SELECT *, row_number() OVER (PARTITION BY epoch, stratum
    ORDER BY md5('42:' || CAST(epoch AS VARCHAR) || ':' || CAST(sample_id AS VARCHAR)), sample_id) - 1 AS p FROM e"""),
    ("w", """SELECT *, floor(p / CASE stratum WHEN 'high' THEN 11 WHEN 'low' THEN 11 ELSE 10 END) AS wave,
  CASE stratum WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 2 END AS srank FROM p"""),
    ("pos", "SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY wave, srank, p) - 1 AS position FROM w"),
    ("eb", """SELECT sample_id, human_score, stratum, epoch, CAST(position AS BIGINT) AS position,
  CAST(floor(position / 32) AS BIGINT) AS batch_no FROM pos"""),
]
Q["epoch_batches"] = sql(["strata_samples"], BATCHES,
                         f"SELECT sample_id, {r('human_score', 'human_score')}, stratum, epoch, position, batch_no FROM eb")
Q["gather_batches"] = sql(["strata_samples"], BATCHES,
                          f"SELECT sample_id, {r('human_score', 'human_score')}, batch_no, position, stratum FROM eb WHERE epoch = 1")
Q["epoch_progress"] = sql(["strata_samples"], BATCHES + [
    ("per", "SELECT epoch, batch_no, count(*) AS batch_rows FROM eb GROUP BY ALL"),
    ("nn", "SELECT count(*) AS n FROM eb WHERE epoch = 0"),
    ("sn", "SELECT *, sum(batch_rows) OVER (PARTITION BY epoch ORDER BY batch_no) AS seen FROM per")],
    f"""SELECT epoch, batch_no, batch_rows, CAST(seen AS BIGINT) AS seen,
  {r('CASE WHEN nn.n = 0 THEN 0e0 ELSE seen / nn.n END', 'progress')} FROM sn, nn""")

# ---- error samples ------------------------------------------------------------------------

SEL = [
    ("ee", f"""SELECT source, sample_id, response, human_score, judge_score, {ERR} AS error, abs{ERR} AS abs_error
FROM judged_docs"""),
    ("sel", """SELECT *, 'overestimated' AS category, row_number() OVER (PARTITION BY source ORDER BY error DESC, sample_id) AS rank
  FROM ee WHERE error > 0 QUALIFY rank <= 3
UNION ALL SELECT *, 'underestimated', row_number() OVER (PARTITION BY source ORDER BY error ASC, sample_id) AS rank
  FROM ee WHERE error < 0 QUALIFY rank <= 3
UNION ALL SELECT *, 'well_aligned', row_number() OVER (PARTITION BY source ORDER BY abs_error ASC, sample_id) AS rank
  FROM ee QUALIFY rank <= 3"""),
]
Q["error_samples"] = sql(["judged_docs"], SEL, f"""SELECT source, sample_id, {r('human_score', 'human_score')},
  {r('judge_score', 'judge_score')}, {r('error', 'error')}, {r('abs_error', 'abs_error')},
  CAST(rank AS BIGINT) AS rank, category FROM sel""")


def _f(cat: str, agg: str) -> str:
    return f"{agg} FILTER (WHERE category = '{cat}')"


Q["error_statistics"] = sql(["judged_docs"], SEL + [
    ("ch", f"""SELECT source, {_f('overestimated', 'count(*)')} AS over_count,
  {_f('overestimated', 'avg(error)')} AS over_mean_error, {_f('overestimated', 'max(error)')} AS over_max_error,
  {_f('underestimated', 'count(*)')} AS under_count, {_f('underestimated', 'avg(error)')} AS under_mean_error,
  {_f('underestimated', 'min(error)')} AS under_min_error, {_f('well_aligned', 'count(*)')} AS aligned_count,
  {_f('well_aligned', 'avg(abs_error)')} AS aligned_mean_abs_error FROM sel GROUP BY source"""),
    ("ov", f"""SELECT source, count(*) AS total_samples, avg(abs(e)) AS overall_mae, avg(e) AS overall_mean_error,
  stddev_pop(e) AS overall_std_error, count(*) FILTER (WHERE e > 0) AS over_total,
  count(*) FILTER (WHERE e < 0) AS under_total FROM (SELECT source, {ERR} AS e FROM judged_docs) GROUP BY source""")],
    f"""SELECT ov.source, total_samples, CAST(coalesce(over_count, 0) AS BIGINT) AS over_count,
  {r('coalesce(over_mean_error, 0e0)', 'over_mean_error')}, {r('coalesce(over_max_error, 0e0)', 'over_max_error')},
  CAST(coalesce(under_count, 0) AS BIGINT) AS under_count,
  {r('coalesce(under_mean_error, 0e0)', 'under_mean_error')}, {r('coalesce(under_min_error, 0e0)', 'under_min_error')},
  CAST(coalesce(aligned_count, 0) AS BIGINT) AS aligned_count,
  {r('coalesce(aligned_mean_abs_error, 0e0)', 'aligned_mean_abs_error')}, {r('overall_mae', 'overall_mae')},
  {r('overall_mean_error', 'overall_mean_error')}, {r('overall_std_error', 'overall_std_error')}, over_total, under_total
FROM ov LEFT JOIN ch USING (source)""")

Q["format_error_samples"] = sql(["judged_docs"], SEL + [
    ("lines", f"""SELECT source, category, rank,
  printf(E'  样本%d: %s\\n    人工评分: %.1f, AI评分: %.1f, 误差: %+.1f\\n', rank, {clip('response', 200)},
         human_score, judge_score, judge_score - human_score) AS line FROM sel"""),
    ("blocks", "SELECT source, category, string_agg(line, '' ORDER BY rank) AS text FROM lines GROUP BY ALL"),
    ("grp", """SELECT DISTINCT j.source, c.category, c.label FROM judged_docs j,
  (VALUES ('overestimated', '高估'), ('underestimated', '低估'), ('well_aligned', '对齐')) c(category, label)""")],
    """SELECT g.source, g.category, coalesce(b.text, E'  （无' || g.label || E'样本）\\n') AS text
FROM grp g LEFT JOIN blocks b USING (source, category)""")

Q["prompt_version_compare"] = sql(["judged_versions"], [
    ("cmp", """SELECT a.source, abs(a.judge_score - a.human_score) AS ea, abs(b.judge_score - a.human_score) AS eb
FROM judged_versions a JOIN judged_versions b ON a.source = b.source AND a.sample_id = b.sample_id
WHERE a.prompt_version = 1 AND b.prompt_version = 2""")],
    f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE eb < ea) AS n_better, count(*) FILTER (WHERE eb = ea) AS n_same,
  count(*) FILTER (WHERE NOT (eb < ea OR eb = ea)) AS n_worse, {r('avg(ea)', 'mae_a')}, {r('avg(eb)', 'mae_b')}
FROM cmp GROUP BY source""")

# ---- scoring ------------------------------------------------------------------------------

_noise_sc = md5n("'sc'", "CAST(prompt_version AS VARCHAR)", "sample_id", "CAST(rep AS VARCHAR)")
CONSISTENCY = [
    ("rv", "SELECT r.*, v.prompt_version FROM responses r, (VALUES (1), (2)) v(prompt_version)"),
    ("rep", "SELECT rv.*, t.rep FROM rv, range(1, 4) t(rep)"),
    ("sc", f"""SELECT prompt_version, sample_id,
  least(10e0, greatest(1e0, length(response) / 20e0 + 5e0 + {_noise_sc})) AS s FROM rep""")]
Q["mean_consistency"] = sql(["responses"], CONSISTENCY + [
    ("per", "SELECT prompt_version, sample_id, var_pop(s) AS variance FROM sc GROUP BY ALL")],
    f"SELECT prompt_version, {r('avg(variance)', 'mean_self_consistency_var')} FROM per GROUP BY 1")
_words = "list_distinct(string_split(prompt, ' '))"
Q["batch_scores"] = sql(["responses"], [], f"""SELECT sample_id,
  {r(f"len(list_intersect({_words}, string_split(coalesce(response, ''), ' '))) / CAST(len({_words}) AS DOUBLE)", 'judge_score')}
FROM responses""")
Q["self_consistency"] = sql(["responses"], CONSISTENCY,
    f"""SELECT prompt_version, sample_id, {r('avg(s)', 'mean_score')}, {r('var_pop(s)', 'variance')},
  count(s) AS n_scores FROM sc GROUP BY ALL""")

Q["length_judge"] = sql(["responses"], [], f"""SELECT sample_id,
  {r(f"least(10e0, greatest(1e0, length(response) / 20e0 + 5e0 + {md5n(repr('lj'), 'sample_id')}))", 'judge_score')}
FROM responses""")

_NUM = r"([0-9]*\.?[0-9]+)"
_PATS = [r"(?:score|Score|SCORE)[" + PY_SPACE + r":：]*" + _NUM,
         r"(?:分数|評分)[" + PY_SPACE + r":：]*" + _NUM,
         r"(?:rating|Rating|RATING)[" + PY_SPACE + r":：]*" + _NUM,
         r"(?m)^" + _NUM + r"$",
         _NUM]
_found = ", ".join(f"TRY_CAST(NULLIF(regexp_extract(reply, '{p}', 1), '') AS DOUBLE)" for p in _PATS)
Q["extract_score"] = sql(["judge_replies"], [], f"""SELECT sample_id, coalesce({_found}, 5e0) AS score,
  coalesce({_found}) IS NULL AS used_fallback FROM judge_replies""")

Q["unscored_pairs"] = """WITH cand AS (SELECT v.prompt_version, d.doc_id AS sample_id FROM documents d, (VALUES (1), (2)) v(prompt_version)),
cache AS (SELECT 1 AS prompt_version, doc_id AS sample_id FROM labels
          UNION ALL SELECT 2, doc_id FROM labels WHERE quality = 1)
SELECT prompt_version, sample_id FROM cand
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.prompt_version = cand.prompt_version AND c.sample_id = cand.sample_id)"""

# ---- prompts and audit --------------------------------------------------------------------

FENCED = r"(?s)```(?:text)?[" + PY_SPACE + r"]*\n(.*?)\n```"
_strip_rc = strip("rc")
_new = (f"(CASE WHEN regexp_matches({_strip_rc}, '{FENCED}') "
        f"THEN {strip(f'regexp_extract({_strip_rc}, {chr(39)}{FENCED}{chr(39)}, 1)')} ELSE {_strip_rc} END)")
AUDIT = [
    ("meta", "SELECT DISTINCT prompt_id, section AS section_name FROM prompt_sections WHERE is_meta"),
    ("pj", """SELECT p.*, (m.section_name IS NOT NULL) AS is_meta FROM proposals p
LEFT JOIN meta m ON p.prompt_id = m.prompt_id AND p.section_name = m.section_name"""),
    ("s1", """SELECT *,
  CASE WHEN action IS NULL OR section_name IS NULL THEN 'missing_fields'
       WHEN action NOT IN ('edit', 'add', 'remove') THEN 'invalid_action'
       WHEN action IN ('add', 'remove') AND NOT (learning_rate >= 0.6e0) THEN 'lr_threshold'
       WHEN is_meta THEN 'meta_section'
       WHEN action IN ('edit', 'add') AND opti_direction IS NULL THEN 'missing_direction' END AS stage1_reason,
  CASE WHEN coalesce(action, '') = '' OR coalesce(section_name, '') = '' THEN 'missing_fields'
       WHEN action NOT IN ('edit', 'add', 'remove') THEN 'invalid_action'
       WHEN action IN ('add', 'remove') AND NOT (learning_rate >= 0.6e0) THEN 'lr_threshold'
       WHEN is_meta THEN 'meta_section'
       WHEN action = 'remove' THEN NULL
       WHEN coalesce(opti_direction, '') = '' THEN 'missing_direction' END AS stage2_reason
FROM pj"""),
    ("s2", "SELECT *, CASE WHEN stage2_reason IS NULL THEN action ELSE 'skip' END AS result_action FROM s1"),
    ("s3", "SELECT *, CASE WHEN result_action IN ('edit', 'add') THEN content END AS rc FROM s2"),
    ("s4", f"""SELECT *,
  (result_action <> 'skip' AND NOT is_meta AND NOT (result_action IN ('add', 'remove') AND NOT (learning_rate >= 0.6e0))
   AND NOT (result_action IN ('edit', 'add') AND (rc IS NULL OR {_strip_rc} = ''))) AS valid,
  CASE WHEN result_action IN ('skip', 'remove') OR result_action IS NULL THEN NULL
       WHEN rc IS NULL OR rc = '' OR {_strip_rc} = 'NO_MODIFICATION' THEN NULL
       WHEN {_new} = '' THEN NULL ELSE {_new} END AS new_content
FROM s3"""),
    ("audit", """SELECT proposal_id, prompt_id, seq, action, section_name, learning_rate, stage1_reason, stage2_reason,
  result_action,
  CASE WHEN result_action IN ('edit', 'add') THEN
    CASE WHEN greatest(0e0, least(1e0, learning_rate / 0.1e0)) > 0.7e0 THEN '大幅度'
         WHEN greatest(0e0, least(1e0, learning_rate / 0.1e0)) > 0.3e0 THEN '适度' ELSE '轻微' END END AS strength,
  learning_rate >= 0.6e0 AS structural_ok, valid, new_content,
  (stage1_reason IS NULL AND valid AND (result_action = 'remove' OR new_content IS NOT NULL)) AS applied
FROM s4"""),
]
APPLIED = AUDIT + [
    ("e", """SELECT a.prompt_id, a.seq, a.result_action AS action, a.section_name, a.new_content AS content FROM audit a
WHERE a.applied AND a.result_action IN ('edit', 'add', 'remove') AND NOT EXISTS (SELECT 1 FROM prompt_sections m
  WHERE m.is_meta AND m.prompt_id = a.prompt_id AND m.section = a.section_name)"""),
    ("hist", """SELECT prompt_id, section_name AS section, arg_max(action, seq) AS last_action,
  arg_max(content, seq) FILTER (WHERE action IN ('edit', 'add')) AS last_content,
  max(seq) FILTER (WHERE action = 'remove') AS last_remove FROM e GROUP BY 1, 2"""),
    ("re", """SELECT e.prompt_id, e.section_name AS section, min(e.seq) AS reinsert FROM e
JOIN hist h ON e.prompt_id = h.prompt_id AND e.section_name = h.section
WHERE e.action IN ('edit', 'add') AND e.seq > coalesce(h.last_remove, -1) GROUP BY 1, 2"""),
    ("h2", "SELECT hist.*, re.reinsert FROM hist LEFT JOIN re USING (prompt_id, section)"),
    ("vers", "SELECT prompt_id, max(version) AS v FROM prompt_sections GROUP BY 1"),
    ("jj", """SELECT coalesce(b.prompt_id, h2.prompt_id) AS prompt_id, coalesce(b.section, h2.section) AS section,
  b.pos, b.content, b.is_meta, h2.last_action, h2.last_content, h2.last_remove, h2.reinsert
FROM prompt_sections b FULL OUTER JOIN h2 ON b.prompt_id = h2.prompt_id AND b.section = h2.section"""),
    ("kk", """SELECT jj.*, vers.v, (pos IS NOT NULL AND last_remove IS NULL) AS in_place FROM jj LEFT JOIN vers USING (prompt_id)
WHERE CASE WHEN last_action IS NULL THEN pos IS NOT NULL ELSE last_action <> 'remove' END"""),
    ("applied", """SELECT prompt_id, CAST(coalesce(v, 0) + 1 AS INTEGER) AS version,
  CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY in_place DESC,
       CASE WHEN in_place THEN CAST(pos AS BIGINT) ELSE reinsert END) AS INTEGER) AS pos,
  section, CASE WHEN last_action IN ('edit', 'add') THEN last_content ELSE content END AS content,
  coalesce(is_meta, false) AS is_meta FROM kk"""),
]
_PF = ["proposals", "prompt_sections"]
Q["proposal_audit"] = sql(_PF, AUDIT, f"""SELECT proposal_id, prompt_id, seq, action, section_name,
  {r('learning_rate', 'learning_rate')}, stage1_reason, stage2_reason, result_action, strength, structural_ok, valid,
  new_content, applied FROM audit""")
Q["clean_section_text"] = sql(_PF, AUDIT, "SELECT proposal_id, new_content FROM audit")
Q["fallback_direction"] = sql(_PF, AUDIT + [
    ("kept", "SELECT prompt_id, count(*) FILTER (WHERE stage1_reason IS NULL) AS n_kept FROM audit GROUP BY 1"),
    ("fe", "SELECT prompt_id, arg_min(section, pos) AS first_editable FROM prompt_sections WHERE NOT is_meta GROUP BY 1"),
    ("st", "SELECT c_custkey AS prompt_id, (c_custkey % 5 - 2) / 10e0 AS mean_error FROM customer"),
    ("fb", """SELECT st.prompt_id, st.mean_error, CAST(coalesce(kept.n_kept, 0) AS BIGINT) AS n_kept, fe.first_editable
FROM st LEFT JOIN kept USING (prompt_id) LEFT JOIN fe USING (prompt_id)""")],
    """SELECT prompt_id, n_kept, n_kept = 0 AS uses_fallback, CASE WHEN n_kept = 0 THEN 'edit' END AS action,
  CASE WHEN n_kept = 0 THEN coalesce(first_editable, 'Scoring Criteria') END AS section_name,
  CASE WHEN n_kept = 0 THEN CASE WHEN mean_error > 0.1e0 THEN '评分标准应该更严格，降低高估倾向'
    WHEN mean_error < -0.1e0 THEN '评分标准应该更宽松，降低低估倾向' ELSE '保持当前评分标准，轻微调整以减少评分波动' END END
    AS opti_direction FROM fb""")
Q["section_classes"] = sql(["prompt_sections"], [], """SELECT prompt_id, version, pos, section, is_meta,
  NOT is_meta AS is_editable FROM prompt_sections""")
Q["section_lookup"] = sql(["prompt_sections"], [], """SELECT o_orderkey AS request_id, o_custkey AS prompt_id, 1 AS version,
  o_orderpriority AS section, s.content, s.section IS NOT NULL AS found
FROM orders LEFT JOIN prompt_sections s ON s.prompt_id = o_custkey AND s.section = o_orderpriority""")
Q["prompt_files"] = sql(["prompt_sections"], [],
                        "SELECT prompt_id, version, pos, section, content, is_meta FROM prompt_sections")
Q["apply_edits"] = sql(_PF, APPLIED, "SELECT prompt_id, version, pos, section, content, is_meta FROM applied")
Q["applied_edit_counts"] = sql(_PF, AUDIT + [
    ("x", """SELECT a.prompt_id, a.seq, a.section_name, a.result_action AS action, m.is_meta,
  arg_max(p.result_action, p.seq) AS before FROM audit a
LEFT JOIN prompt_sections m ON m.prompt_id = a.prompt_id AND m.section = a.section_name
LEFT JOIN audit p ON p.applied AND p.prompt_id = a.prompt_id AND p.section_name = a.section_name AND p.seq < a.seq
  AND p.result_action IN ('edit', 'add', 'remove')
WHERE a.applied GROUP BY ALL""")], """SELECT prompt_id, count(*) AS n_attempted,
  count(*) FILTER (WHERE NOT coalesce(is_meta, false) AND (action IN ('edit', 'add') OR (action = 'remove' AND
    CASE WHEN before IS NULL THEN is_meta IS NOT NULL ELSE before <> 'remove' END))) AS n_applied FROM x GROUP BY 1""")
Q["render_prompt"] = sql(_PF, APPLIED + [
    ("both_versions", """SELECT prompt_id, version, pos, section, content FROM prompt_sections
UNION ALL SELECT prompt_id, version, pos, section, content FROM applied""")],
    f"""SELECT prompt_id, version, string_agg('## ' || section || {NL} || content || {NL}, {NL} ORDER BY pos) AS text,
  count(*) AS n_sections FROM both_versions GROUP BY prompt_id, version""")
Q["section_diff"] = sql(_PF, APPLIED, f"""SELECT coalesce(o.prompt_id, n.prompt_id) AS prompt_id,
  coalesce(o.section, n.section) AS section,
  CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed'
       WHEN o.content <> n.content THEN 'changed' ELSE 'unchanged' END AS status,
  {clip('o.content', 100)} AS old_preview, {clip('n.content', 100)} AS new_preview
FROM prompt_sections o FULL OUTER JOIN applied n ON o.prompt_id = n.prompt_id AND o.section = n.section""")

# ---- version log ---------------------------------------------------------------------------

VERS = ("versions", """SELECT run_id, step, val_loss, val_loss * 0.9e0 AS train_loss, kendall_tau, score_entropy,
  mean_self_consistency_var, ts AS committed_at, repeat(props, CAST(k % 25 AS BIGINT)) AS gradient_summary,
  'lower loss at step ' || CAST(step AS VARCHAR) || ': ' || repeat('ab', CAST(k AS BIGINT)) AS rationale FROM eval_history""")
_msg = (f"concat_ws({NL}, 'Step ' || CAST(step AS VARCHAR) || ': Prompt optimization update', '', "
        f"printf('Train Loss: %.4f', train_loss), printf('Val Loss: %.4f', val_loss), '', 'Metrics:', "
        f"printf('  kendall_tau: %.4f', kendall_tau), printf('  score_entropy: %.4f', score_entropy), "
        f"printf('  mean_self_consistency_var: %.4f', mean_self_consistency_var), '', 'Gradient Summary:', "
        f"{clip('gradient_summary', 200)}, "
        f"CASE WHEN {clip('rationale', 200)} <> '' THEN '' END, "
        f"CASE WHEN {clip('rationale', 200)} <> '' THEN 'Modification Rationale:' END, "
        f"CASE WHEN {clip('rationale', 200)} <> '' THEN {clip('rationale', 200)} END)")
Q["version_log_summary"] = sql(["eval_history"], [VERS], f"""SELECT run_id, step, {r('val_loss', 'val_loss')},
  {clip('gradient_summary', 200)} AS summary_clipped, {clip('rationale', 200)} AS rationale_clipped,
  {_msg} AS message, CAST(length(gradient_summary) AS BIGINT) AS summary_chars FROM versions""")
Q["version_history"] = sql(["eval_history"], [VERS], f"""SELECT run_id, step, {r('val_loss', 'val_loss')},
  CAST(row_number() OVER (PARTITION BY run_id ORDER BY committed_at DESC, step DESC) AS BIGINT) AS recency
FROM versions QUALIFY recency <= 10""")
Q["checkout_version"] = sql(["eval_history"], [VERS,
    ("bb", """SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM versions"""),
    ("tags", """SELECT run_id, 'best' AS tag, step, committed_at AS tagged_at FROM bb
  WHERE best_before IS NULL OR val_loss <= best_before
UNION ALL SELECT run_id, 'stable', step, committed_at FROM versions WHERE run_id % 2 = 0 AND step = 10"""),
    ("t", """SELECT run_id, tag, step FROM tags
QUALIFY row_number() OVER (PARTITION BY run_id, tag ORDER BY tagged_at DESC, step DESC) = 1"""),
    ("req", """SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'stable' END AS req_tag,
  CASE WHEN run_id % 3 = 1 THEN CAST(5 AS BIGINT) END AS req_step FROM (SELECT DISTINCT run_id FROM versions)"""),
    ("res", """SELECT q.run_id,
  CASE WHEN req_tag IS NOT NULL THEN 'tag' WHEN req_step IS NOT NULL THEN 'step' ELSE 'best' END AS resolved_by,
  CASE WHEN req_tag IS NOT NULL THEN tt.step WHEN req_step IS NOT NULL THEN req_step ELSE bt.step END AS step
FROM req q LEFT JOIN t tt ON tt.run_id = q.run_id AND tt.tag = q.req_tag
LEFT JOIN t bt ON bt.run_id = q.run_id AND bt.tag = 'best'""")],
    f"""SELECT res.run_id, resolved_by, CAST(coalesce(res.step, -1) AS BIGINT) AS step,
  CASE WHEN v.run_id IS NULL THEN 'missing' ELSE 'found' END AS status, {r('v.val_loss', 'val_loss')}
FROM res LEFT JOIN versions v ON v.run_id = res.run_id AND v.step = res.step""")

# ---- monitor -------------------------------------------------------------------------------

Q["lr_trace"] = sql(["eval_history"], [
    ("runs", "SELECT run_id, count(*) AS max_steps FROM eval_history GROUP BY 1"),
    ("st", "SELECT run_id, max_steps, unnest(generate_series(1, max_steps)) AS step FROM runs")],
    f"""SELECT run_id, CAST(step AS BIGINT) AS step, {r('''CASE WHEN (step - 1) < 10
  THEN 0.001e0 + (0.1e0 - 0.001e0) * ((step - 1) / 10e0)
  ELSE 0.001e0 + (0.1e0 - 0.001e0) * (0.5e0 * (1e0 + cos(pi() * least(((step - 1) - 10) / CAST(max_steps - 10 AS DOUBLE), 1e0))))
  END''', 'learning_rate')} FROM st""")

Q["eval_cadence"] = sql(["eval_history"], [], f"""SELECT h.run_id, h.step, {r('h.val_loss', 'val_loss')}
FROM eval_history h JOIN (SELECT run_id, max(step) AS last FROM eval_history GROUP BY 1) m USING (run_id)
WHERE h.step % 5 = 0 OR h.step = m.last""")

_W = "PARTITION BY run_id ORDER BY step"
WARN = [
    ("wt", f"""SELECT run_id, step, row_number() OVER ({_W}) AS ci,
  (lag(kendall_tau, 2) OVER ({_W}) + lag(kendall_tau, 1) OVER ({_W}) + kendall_tau) / 3e0 AS r3,
  (lag(kendall_tau, 5) OVER ({_W}) + lag(kendall_tau, 4) OVER ({_W}) + lag(kendall_tau, 3) OVER ({_W})) / 3e0 AS e3
FROM eval_history WHERE kendall_tau IS NOT NULL"""),
    ("wv", f"""SELECT run_id, step,
  count(score_entropy) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS ce,
  last_value(score_entropy IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS le,
  count(mean_self_consistency_var) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS cv,
  last_value(mean_self_consistency_var IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS lv
FROM eval_history"""),
    ("warn", """SELECT wv.run_id, wv.step,
  coalesce(wt.ci > 5 AND wt.r3 < wt.e3 - 0.05e0, false) AS rank_decline,
  coalesce(wv.ce >= 2 AND wv.le < 0.5e0, false) AS entropy_collapse,
  coalesce(wv.cv >= 2 AND wv.lv > 0.1e0, false) AS variance_increase
FROM wv ASOF LEFT JOIN wt ON wv.run_id = wt.run_id AND wv.step >= wt.step"""),
    ("warnings", """SELECT *, CAST(CAST(rank_decline AS INTEGER) + CAST(entropy_collapse AS INTEGER)
  + CAST(variance_increase AS INTEGER) AS BIGINT) AS n_warnings FROM warn"""),
]
Q["degeneration_warnings"] = sql(["eval_history"], WARN, """SELECT run_id, step, rank_decline, entropy_collapse,
  variance_increase, n_warnings FROM warnings""")
_STEPS = [
    ("h0", "SELECT run_id, step, val_loss, CASE WHEN isnan(val_loss) THEN NULL ELSE val_loss END AS l FROM eval_history")]
_STOP = [
    ("c", f"""SELECT *, max(CASE WHEN improved THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS lir,
  max(CASE WHEN improved THEN step END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS bs,
  min(CASE WHEN improved THEN l END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS best_loss FROM b"""),
    ("d", "SELECT c.*, c.rn - coalesce(c.lir, 0) AS counter, w.n_warnings FROM c JOIN warnings w USING (run_id, step)"),
    ("e2", "SELECT *, (counter >= 5 OR n_warnings >= 2) AS stop_now FROM d"),
    ("f", "SELECT run_id, min(step) AS first_stop_step FROM e2 WHERE stop_now GROUP BY 1")]
_TRACE = f"""SELECT e2.run_id, e2.step, {r('e2.val_loss', 'val_loss')}, improved, CAST(coalesce(bs, 0) AS BIGINT) AS best_step,
  {r('best_loss', 'best_loss')}, CAST(counter AS BIGINT) AS counter, stop_now,
  coalesce(e2.step >= f.first_stop_step, false) AS stopped, f.first_stop_step
FROM e2 LEFT JOIN f USING (run_id)"""
Q["early_stop_trace"] = sql(["eval_history"], WARN + _STEPS + [
    ("a", f"""SELECT *, min(l) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb,
  row_number() OVER ({_W}) AS rn FROM h0"""),
    ("b", "SELECT *, (l IS NOT NULL AND (bb IS NULL OR l < bb)) AS improved FROM a")] + _STOP, _TRACE)
Q["stream_monitor"] = sql(["eval_history"], WARN + _STEPS + [
    ("a", f"""SELECT *, min(l) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb,
  row_number() OVER ({_W}) AS rn FROM h0"""),
    ("b", "SELECT *, (l IS NOT NULL AND (bb IS NULL OR l < bb)) AS improved FROM a")] + _STOP + [
    ("trace", _TRACE)], """SELECT t.run_id, t.step, t.val_loss, t.improved, t.best_step, t.best_loss, t.counter,
  w.n_warnings, t.stop_now, t.stopped, false AS late FROM trace t JOIN warnings w USING (run_id, step)""")
# The best loss as a fold over each run's losses in order: element i is the best after row i.
Q["early_stop_min_delta"] = sql(["eval_history"], WARN + _STEPS + [
    ("li", """SELECT run_id, list_prepend(CAST('inf' AS DOUBLE), list(coalesce(l, CAST('inf' AS DOUBLE)) ORDER BY step)) AS ls
  FROM h0 GROUP BY 1"""),
    ("a", f"SELECT *, row_number() OVER ({_W}) AS rn FROM h0"),
    ("bb", """SELECT a.*, list_reduce(ls[1:a.rn], lambda x, y: CASE WHEN y < x - 0.01e0 THEN y ELSE x END) AS best
  FROM a JOIN li USING (run_id)"""),
    ("b", "SELECT *, coalesce(l < best - 0.01e0, false) AS improved FROM bb")] + _STOP, _TRACE)

Q["best_checkpoint"] = sql(["eval_history"], [
    ("m", """SELECT run_id, min(val_loss) AS best_loss FROM eval_history
  WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) GROUP BY 1""")],
    f"""SELECT m.run_id, {r('m.best_loss', 'best_loss')}, max(h.step) AS best_step_latest, min(h.step) AS best_step_earliest
FROM m JOIN eval_history h ON h.run_id = m.run_id AND h.val_loss = m.best_loss GROUP BY m.run_id, m.best_loss""")

Q["daily_score_drift"] = sql(["eval_history"], [
    ("x", "SELECT ts, val_loss AS h, val_loss + (k - 50) / 50e0 AS j FROM eval_history")],
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, {r('avg(j - h)', 'bias')},
  {r('avg(abs(j - h))', 'mae')}, {r('stddev_pop(j)', 'judge_std')} FROM x GROUP BY 1""")

# ---- sources ------------------------------------------------------------------------------

Q["parse_required_fields"] = sql(["raw_scored_rows"], [
    ("st", """SELECT *, CASE WHEN response IS NULL THEN 'missing_response' WHEN score IS NULL THEN 'missing_score'
  WHEN TRY_CAST(score AS DOUBLE) IS NULL THEN 'bad_score' ELSE 'ok' END AS status FROM raw_scored_rows""")],
    f"""SELECT sample_id, coalesce(prompt, '') AS prompt, response,
  {r("CASE WHEN status = 'ok' THEN TRY_CAST(score AS DOUBLE) END", 'score')}, status FROM st""")

Q["scored_files"] = sql(["raw_scored_rows"], [
    ("st", """SELECT coalesce(prompt, '') AS prompt, response, TRY_CAST(score AS DOUBLE) AS score,
  CASE WHEN response IS NULL THEN 'missing_response' WHEN score IS NULL THEN 'missing_score'
  WHEN TRY_CAST(score AS DOUBLE) IS NULL THEN 'bad_score' ELSE 'ok' END AS status FROM raw_scored_rows""")],
    f"""SELECT prompt, response, {r("CASE WHEN status = 'ok' THEN score END", 'score')}, status,
  CASE WHEN status = 'ok' THEN row_number() OVER (PARTITION BY prompt, response, score, status) ELSE 0 END AS copy FROM st""")
Q["run_history"] = sql(["eval_history"], [], f"""SELECT run_id, step,
  {r('CASE WHEN run_id % 2 = 0 THEN val_loss / 2e0 ELSE val_loss END', 'val_loss')} FROM eval_history""")

_uc, _ur, _us = (md5u(repr(s), "CAST(sample_id AS VARCHAR)") for s in ("class", "repeat", "score"))
Q["synthetic_scores"] = sql(["responses"], [
    ("u", f"SELECT sample_id, {_uc} AS uc, {_ur} AS ur, {_us} AS us FROM responses"),
    ("qq", "SELECT *, CASE WHEN uc < 0.2e0 THEN 'low' WHEN uc < 0.2e0 + 0.5e0 THEN 'medium' ELSE 'high' END AS quality FROM u")],
    f"""SELECT sample_id, quality,
  CASE quality WHEN 'low' THEN repeat('Short response. ', CAST(1 + floor(ur * 2e0) AS BIGINT))
    WHEN 'medium' THEN repeat('This is a medium quality response with some detail. ', CAST(2 + floor(ur * 3e0) AS BIGINT))
    ELSE repeat('This is a high quality, comprehensive response with excellent detail and accuracy. ',
                CAST(3 + floor(ur * 3e0) AS BIGINT)) END AS response,
  {r(half_up("CASE quality WHEN 'low' THEN 1e0 + 3e0 * us WHEN 'medium' THEN 4e0 + 3e0 * us ELSE 7e0 + 3e0 * us END", 2), 'score')}
FROM qq""")

ORACLE_SQL: dict[str, str] = dict(Q)

_t1 = strip("reply")
_fence_open = "'^```(?:json)?[" + PY_SPACE + "]*\\n?'"
_fence_close = "'\\n?```[" + PY_SPACE + "]*$'"
_unfenced = (f"CASE WHEN starts_with({_t1}, '```') THEN "
             f"{strip(f'regexp_replace(regexp_replace({_t1}, {_fence_open}, {chr(39) * 2}), {_fence_close}, {chr(39) * 2})')} "
             f"ELSE {_t1} END")
_MODS = '[{"action":"VARCHAR","section_name":"VARCHAR","opti_direction":"VARCHAR"}]'
Q["parse_gradient_replies"] = sql(["gradient_replies"], [
    ("sp", f"""SELECT reply_id, prompt_id,
  CASE WHEN regexp_matches(t, '[{{]') THEN regexp_extract(t, '(?s)[{{].*[}}]', 0) ELSE t END AS j0
FROM (SELECT reply_id, prompt_id, {_unfenced} AS t FROM gradient_replies)"""),
    ("rp", f"""SELECT reply_id, prompt_id, regexp_replace(replace(replace(replace(replace(j0, ': True', ': true'),
  ': False', ': false'), ':True', ':true'), ':False', ':false'), ',([{PY_SPACE}]*[}}\\]])', '\\1', 'g') AS j FROM sp"""),
    ("parsed", f"""SELECT reply_id, prompt_id, CASE WHEN json_valid(j) AND json_type(json_extract(j, '$.modifications')) = 'ARRAY'
  THEN from_json(json_extract(j, '$.modifications'), '{_MODS}') END AS mods FROM rp"""),
    ("ex", "SELECT reply_id, prompt_id, mods, unnest(generate_series(1, len(mods))) AS i FROM parsed WHERE mods IS NOT NULL")],
    """SELECT reply_id, prompt_id, CAST(i - 1 AS BIGINT) AS seq, mods[i].action AS action,
  mods[i].section_name AS section_name, mods[i].opti_direction AS opti_direction FROM ex""")
ORACLE_SQL["parse_gradient_replies"] = Q["parse_gradient_replies"]

# ---- consensus, limits of an update, sketches, bulk scoring, commits --------------------------------

FIXTURES["ratings"] = """
SELECT l_partkey AS sample_id, l_suppkey AS annotator, 1e0 + 9e0 * (l_quantity - 1e0) / 49e0 + (l_suppkey % 7) / 10e0 AS score FROM lineitem"""
_word = lambda off: f"['can', 'should', 'must', 'always'][((conv_id + turn + {off}) % 4 + 1)::INT]"
_body = lambda off: f"'You ' || {_word(off)} || ' reward detail. ' || text"
_old = f"CASE WHEN (conv_id + turn) % 17 <> 0 THEN {_body(0)} END"
_sec = "conv_id AS prompt_id, substr(role, 1, 1) || turn::VARCHAR AS section"
FIXTURES["section_changes"] = f"""
SELECT coalesce(o.prompt_id, n.prompt_id) AS prompt_id, coalesce(o.section, n.section) AS section, o.content AS oc, n.content AS nc,
  CASE WHEN o.here IS NULL THEN 'added' WHEN n.here IS NULL THEN 'removed' WHEN o.content IS DISTINCT FROM n.content THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT {_sec}, {_old} AS content, 1 AS here FROM conversations WHERE role = 'assistant') o
FULL JOIN (SELECT {_sec}, CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN {_old} WHEN 1 THEN {_body(2)}
             WHEN 2 THEN {_body(0)} || ' Scores MUST always follow the scale.' WHEN 4 THEN {_body(0)} || repeat(' Be strict.', (conv_id % 30)::INT) END AS content, 1 AS here
           FROM conversations WHERE (conv_id * 7 + turn) % 6 <> 3 AND (role = 'assistant' OR turn % 3 = 0)) n
  ON o.prompt_id = n.prompt_id AND o.section = n.section"""


def fit_ctes(rounds: int) -> list[tuple[str, str]]:
    """Alternating means, ``rounds`` times: CTEs ``c`` (cells), ``s{i}`` (effects), ``b{i}`` (biases)."""
    out = [("c", "SELECT sample_id, annotator, sum(score) AS total, count(*)::DOUBLE AS weight FROM ratings GROUP BY ALL"),
           ("b0", "SELECT annotator, sum(weight) AS weight, 0e0 AS bias FROM c GROUP BY annotator")]
    for i in range(1, rounds + 1):
        out += [(f"s{i}", f"SELECT sample_id, sum(total - c.weight * bias) / sum(c.weight) AS effect FROM c JOIN b{i - 1} USING (annotator) GROUP BY sample_id"),
                (f"r{i}", f"SELECT annotator, sum(weight) AS weight, sum(total - weight * effect) / sum(weight) AS b FROM c JOIN s{i} USING (sample_id) GROUP BY annotator"),
                (f"b{i}", f"SELECT annotator, weight, b - (SELECT sum(weight * b) / sum(weight) FROM r{i}) AS bias FROM r{i}")]
    out = [(n, body) for n, body in out]
    return out + [("s", f"SELECT sample_id, sum(total - c.weight * bias) / sum(c.weight) AS effect FROM c JOIN b{rounds} USING (annotator) GROUP BY sample_id")]


_ROUNDS = 14
ORACLE_SQL["human_consensus"] = sql(["ratings"], fit_ctes(_ROUNDS) + [
    ("m", "SELECT *, total / weight AS mv, round(total / weight, 9) AS v FROM c"),
    ("p", """SELECT sample_id, CASE WHEN count(*) OVER (PARTITION BY annotator) > 1
  THEN (rank() OVER (PARTITION BY annotator ORDER BY v) - 1 + (count(*) OVER (PARTITION BY annotator, v) - 1) / 2e0)
       / (count(*) OVER (PARTITION BY annotator) - 1) ELSE 0.5e0 END AS place FROM m"""),
    ("bo", "SELECT sample_id, avg(place) AS borda FROM p GROUP BY sample_id")],
    f"""SELECT m.sample_id, sum(weight)::BIGINT AS n_ratings, count(*) AS n_annotators, {r('sum(total) / sum(weight)', 'mean_score')},
  {r('stddev_pop(mv)', 'annotator_spread')}, {r('any_value(borda)', 'borda')}, round(any_value(effect), 4) AS fitted_score
FROM m JOIN bo USING (sample_id) JOIN s USING (sample_id) GROUP BY m.sample_id""")
ORACLE_SQL["annotator_bias"] = sql(["ratings"], fit_ctes(_ROUNDS), f"""SELECT annotator, sum(c.weight)::BIGINT AS n_ratings,
  round(any_value(bias), 4) AS bias, round(sqrt(sum(c.weight * (total / c.weight - effect - bias) ** 2) / sum(c.weight)), 4) AS residual
FROM c JOIN s USING (sample_id) JOIN b{_ROUNDS} USING (annotator) GROUP BY annotator""")

ORACLE_SQL["edit_audit"] = sql(["section_changes"], [
    ("t", "SELECT prompt_id, section, status, coalesce(oc, '') AS a, coalesce(nc, '') AS b FROM section_changes WHERE status <> 'unchanged'"),
    ("dd", """SELECT *, CASE WHEN a = '' THEN length(b) WHEN b = '' THEN length(a) ELSE levenshtein(a, b) END AS dist,
  CASE WHEN prompt_id % 13 = 0 THEN 0 ELSE floor(200e0 * least(1e0, (prompt_id % 11) / 10e0 / 1e0))::INT END AS char_limit,
  row_number() OVER (PARTITION BY prompt_id ORDER BY section)::INT AS section_no FROM t""")],
    """SELECT prompt_id, section, status, char_limit, CASE WHEN dist <= char_limit THEN dist::INT END AS chars_changed, section_no,
  CASE WHEN section_no > 1 THEN 'too_many_sections' WHEN dist > char_limit THEN 'too_long' ELSE 'ok' END AS verdict FROM dd""")

_count = lambda col, w: f"len(list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w = '{w}'))"
_modal = ("can", "should", "must", "always")
ORACLE_SQL["modal_strength"] = sql(["section_changes"], [
    ("t", "SELECT prompt_id, section, status, " + ", ".join(f"{_count(c, w)} AS {c}{i}" for c in ("oc", "nc") for i, w in enumerate(_modal, 1))
     + " FROM section_changes WHERE status <> 'unchanged'")],
    """SELECT prompt_id, section, status, oc1 + 2 * oc2 + 3 * oc3 + 4 * oc4 AS old_strength, nc1 + 2 * nc2 + 3 * nc3 + 4 * nc4 AS new_strength,
  (nc1 + 2 * nc2 + 3 * nc3 + 4 * nc4) - (oc1 + 2 * oc2 + 3 * oc3 + 4 * oc4) AS rise,
  CASE WHEN oc4 > 0 THEN 4 WHEN oc3 > 0 THEN 3 WHEN oc2 > 0 THEN 2 WHEN oc1 > 0 THEN 1 ELSE 0 END AS old_level,
  CASE WHEN nc4 > 0 THEN 4 WHEN nc3 > 0 THEN 3 WHEN nc2 > 0 THEN 2 WHEN nc1 > 0 THEN 1 ELSE 0 END AS new_level,
  nc1 + nc2 < oc1 + oc2 AND nc3 + nc4 > oc3 + oc4 AS soft_to_hard FROM t""")

ORACLE_SQL["hash_split"] = sql(["strata_samples"], [], f"""SELECT sample_id, {r('human_score', 'human_score')},
  CASE WHEN {md5u("'42'", "CAST(sample_id AS VARCHAR)")} < 0.2e0 THEN 'val' ELSE 'train' END AS split FROM strata_samples""")
ORACLE_SQL["strata_sketch"] = sql(["eval_history"], [], """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, true AS low_within, true AS high_within
FROM eval_history WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) GROUP BY ALL""")

_roll = sql(["judged_docs"], [
    ("x", """SELECT coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang, 0::BIGINT AS grouping_level, human_score, judge_score FROM judged_docs
UNION ALL SELECT coalesce(source, '<null>'), '<all>', 1, human_score, judge_score FROM judged_docs
UNION ALL SELECT '<all>', '<all>', 3, human_score, judge_score FROM judged_docs""")]
    + pair_ctes("x", ["source", "lang", "grouping_level"], "q") + spearman_ctes("x", ["source", "lang", "grouping_level"], "w"),
    f"""SELECT CASE WHEN q.source NOT IN ('<all>', '<null>') THEN q.source END AS source, CASE WHEN q.lang NOT IN ('<all>', '<null>') THEN q.lang END AS lang,
  q.grouping_level, q.n, {r('kendall_tau', 'kendall_tau')}, {r('kendall_tau_loss', 'kendall_tau_loss')}, clear_pairs, {r('pairwise_loss', 'pairwise_loss')},
  {r('spearman_rho', 'spearman_rho')}, {r('spearman_loss', 'spearman_loss')} FROM q_pm q JOIN w_sp w USING (source, lang, grouping_level)""")
ORACLE_SQL["rank_statistics_rollup"] = _roll

ORACLE_SQL["contraction_loss"] = sql(["judged_versions"], pair_ctes("judged_versions", G, "q") + [
    ("ms", f"""SELECT {GK}, avg(abs(judge_score - human_score)) AS mae, stddev_pop(judge_score) AS js, stddev_pop(human_score) AS hs
FROM judged_versions GROUP BY ALL"""),
    ("z", f"SELECT ms.*, kendall_tau_loss, CASE WHEN hs > 0 THEN greatest(0e0, 1e0 - js / hs) ELSE 0e0 END AS con FROM ms JOIN q_pm USING ({GK})")],
    f"""SELECT {GK}, 'kendall' AS loss_type, {r('mae + kendall_tau_loss + 0.5e0 * con', 'total_loss')}, {r('mae', 'mae_component')},
  {r('kendall_tau_loss', 'rank_loss_component')}, {r('con', 'contraction')} FROM z""")

ORACLE_SQL["stratum_ranking_loss"] = sql(["pair_scores"], [
    ("th", "SELECT group_id, quantile_cont(human_score, 0.25) AS lo, quantile_cont(human_score, 0.75) AS hi FROM pair_scores GROUP BY group_id"),
    ("x", """SELECT group_id, CASE WHEN human_score >= hi THEN 'high' WHEN human_score <= lo THEN 'low' ELSE 'mid' END AS stratum, human_score, judge_score
FROM pair_scores JOIN th USING (group_id)"""),
    ("y", "SELECT * FROM x WHERE stratum <> 'mid'")] + pair_ctes("y", ["group_id", "stratum"], "q"),
    f"SELECT group_id, stratum, n, clear_pairs, {r('pairwise_loss', 'pairwise_loss')} FROM q_pm")

ORACLE_SQL["bulk_scores"] = sql(["responses"], [("t", "SELECT sample_id, length(coalesce(response, '')) AS len FROM responses")],
    f"""SELECT sample_id, {r('CASE WHEN len % 5 IN (1, 3, 4) THEN len / 10e0 END', 'judge_score')},
  CASE len % 5 WHEN 0 THEN 'failed' WHEN 2 THEN 'no_score' ELSE 'ok' END AS status,
  CASE WHEN len % 5 = 0 THEN 'ValueError: no verdict on ' || len::VARCHAR || ' characters' END AS reason,
  CASE len % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS n_attempts FROM t""")
ORACLE_SQL["version_commits"] = sql(["eval_history"], [], f"SELECT run_id, step, {r('val_loss', 'val_loss')}, 0::BIGINT AS repeated FROM eval_history")

ORACLE_SQL["stream_drift"] = sql(["eval_history"], [
    ("x", """SELECT ts, val_loss AS h, val_loss + (k - 50) / 50e0 AS j, coalesce(k % 10 = 0 AND ts < TIMESTAMP '2024-01-06', false) AS late FROM eval_history"""),
    ("closed", "SELECT max(ts) - INTERVAL 2 DAY AS mark FROM x WHERE NOT late")],
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (NOT late) AS n, {r('avg(j - h) FILTER (NOT late)', 'bias')},
  {r('avg(abs(j - h)) FILTER (NOT late)', 'mae')}, {r('stddev_pop(j) FILTER (NOT late)', 'judge_std')}, count(*) FILTER (late) AS late_rows
FROM x, closed GROUP BY 1 HAVING count(*) FILTER (NOT late) > 0 AND date_trunc('day', min(ts)) + INTERVAL 1 DAY <= any_value(mark)""")

ORACLE_SQL["prompt_version_pairs"] = sql(["judged_versions"], [
    ("cmp", """SELECT a.source, a.sample_id, a.judge_score AS sa, b.judge_score AS sb, abs(a.judge_score - a.human_score) AS ea, abs(b.judge_score - a.human_score) AS eb
FROM judged_versions a JOIN judged_versions b ON a.source IS NOT DISTINCT FROM b.source AND a.sample_id = b.sample_id
WHERE a.prompt_version = 1 AND b.prompt_version = 2""")],
    f"""SELECT source, sample_id, {r('sa', 'score_a')}, {r('sb', 'score_b')}, {r('ea', 'abs_error_a')}, {r('eb', 'abs_error_b')}, {r('eb - ea', 'abs_error_delta')},
  CASE WHEN eb < ea THEN 'better' WHEN eb = ea THEN 'same' ELSE 'worse' END AS outcome FROM cmp""")

_ul = md5u("'line'", "sample_id")
ORACLE_SQL["mapped_fields"] = sql(["raw_scored_rows"], [
    ("st", f"""SELECT *, CASE WHEN {_ul} < 0.1e0 THEN 'corrupt' WHEN response IS NULL THEN 'missing_response' WHEN score IS NULL THEN 'missing_score'
  WHEN TRY_CAST(score AS DOUBLE) IS NULL THEN 'bad_score' ELSE 'ok' END AS status FROM raw_scored_rows""")],
    f"""SELECT CASE WHEN status = 'corrupt' THEN '' ELSE coalesce(prompt, '') END AS prompt, CASE WHEN status <> 'corrupt' THEN response END AS response,
  {r("CASE WHEN status = 'ok' THEN CAST(score AS DOUBLE) END", 'score')}, status FROM st""")
