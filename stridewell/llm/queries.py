"""The registered queries of this subpackage, and SQL where it can express one."""

from __future__ import annotations


from .filter_audit import op11_filter_audit
from .hard_negatives import op13_hard_negatives
from .host_rules import op10_host_rules
from .byte_bpe import op7_byte_bpe
from .html_main import op9_html_main
from .lattice_dedup import op12_lattice_dedup
from .mil_quality import op6_mil_quality
from .minhash_dedup import op2_minhash_dedup
from .packing import op3_packing
from .secrets import op1_secrets
from .spotsigs import op8_spotsigs
from .toxicity import op5_toxicity
from .warc import op4_warc

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_mil_quality": op6_mil_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_spotsigs": op8_spotsigs,
    "op9_html_main": op9_html_main,
    "op10_host_rules": op10_host_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_lattice_dedup": op12_lattice_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL over whole tables.
ORACLE_SQL: dict[str, str] = {}

HOST_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
base AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, hash(x, lead(x) OVER o, lead(x, 2) OVER o) AS h, lead(i, 2) OVER o IS NOT NULL AS whole FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, h) > 1 AS twice FROM g WHERE whole),
k AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM c, (VALUES (0), (1), (2)) t(k) WHERE twice GROUP BY r),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT source, count(*) AS n, sum(m.base_failed::INT) AS x FROM documents JOIN b m USING (doc_id) GROUP BY source),
z AS (SELECT sum(x) / sum(n) AS m, var_pop(CASE WHEN n >= 2 THEN x / n END) AS v FROM s),
q AS (SELECT m, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(1.0, m * (1 - m) / v - 1) END AS t FROM z),
a AS (SELECT coalesce(m * t, 1.0) AS a, coalesce((1 - m) * t, 1.0) AS b FROM q),
y AS (SELECT source, (x + a) / (n + a + b) AS r, n + a + b AS u, m FROM s, a, z),
h AS (SELECT source, r - 2.0 * sqrt(r * (1 - r) / (u + 1)) > greatest(0.5, 2.0 * m) AS refused FROM y)
SELECT b.*, NOT base_failed AND NOT coalesce(refused, false) AS kept
FROM b JOIN documents d USING (doc_id) LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source
"""
ORACLE_SQL["op10_host_rules"] = HOST_RULES_SQL


FILTER_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(generate_series(1, 5)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, i AS step, o[i] AS own FROM o, x),
t AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here,
    len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS alone
  FROM p, s),
g AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
ORACLE_SQL["op11_filter_audit"] = FILTER_AUDIT_SQL

LATTICE_DEDUP_SQL = r"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
l AS (
  SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) >= 0.93 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
w(a, b) AS (SELECT r, r FROM e UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
c AS (SELECT w.a AS r, min(e.vec_id) AS component_id FROM w JOIN e ON w.b = e.r GROUP BY w.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c USING (r) LEFT JOIN n USING (r)
"""
ORACLE_SQL["op12_lattice_dedup"] = LATTICE_DEDUP_SQL

HARD_NEGATIVES_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
p AS (SELECT a, anchor_id, b, id AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s DESC, id)::INT AS rank, id AS negative_id, positive_score, s AS negative_score
FROM p JOIN s USING (a, anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s DESC, id) <= 3
"""
ORACLE_SQL["op13_hard_negatives"] = HARD_NEGATIVES_SQL
