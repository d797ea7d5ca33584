"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .hard_negatives import op12_hard_negatives
from .html_text import op10_html_text
from .licenses import op1_license_scan
from .mixing import op7_mix_sources
from .near_vectors import op4_near_vectors
from .oracle import NEGATIVES_SQL, REPEATS_SQL, TURNS_SQL
from .pieces import op3_sentencepiece
from .quality_rules import op2_quality_rules
from .repeat_trees import op11_repeat_trees
from .simhash import op8_simhash_near_dedup
from .suffix_dedup import op6_suffix_dedup
from .turn_repair import op13_turn_repair
from .warc import op5_warc
from .weak_labels import op9_weak_label_quality

QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_rules, op3_sentencepiece, op4_near_vectors, op5_warc, op6_suffix_dedup, op7_mix_sources,
    op8_simhash_near_dedup, op9_weak_label_quality, op10_html_text, op11_repeat_trees, op12_hard_negatives, op13_turn_repair)}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mixing_sql(docs: str) -> str:
    """SELECT for the mix (weights 3, 1, 2; 150 %; at most twice) over the relation ``docs``."""
    levels = ""
    state = "goal0"
    for level in range(3):
        s = 12 * (2 - level)
        levels += f""",
sums{level} AS (
  SELECT slim.source, slim.h >> {s} AS bucket, sum(slim.size) AS words
  FROM slim JOIN {state} g ON slim.source IS NOT DISTINCT FROM g.source AND (slim.h >> {s + 12}) = g.prefix
  GROUP BY ALL),
run{level} AS (
  SELECT source, bucket, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM sums{level}),
found{level} AS (
  SELECT r.source, max_by(struct_pack(bucket := r.bucket, start := g.below + r.lower, words := r.words), r.bucket) AS m
  FROM run{level} r JOIN {state} g ON r.source IS NOT DISTINCT FROM g.source
  WHERE g.below + r.lower <= g.need GROUP BY r.source),
goal{level + 1} AS (
  SELECT g.source, g.source_size, g.target, g.whole, g.need, coalesce(f.m.bucket, g.prefix << 12) AS prefix,
         coalesce(f.m.start, g.below) AS below, coalesce(f.m.words, 0) AS words
  FROM {state} g LEFT JOIN found{level} f ON g.source IS NOT DISTINCT FROM f.source)"""
        state = f"goal{level + 1}"
    return rf"""
WITH slim AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 9) AS BIGINT) AS h
  FROM {docs}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sizes),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight FROM named),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, k) AS pos,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER before, 0) AS size_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parts AS (
  SELECT *, 1.5e0 * total - 2e0 * CAST(size_before AS DOUBLE) AS left_words, weights - weight_before AS left_weight FROM ordered),
fits AS (
  SELECT arg_min(struct_pack(pos := pos, w := left_words, g := left_weight), pos) AS f FROM parts
  WHERE left_words * weight / left_weight <= 2e0 * source_size),
goals AS (
  SELECT source, source_size, CASE WHEN pos >= f.pos THEN f.w * weight / f.g ELSE 2e0 * CAST(source_size AS DOUBLE) END AS target
  FROM parts LEFT JOIN fits ON true),
goal0 AS (
  SELECT *, target - whole * source_size AS need, CAST(0 AS BIGINT) AS prefix, 0e0 AS below FROM (
    SELECT *, CAST(least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 2) AS BIGINT) AS whole FROM goals)){levels}
SELECT doc_id, size, source_size, target, size * n AS taken, n AS repeats FROM (
  SELECT slim.*, g.source_size, g.target, least(g.whole + CAST(slim.h < CASE
         WHEN g.need - g.below >= g.below + g.words - g.need THEN g.prefix + 1 ELSE g.prefix END AS BIGINT), 2) AS n
  FROM slim JOIN goal3 g ON slim.source IS NOT DISTINCT FROM g.source)
"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
t AS (SELECT hex, max(page_id) AS top FROM d GROUP BY hex),
x AS (
  SELECT d.page_id, d.payload_bytes, d.hex, t.top, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4),
         lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(d.hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31) + 1 AS INT), 1)),
         'string_agg', '')), 'string_agg', '') AS b32
  FROM d JOIN t USING (hex))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM x
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98e0),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""

SUFFIX_SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(n - 49)) AS i, h FROM d WHERE n >= 50),
g AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS INT), 100)) AS s FROM w),
m AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
c AS (SELECT DISTINCT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.first_id < g.doc_id),
gap AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM c),
run AS (SELECT *, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gap),
span AS (SELECT doc_id, k, min(i) AS low, max(i) + 50 AS high FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS from_at FROM span),
kept AS (
  SELECT d.doc_id, string_agg(substr(d.h, CAST(2 * p.from_at + 1 AS INT), CAST(2 * (p.low - p.from_at) AS INT)), '' ORDER BY p.low)
         || substr(any_value(d.h), CAST(2 * max(p.high) + 1 AS INT)) AS h,
         sum(p.high - p.low) AS n_removed, count(*) AS n_spans
  FROM piece p JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

ORACLE_SQL = {"op4_near_vectors": VECTORS_SQL, "op5_warc": WARC_SQL, "op6_suffix_dedup": SUFFIX_SQL,
              "op7_mix_sources": mixing_sql("documents"), "op11_repeat_trees": REPEATS_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_turn_repair": TURNS_SQL}
