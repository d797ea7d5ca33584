"""DuckDB SQL for the operators on word windows, hard negatives and turns."""

from __future__ import annotations

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score,
       s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


def _way(cost: str, audit: str, given: str) -> str:
    return f"struct_pack(c := {cost}, a := {audit}, t := {given})"


_NO_WAY = _way("CAST(1000000000 AS BIGINT)", "'Z'", "''")


def _turn(state: str, text: str) -> str:
    return rf"{state}.t || chr(10) || {text}"


def _inserted(p: str) -> list[str]:
    """The four states p0 to p3 (given: nothing, s, an a last, a u last) after insertions of up to two turns."""
    one = lambda s, role: _way(f"{s}.c + 2", f"{s}.a || 'I'", _turn(s, f"'{role}:'"))
    two = lambda s: _way(f"{s}.c + 4", f"{s}.a || 'II'", _turn(s, "'user:'") + " || chr(10) || 'assistant:'")
    s0, s1, s2, s3 = (f"{p}{k}" for k in range(4))
    return [s0, s1, f"list_min([{s2}, {one(s3, 'assistant')}, {two(s0)}, {two(s1)}])",
            f"list_min([{s3}, {one(s0, 'user')}, {one(s1, 'user')}, {one(s2, 'user')}])"]


def _gone(s: str) -> str:
    return _way(f"{s}.c + 3", f"{s}.a || 'D'", f"{s}.t")


def _kept(s: str, initial: str) -> str:
    return f"CASE WHEN stays AND ini = '{initial}' THEN {_way(f'{s}.c + late', f'''{s}.a || 'K' ''', _turn(s, 'line'))} ELSE {_NO_WAY} END"


def _turned(s: str, role: str) -> str:
    return f"CASE WHEN stays THEN {_way(f'{s}.c + 2 + late', f'''{s}.a || 'R' ''', _turn(s, f'''{role!r} || ':' || text'''))} ELSE {_NO_WAY} END"


_TO_U = ", ".join(f"{_kept(s, 'u')}, {_turned(s, 'user')}" for s in ("q0", "q1", "q2"))

#: Cheapest edits as a shortest path over what has been given; the smaller audit of equal costs.
TURNS_SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
crc AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2),
         lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
         lambda c, b: xor(c >> 8, tab.t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) % 20 AS d FROM named, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE d <> 0),
placed AS (
  SELECT *, md5(CAST(len(role) AS VARCHAR) || ':' || role || text) AS key,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
faults AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER w AS i, left(lag(role) OVER w, 1) || left(role, 1) AS pair,
         CASE WHEN bare = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, key ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, copy)),
ready AS (
  SELECT conv_id, i, ini, text, role || ':' || text AS line, fault NOT IN ('blank', 'duplicate') AS stays,
         CAST(fault = 'truncated' AS BIGINT) AS late FROM faults),
step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {_way("CAST(0 AS BIGINT)", "''", "''")} AS p0, {_NO_WAY} AS p1, {_NO_WAY} AS p2, {_NO_WAY} AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_gone("q0")}, list_min([{_gone("q1")}, {_kept("q0", "s")}]),
         list_min([{_gone("q2")}, {_kept("q3", "a")}, {_turned("q3", "assistant")}]), list_min([{_gone("q3")}, {_TO_U}])
  FROM (SELECT r.*, {", ".join(f"{x} AS q{k}" for k, x in enumerate(_inserted("s.p")))}
        FROM step s JOIN ready r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1)),
ends AS (
  SELECT conv_id, list_min([p0, {_inserted("p")[2]}]) AS best FROM step
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(substr(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""

#: Windows of 35 words that start in two places or more.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(CAST(len(w) - 34 AS BIGINT))) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 35), ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i + 1, i + 36)) AS k FROM r),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY k) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
