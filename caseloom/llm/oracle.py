"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from caseloom.llm import quality_rules

#: Null conversations are told apart by ``IS NOT DISTINCT FROM``; states are 0 start, 1 system, 2 user, 3 assistant.
TURN_REPAIR = r"""
WITH RECURSIVE
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i) x),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s
  FROM conversations),
marked AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295, list_reduce(
           [4294967295] || list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS INT), 1)) AS BIGINT)),
           lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS INT)], c >> 8))) % 20 AS k
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM marked WHERE k <> 0) x),
lined AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
judged AS (
  SELECT *,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair
  FROM lined
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
rows_ AS (
  SELECT *, substr(role, 1, 1) AS initial, blank OR again AS gone, cut AND NOT blank AND NOT again AS trunc FROM judged),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
inserts(a, b, n, added) AS (VALUES
  (0, 0, 0, ''), (0, 2, 1, chr(10) || 'user:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, ''), (1, 2, 1, chr(10) || 'user:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, ''), (2, 3, 1, chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:'),
  (3, 3, 0, ''), (3, 2, 1, chr(10) || 'user:'), (3, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(edit, a, b, initial, named, paid) AS (VALUES
  ('D', 0, 0, NULL, NULL, 2), ('D', 1, 1, NULL, NULL, 2), ('D', 2, 2, NULL, NULL, 2), ('D', 3, 3, NULL, NULL, 2),
  ('K', 0, 1, 's', NULL, 0), ('K', 0, 2, 'u', NULL, 0), ('K', 1, 2, 'u', NULL, 0), ('K', 2, 3, 'a', NULL, 0), ('K', 3, 2, 'u', NULL, 0),
  ('R', 0, 2, NULL, 'user', 1), ('R', 1, 2, NULL, 'user', 1), ('R', 2, 3, NULL, 'assistant', 1), ('R', 3, 2, NULL, 'user', 1)),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.b,
         min({'cost': p.best.cost + 5 * s.n + e.paid + CASE WHEN r.trunc AND e.edit <> 'D' THEN 5 ELSE 0 END,
              'audit': p.best.audit || repeat('I', s.n) || e.edit,
              'said': p.best.said || s.added || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || coalesce(e.named, r.role) || ':' || r.text END})
  FROM paths p
  JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
  JOIN inserts s ON s.a = p.state
  JOIN edits e ON e.a = s.b AND (e.edit = 'D' OR NOT r.gone) AND (e.initial IS NULL OR e.initial = r.initial)
  GROUP BY p.conv_id, p.i, e.b),
ended AS (
  SELECT p.conv_id,
         min({'cost': p.best.cost + 5 * s.n, 'audit': p.best.audit || repeat('I', s.n), 'said': p.best.said || s.added}) AS best
  FROM paths p
  JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
  JOIN inserts s ON s.a = p.state AND s.b IN (0, 3)
  GROUP BY p.conv_id)
SELECT d.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def _vector_codes(rounds: int = 6) -> str:
    """Rounds written out one after the other; a quotient is floored also below zero."""
    nearest = """
near{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x,
         min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY vec_id, p)"""
    moved = """
means{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n
        FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM near{k}) y GROUP BY ALL) z
  GROUP BY p, e),
book{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)"""
    steps = "".join(nearest.format(k=k) + "," + moved.format(k=k, n=k + 1) + "," for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, (SELECT unnest(range(8)) AS p) q),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),{steps}
{nearest.format(k=rounds)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) AS digest FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


def _quality_rules() -> str:
    """Base counts and the threshold table; a window is its words with a space between."""
    word = r"[^\x20\x09-\x0D]"
    limits = []
    for r in quality_rules.RULES:
        top, bottom = r.metric.split(" / ")
        value = f"CASE WHEN n_words > 0 THEN CAST({top} AS DOUBLE) / {bottom} ELSE 0 END"
        sides = [f"{value} < {r.low}::DOUBLE"] * (r.low is not None) + [f"{value} > {r.high}::DOUBLE"] * (r.high is not None)
        limits.append(f"(n_words >= {r.min_words} AND ({' OR '.join(sides)}))")
    around = quality_rules.AROUND.replace("'", "''")
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines
  FROM documents),
grams AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM cut) x),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) x WHERE n > 1),
hit AS (
  SELECT r, CAST(sum(least(5, coalesce(i - before, 5))) AS BIGINT) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice) x GROUP BY r),
counts AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda w: trim(translate(w, '{quality_rules.UPPER}', '{quality_rules.LOWER}'), '{around}') IN ({stop}))) AS n_stop_words
  FROM cut LEFT JOIN hit USING (r)),
based AS (SELECT *, {quality_rules.BASE} AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(limits)}) AS kept
FROM based
"""


SQL: dict[str, str] = {"op8_quality_rules": _quality_rules(), "op12_vector_codes": _vector_codes(), "op13_turn_repair": TURN_REPAIR}
