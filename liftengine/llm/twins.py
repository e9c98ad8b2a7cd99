"""DuckDB SQL for those operators' queries that SQL can express."""

from __future__ import annotations

#: Fixed values of the line rules, written out apart from the operator's.
_PHRASES = (
    "all rights reserved", "click here", "cookie policy", "cookies", "enable javascript",
    "follow us on", "licensed under", "lorem ipsum", "privacy policy", "read more",
    "sign up", "subscribe to", "terms of service", "terms of use",
)
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '{_WORD}') AS w FROM documents),
words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM found),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN n >= 3 THEN w || ' ' || w2 || ' ' || w3
    ELSE concat_ws(' ', w, w2, w3) END AS g
  FROM (SELECT doc_id, i, n, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words
        WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE i <= greatest(n - 2, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
sized AS (SELECT g.doc_id, g.g, s.n FROM grams g JOIN sizes s ON g.doc_id = s.doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)
  UNION ALL SELECT b, a FROM pairs WHERE 100 * common >= 90 * (na + nb - common)),
reached AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM reached r JOIN links l ON r.doc_id = l.a)
SELECT r.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM reached r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id
"""

QUALITY = rf"""
WITH found AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM documents),
words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM found),
eights AS (
  SELECT doc_id, i, {" || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, 8))])} AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(g)) AS n
  FROM eights WHERE g IS NOT NULL),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, min(k) AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM found)
  GROUP BY doc_id, line),
entries AS (
  SELECT doc_id, line, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM found)
  WHERE len(regexp_extract_all(line, '{_WORD}')) <= 3
    AND NOT regexp_matches(line, '[.!?…。！？,;:]["''”’»)\]]*[\x20\x09-\x0D]*\z')),
menus AS (
  SELECT DISTINCT e.doc_id, e.line FROM entries e JOIN (
    SELECT doc_id, run FROM entries GROUP BY doc_id, run HAVING count(*) >= 5) r
  ON e.doc_id = r.doc_id AND e.run = r.run),
judged AS (
  SELECT doc_id, line, k, regexp_extract_all(line, '{_WORD}') AS w,
    (length(line) - length(translate(line, '#*$%&|<>', ''))) / 3.0
      + (length(line) - length(replace(line, '!!', ''))) / 2.0 AS symbols,
    {" + ".join(f"{len(p.split())} * CAST(contains(lower(line), '{p}') AS INT)" for p in _PHRASES)}
      AS boilerplate
  FROM lines),
good AS (
  SELECT doc_id, count(*) AS n, sum(length(line)) AS size,
    string_agg(line, chr(10) ORDER BY k) AS clean
  FROM judged
  WHERE (doc_id, line) NOT IN (SELECT doc_id, line FROM menus)
    AND NOT (symbols > 0.3 * len(w) OR boilerplate > 0.1 * len(w)
    OR len(list_filter(w, lambda x: x IN ('|', '>', '»', '›', '•', '·'))) > 0.2 * len(w)
    OR (len(w) >= 5 AND len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2])) > 0.2 * len(w))
    OR (len(w) >= 12 AND NOT regexp_matches(line, '[.!?…。！？]["''”’»)\]]*(\s|$)')))
  GROUP BY doc_id),
measured AS (
  SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
      AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) - coalesce(g.n, 0) AS BIGINT) AS n_lost_lines,
    coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS size,
    coalesce(g.size, 0) AS kept_size, coalesce(g.clean, '') AS clean
  FROM found f LEFT JOIN repeats r ON f.doc_id = r.doc_id LEFT JOIN good g ON f.doc_id = g.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_size >= 0.5 * size) AS kept,
  n_lost_lines, sha256(clean) AS clean_sha256
FROM measured
"""


_FAR = """
far{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x)) AS d
  FROM parts p JOIN book{r} c ON p.part = c.part AND p.pos = c.pos GROUP BY ALL),
near{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM far{r} GROUP BY vec_id, part)"""
_MEAN = """
sum{r} AS (
  SELECT p.part, n.entry, p.pos, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n
  FROM parts p JOIN near{r} n ON p.vec_id = n.vec_id AND p.part = n.part GROUP BY ALL),
book{after} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, CASE WHEN s.n IS NULL THEN b.x
    ELSE (s.s - (s.s % s.n + s.n) % s.n) // s.n END AS x
  FROM book{r} b LEFT JOIN sum{r} s ON b.part = s.part AND b.entry = s.entry AND b.pos = s.pos)"""
_LAST = 6

VECTORS = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding,
    lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS pos,
    CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (
  SELECT p.part, f.entry, p.pos, p.x FROM parts p JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry
    FROM kept ORDER BY vec_id LIMIT 16) f ON p.vec_id = f.vec_id),
""" + ",".join(_FAR.format(r=r) + "," + _MEAN.format(r=r, after=r + 1) for r in range(_LAST)) + (
    "," + _FAR.format(r=_LAST)) + f""",
hashed AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM book{_LAST}),
coded AS (
  SELECT k.vec_id, any_value(k.label) AS label,
    string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code,
    CAST(sum(n.d) AS BIGINT) AS error
  FROM kept k JOIN near{_LAST} n ON k.vec_id = n.vec_id GROUP BY k.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  h AS codebooks_sha256 FROM coded, hashed
"""


def all_sql() -> dict[str, str]:
    return {"op5_jaccard": JACCARD, "op10_quality": QUALITY, "op13_vector_codes": VECTORS}
