"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from trackledger.llm import codes, lines, phrases, urls

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _rule_case(value: str) -> str:
    ranked = sorted(urls.RULES, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r[0] + r[1]))
    cases = []
    for host, path, verdict in ranked:
        out = f"{host}/{path}" if value == "rule" else verdict
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases.append(f"WHEN {fits} THEN '{out}'")
    return "CASE " + " ".join(cases) + " END"


OP3 = rf"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages
), named AS (
  SELECT page_id, html, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, {_rule_case("rule")} AS rule, {_rule_case("verdict")} AS ruled FROM named
), links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html,
      '(?i)(?:href|src)\s*=\s*["'']?\s*[a-z][a-z0-9+.\-]*://([^/?#"''\s>]+)', 1)), {_AZ}) AS dst
    FROM named) x GROUP BY src, dst
), hosts AS (
  SELECT src AS h FROM links UNION SELECT dst FROM links UNION SELECT host FROM named
), ties AS (
  SELECT h AS a, nullif(regexp_extract(h, '^[^.]+\.(.+\..+)$', 1), '') AS b FROM hosts
), edges AS (
  SELECT src, dst, sum(n)::DOUBLE AS weight FROM (
    SELECT src, dst, n FROM links
    UNION ALL SELECT a, b, 1 FROM ties WHERE b IS NOT NULL
    UNION ALL SELECT b, a, 1 FROM ties WHERE b IS NOT NULL) x
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), seeds AS (
  SELECT host, sum(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trusted,
         sum(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS blocked
  FROM ruled WHERE ruled IS NOT NULL AND host <> '' GROUP BY host
), shares AS (
  SELECT kind, a, b, weight / sum(weight) OVER (PARTITION BY kind, a) * {urls.DAMPING}::DOUBLE AS share FROM (
    SELECT 't' AS kind, src AS a, dst AS b, weight FROM edges UNION ALL SELECT 'd', dst, src, weight FROM edges) x
), walk AS (
  SELECT 0 AS step, kind, host, m FROM (
    SELECT 't' AS kind, host, trusted * (1.0::DOUBLE - {urls.DAMPING}::DOUBLE) AS m FROM seeds UNION ALL
    SELECT 'd', host, blocked * (1.0::DOUBLE - {urls.DAMPING}::DOUBLE) FROM seeds) x WHERE m > 0
  UNION ALL
  SELECT step + 1, w.kind, b, sum(m * share) FROM walk w JOIN shares s ON s.kind = w.kind AND a = w.host WHERE step < 250 GROUP BY step, w.kind, b
), sized AS (
  SELECT host, count(*) AS n FROM named WHERE host <> '' GROUP BY host
), scores AS (
  SELECT host, (coalesce(t.rank, 0) - coalesce(d.rank, 0)) / n AS score
  FROM sized LEFT JOIN (SELECT host, sum(m) AS rank FROM walk WHERE kind = 't' GROUP BY host) t USING (host)
  LEFT JOIN (SELECT host, sum(m) AS rank FROM walk WHERE kind = 'd' GROUP BY host) d USING (host)
)
SELECT page_id, r.host, path, rule,
       coalesce(ruled, CASE WHEN score < -{urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host
"""

OP5 = """
WITH counts AS (
  SELECT source, count(*) AS n, (sum(count(*)) OVER ())::DOUBLE / (count(*) OVER ()) / count(*) AS rate
  FROM documents GROUP BY source
), steps AS (
  SELECT source, n, list(p ORDER BY k) AS cdf FROM (
    SELECT source, n, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
    FROM counts, (SELECT unnest(range(0, 200)) AS k) ks) x GROUP BY source, n
), drawn AS (
  SELECT d.*, len(list_filter(cdf, lambda p: p <= (('0x' || substr(md5('42:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)) AS n_copies
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
), copies AS (
  SELECT * EXCLUDE (n_copies), unnest(range(0, n_copies))::INTEGER AS copy_no FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copy_no,
       ('0x' || substr(md5('42/' || doc_id || '/' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""

OP11 = rf"""
WITH pieces AS (
  SELECT doc_id, lang, generate_subscripts(parts, 1) AS piece, unnest(parts) AS part FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]') AS parts FROM documents) x
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), counts AS (
  SELECT lang, phrase, size, count(*) AS a FROM (
    SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size) s) x
  GROUP BY lang, phrase, size
), candidates AS (
  SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND a >= {phrases.MIN_COUNT}
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) x
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, ({phrases.SCALE}::HUGEINT * c.a // (h.a + t.a))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = head JOIN counts t ON t.lang = c.lang AND t.phrase = tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN (
    SELECT lang, size, a, unnest(list_concat(
      list_transform(range(1, size), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, size - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS part
    FROM candidates) t ON t.lang = s.lang AND t.part = s.phrase AND t.size > s.size
  WHERE 100::HUGEINT * t.a >= {phrases.COVERED_PERCENT}::HUGEINT * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang) ANTI JOIN covered USING (lang, phrase)
QUALIFY rank <= {phrases.TOP}
"""


def _code_rounds() -> str:
    """Unrolled rounds: assignment to the nearest entry, then the entries' means."""
    steps = []
    for i in range(codes.ROUNDS + 1):
        steps.append(f"""near_{i} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN book_{i} b ON p.part = b.part) x
  GROUP BY vec_id, part)""")
        if i < codes.ROUNDS:
            steps.append(f"""book_{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book_{i} b LEFT JOIN (
    SELECT part, entry, list(value ORDER BY place) AS x FROM (
      SELECT part, entry, place, floor(sum(v)::DOUBLE / count(*))::BIGINT AS value FROM (
        SELECT n.part, n.entry, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS place FROM near_{i} n JOIN parts p ON p.vec_id = n.vec_id AND p.part = n.part) y
      GROUP BY part, entry, place) z GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)""")
    return ",\n".join(steps)


OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({codes.SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, part, x[part * len(x) // {codes.PARTS} + 1:(part + 1) * len(x) // {codes.PARTS}] AS x
  FROM kept, (SELECT unnest(range(0, {codes.PARTS})) AS part) s
), book_0 AS MATERIALIZED (
  SELECT part, entry - 1 AS entry, x FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS entry FROM kept ORDER BY vec_id LIMIT {codes.ENTRIES}) f USING (vec_id)
), {_code_rounds()},
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM book_{codes.ROUNDS}
), coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near_{codes.ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""

OP13 = f"""
WITH split AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) x
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), {_AZ}) AS key FROM split
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}
), judged AS (
  SELECT k.*, coalesce(doc_id <> first, FALSE) AS gone FROM keyed k LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op3_url_filter": OP3, "op5_mixing": OP5, "op11_phrases": OP11, "op12_codes": OP12, "op13_lines": OP13}
