"""DuckDB SQL of the registered queries that SQL can express."""

from folioforge.llm.common import ASCII_LOWER, ASCII_UPPER

PHRASES = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.w, c.m, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (SELECT unnest([2, 3]) AS n), (SELECT unnest([1, 2, 3]) AS i) WHERE n < m AND i + n - 1 <= m GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TERMS_OF = f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{_TERMS}')"
LEXICAL = f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS_OF} AS w FROM documents),
sized AS (SELECT place, doc_id, len(w) AS n, w FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, sum(n) AS words FROM sized),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS_OF}) AS t FROM benchmark),
tf AS (
  SELECT place, doc_id, n, t, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(w) AS t FROM sized)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY t),
impacts AS (
  SELECT place, doc_id, t, (w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS impact
  FROM tf JOIN weights USING (t), totals),
scores AS (SELECT item_id, place, doc_id, sum(impact)::BIGINT AS score FROM impacts JOIN asked USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

WARC = """
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM pages_),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""
