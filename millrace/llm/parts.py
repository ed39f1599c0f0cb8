"""The parts of operators 5, 9 and 10 that SQL can state, with their SQL.

The whole results have none: a forest's verdict, spans extended word by word
and trees' spans. These queries take the operators' own rows and leave such
columns out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import pii, quality_rules, repeats


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's counts and base rules."""
    return quality_rules.query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def repeats_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which operator 9 finds a passage."""
    return repeats.query(spark, sf_dir).select("doc_id", "n_words", "copies")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's base spans."""
    return pii.query(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUALITY_COUNTS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest([w[i:i + 7] FOR i IN range(1, len(w) - 6)]) AS s FROM docs WHERE len(w) > 7),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) AS more(k) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
"""

REPEATS_FOUND = r"""
WITH classes AS (SELECT text AS t, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents GROUP BY text),
long AS (SELECT t, copies, w FROM classes WHERE len(w) > 49),
runs AS (SELECT t, unnest([md5(array_to_string(w[i:i + 49], ' ')) FOR i IN range(1, len(w) - 48)]) AS h FROM long),
twice AS (SELECT DISTINCT t FROM (SELECT t FROM runs QUALIFY count(*) OVER (PARTITION BY h) > 1))
SELECT d.doc_id, len(l.w)::BIGINT AS n_words, l.copies
FROM documents d JOIN long l ON d.text = l.t WHERE l.copies > 1 OR l.t IN (SELECT t FROM twice)
"""

# Matches are set between two private-use characters, so that what stands before them tells where they start.
PII_BASE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, place, pattern) AS (VALUES
  ('email', 1, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)'),
  ('ip', 2, '([0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))'),
  ('card', 3, '([0-9]([\x20-]?[0-9])+)'),
  ('phone', 4, '(\+[0-9][\x20().0-9-]+[0-9])')),
parts AS (
  SELECT r, kind, place, string_split(regexp_replace(t, pattern, chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS p FROM docs, kinds),
matches AS (
  SELECT r, kind, place, unnest([list_sum([length(x) FOR x IN p[:k]]) - (k - 1) FOR k IN range(1, len(p))]) AS start, unnest([string_split(x, chr(57345))[1] FOR x IN p[2:]]) AS m
  FROM parts WHERE len(p) > 1),
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM matches),
summed AS (
  SELECT *, list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT ELSE d[i]::INT * 2 - 9 * (d[i]::INT > 4)::INT END FOR i IN range(1, length(d) + 1)]) AS luhn
  FROM digits),
fine AS (
  SELECT * FROM summed
  WHERE kind = 'email' OR (kind = 'ip' AND regexp_full_match(m, '0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}'))
     OR (kind = 'card' AND length(d) BETWEEN 16 AND 19 AND luhn % 10 = 0) OR (kind = 'phone' AND length(d) BETWEEN 8 AND 15)),
found AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT, ',' ORDER BY place, start) AS spans
  FROM fine GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM docs LEFT JOIN found USING (r)
"""
