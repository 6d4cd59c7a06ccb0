"""Query op9: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .pii import CONTEXT, KINDS, LEAST_SCORE, SECRET_WORDS, find_pii, report


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _found(k: int, kind: str, before: str, span: str) -> str:
    marked = f"string_split(regexp_replace(t, '{before}({span})', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1))"
    return f"""
  SELECT doc_id, t, {k} AS k, '{kind}' AS kind, m, e - length(m) AS s, e FROM (
    SELECT doc_id, t, m, i, CAST(sum(length(m)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e FROM (
      SELECT doc_id, rid, t, unnest({marked}) AS m, generate_subscripts({marked}, 1) AS i FROM d)
  ) WHERE i % 2 = 0"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INT) WHEN CAST({_DIGITS}[-i] AS INT) > 4 THEN CAST({_DIGITS}[-i] AS INT) * 2 - 9 ELSE CAST({_DIGITS}[-i] AS INT) * 2 END)) % 10 = 0"
_CODE = "replace(m, ' ', '')"
_TURNED = f"list_reduce(list_prepend(0, list_transform(string_split({_CODE}[5:] || {_CODE}[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"

SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
f AS ({" UNION ALL ".join(_found(*x) for x in (
    (1, "email", "()", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    (2, "ip", "()", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    (3, "card", "()", r"[0-9](?:[\x20-]?[0-9])+"),
    (4, "phone", "()", r"\+[0-9][\x20().0-9-]+[0-9]"),
    (5, "iban", "(^|[^A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    (6, "ssn", "(^|[^A-Za-z0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    (7, "secret", f'((?:^|[^A-Za-z0-9_])(?i:{SECRET_WORDS}) ?[=:] ?"?)', "[A-Za-z0-9_./+-]{20,}"),
))}),
g AS (SELECT *, CAST(least(1.0, CASE WHEN kind IN ('card', 'iban') THEN 0.8 ELSE 0.35 END
    + CASE WHEN regexp_matches(lower(t[greatest(s - {CONTEXT}, 0) + 1 : s] || ' ' || t[e + 1 : e + {CONTEXT}]),
      CASE kind {" ".join(f"WHEN '{k.name}' THEN '{k.words}'" for k in KINDS)} END) THEN 0.3 ELSE 0 END) AS DECIMAL(3, 2)) AS score FROM f WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INT) <= 255))
  WHEN 'card' THEN length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}
  WHEN 'phone' THEN length({_DIGITS}) BETWEEN 9 AND 15
  WHEN 'iban' THEN NOT regexp_matches(t[e + 1 : e + 1], '[A-Za-z0-9]') AND length({_CODE}) BETWEEN 15 AND 34 AND {_TURNED}
  WHEN 'secret' THEN true
  ELSE NOT regexp_matches(t[e + 1 : e + 1], '[A-Za-z0-9-]') END),
h AS (SELECT * FROM g WHERE k <= 4 OR (score >= {LEAST_SCORE}
  AND NOT EXISTS (SELECT 1 FROM g b WHERE b.k <= 4 AND b.doc_id = g.doc_id AND b.s < g.e AND g.s < b.e))),
a AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k <= 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
  count(*) AS n_spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s) AS scores
  FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (doc_id)
"""
