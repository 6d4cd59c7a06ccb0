"""Query op4: all documents, their sources mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mixed

#: Target weights; sources that are not named weigh 1.
WEIGHTS = {"src0": 8, "src1": 5, "src2": 3, "src3": 3, "src4": 2, "src5": 2}
BLOCK = 16


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS, default=1, block=BLOCK)


_W = f"CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 1 END"

SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents),
s AS (SELECT source, {_W} AS w, count(*) AS n, (count(*) + {BLOCK - 1}) // {BLOCK} AS blocks FROM d GROUP BY source),
l AS (SELECT *, (blocks - 1) // w AS last FROM s),
c AS (SELECT DISTINCT unnest([0, last, last + 1]) AS cut FROM l),
r AS (SELECT cut AS first, lead(cut) OVER (ORDER BY cut) AS after FROM c),
q AS (SELECT first, after, source, w, n, blocks, last, least(w, greatest(0, blocks - first * w)) AS q,
             CAST(sum(least(w, greatest(0, blocks - first * w))) OVER (PARTITION BY first) AS BIGINT) AS dd
      FROM r, l WHERE after IS NOT NULL),
edf AS (
  SELECT first, dd, CAST(-1 AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS j,
         list(CAST(0 AS BIGINT) ORDER BY source) AS done, list(CAST(q AS BIGINT) ORDER BY source) AS qs, list(source ORDER BY source) AS names
  FROM q GROUP BY first, dd
  UNION ALL
  SELECT first, dd, t + 1, names[p], done[p], list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), qs, names
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(qs) + 1), lambda i: done[i] < qs[i] AND done[i] * dd // greatest(qs[i], 1) <= t + 1),
                                          lambda i: ((done[i] + 1) * dd + greatest(qs[i], 1) - 1) // greatest(qs[i], 1) * 100000 + i)) % 100000 AS p
        FROM edf WHERE t + 1 < dd)),
o AS (SELECT first, dd, after, coalesce(sum((after - first) * dd) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT DISTINCT first, after, dd FROM q)),
p AS (SELECT e.first, o.after, e.source, e.j, o.start + e.t AS slot0, e.dd,
             CASE WHEN e.first = q.last AND e.j = q.q - 1 THEN q.blocks * {BLOCK} - q.n ELSE 0 END AS lacks, q.w
      FROM edf e JOIN o USING (first) JOIN q ON q.first = e.first AND q.source = e.source WHERE e.t >= 0),
m AS (SELECT *, coalesce(sum(lacks) OVER (ORDER BY slot0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing FROM p)
SELECT d.doc_id, d.source, CAST(d.rank // {BLOCK} AS BIGINT) AS block,
       CAST((m.slot0 + (d.rank // {BLOCK} // m.w - m.first) * m.dd) * {BLOCK} + d.rank % {BLOCK} - m.missing AS BIGINT) AS position
FROM d JOIN m ON m.source = d.source AND d.rank // {BLOCK} % m.w = m.j AND d.rank // {BLOCK} // m.w >= m.first AND d.rank // {BLOCK} // m.w < m.after
"""
