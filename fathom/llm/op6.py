"""Query op6: exact duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import fresh_folder
from .exact import Snapshot, exact_dedup, halves


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half becomes a snapshot, which is opened for the other."""
    old, new = halves(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = fresh_folder(spark, "snapshot")
    Snapshot(spark, folder).extended(old)
    return exact_dedup(new, Snapshot(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
