"""Query op10: log-probabilities of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lm import held_out, score


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, docs.filter(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
