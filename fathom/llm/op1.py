"""Query op1: near-duplicates among all documents by three-word SimHash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .simhash import near_duplicates


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, distance=2)
