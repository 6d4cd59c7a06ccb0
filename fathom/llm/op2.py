"""Query op2: token counts of each line of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tokens import section_tokens


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
