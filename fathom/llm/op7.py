"""Query op7: license texts and notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .licenses import scan_licenses


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
