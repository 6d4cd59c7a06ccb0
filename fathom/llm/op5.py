"""Query op5: the 20 nearest of every twentieth vector, against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import build_index, nearest


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index, shards = build_index(vectors)
    return nearest(vectors.filter(F.col("vec_id") % 20 == 0), index, shards, k=20)
