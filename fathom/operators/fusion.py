"""Fusing rankings: reciprocal ranks and weighted sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K0 = 60
#: Candidates asked from each side of a hybrid search, for each result.
OVERFETCH = 3


def _cut(df: DataFrame, k: int | None) -> DataFrame:
    out = df.orderBy(F.desc("score"), "key")
    return out if k is None else out.limit(k)


def reciprocal_rank(rankings: list[DataFrame], k: int | None = None, k0: int = RRF_K0) -> DataFrame:
    """(key, score): the sum of 1 / (k0 + rank) over rankings(key, score); ties by key.

    Rankings are short lists, the results of top-k searches; each is ranked as a whole.
    """
    if k0 < 1:
        raise ValueError("k0 must be at least 1")
    if not rankings:
        raise ValueError("no rankings to fuse")
    order = Window.orderBy(F.desc("score"), "key")
    parts = [r.select("key", (1.0 / (k0 + F.row_number().over(order))).alias("part")) for r in rankings]
    return _cut(reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("part").alias("score")), k)


def weighted_sum(first: DataFrame, second: DataFrame, alpha: float, k: int | None = None) -> DataFrame:
    """(key, score): alpha times the first's min-max scaled score and the rest of the second's."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be within 0 and 1")

    def scaled(r: DataFrame, weight: float) -> DataFrame:
        whole = Window.partitionBy(F.lit(0))
        r = r.select("key", "score", F.min("score").over(whole).alias("lo"), F.max("score").over(whole).alias("hi"))
        value = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        return r.select("key", (value * weight).alias("part"))

    both = scaled(first, alpha).unionByName(scaled(second, 1 - alpha))
    return _cut(both.groupBy("key").agg(F.sum("part").alias("score")), k)
