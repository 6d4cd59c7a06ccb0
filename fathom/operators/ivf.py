"""Inverted-file search over vectors: centroids, lists of the vectors nearest to each, a few lists a query.

Centroids are fitted on a bounded sample; every vector is in a list.  A query reads
the lists whose centroids are nearest to it, which are folders, so the others aren't
touched.  What it finds is exact among the lists that it reads; how many those are is
a parameter, and with all of them the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from .vector import BLOCK, SHARD, arrays_of, best_of, one_shard

#: Vectors of the sample that centroids are fitted on, rounds of fitting, and lists at most.
SAMPLE, ROUNDS, MOST_LISTS, LEAST = 20_000, 12, 1024, 1000
#: Share of the lists that a query reads unless it says otherwise.
PROBED = 0.6
#: The list of vectors that no centroid fits: of another length.  Every query reads it.
OTHERS = -1


def fit(df: DataFrame, key: str, vector: str, lists: int | None = None) -> np.ndarray:
    """Unit centroids of df's vectors, of the length that most of the sample have: spherical k-means.

    lists: how many; without it one for fewer than LEAST vectors, else the square root of
    their number.  The sample
    is the SAMPLE vectors of least hash of key, so it depends on neither files nor order.
    """
    rows = df.filter(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h"))
    n = rows.count()
    wanted = min(MOST_LISTS, lists or (round(n**0.5) if n >= LEAST else 1))
    table = rows.orderBy("h").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows at most
    found = [np.asarray(v.as_py(), float) for v in table.column("v") if None not in v.as_py()]
    if not found:
        return np.zeros((0, 0))
    sizes, times = np.unique([len(v) for v in found], return_counts=True)
    x = np.stack([v for v in found if len(v) == sizes[times.argmax()]])
    length = np.linalg.norm(x, axis=1)
    x = x[np.isfinite(length) & (length > 0)]
    x = x / np.linalg.norm(x, axis=1)[:, None]
    if not len(x):
        return np.zeros((0, 0))
    # Seeds far from each other: each is the vector of the sample least like those before it.
    seeds, near = [0], x @ x[0]
    while len(seeds) < min(wanted, len(x)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-12:
            break
        seeds.append(at)
        near = np.maximum(near, x @ x[at])
    centres = x[seeds]
    for _ in range(ROUNDS):
        mine = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centres)
    return centres


def assigned(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """df's rows that have a direction, with `norm`, the vector's length, and `_list`."""
    rows = df.filter(F.col(vector).isNotNull()).withColumn("norm", norm(F.col(vector))).filter("norm > 0")
    held = df.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        out = np.full(len(v), OTHERS, np.int32)
        for dim, at, x in arrays_of(v):
            if dim == held.value.shape[1]:
                out[at] = (x @ held.value.T).argmax(1)
        return pa.array(out)

    return rows.withColumn("_list", nearest(F.col(vector).cast("array<double>")))


def probed(query: Sequence[float], centres: np.ndarray, probes: int | None = None) -> list[int]:
    """The lists that a query reads, nearest centroid first."""
    if not len(centres) or len(query) != centres.shape[1]:
        return [OTHERS]
    n = max(1, round(PROBED * len(centres))) if probes is None else max(1, probes)
    return [*np.argsort(-(centres @ np.asarray(query, float)), kind="stable")[:n].tolist(), OTHERS]


def batch(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, centres: np.ndarray, probes: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, rank, key, score): as vector.cosine_batch, over the lists that each query reads.

    A list is cut into shards of about SHARD vectors; a query goes to the shards of its
    lists alone.  df: with `_list`, of `assigned`.
    """
    held = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), "_list")
    sizes = {r["_list"]: -(-r["count"] // SHARD) for r in held.groupBy("_list").count().collect()}  # a row a list
    shards = F.create_map(*[F.lit(x) for i, n in (sizes or {OTHERS: 1}).items() for x in (i, n)])
    held = held.withColumn("shard", F.pmod(F.xxhash64("key"), shards[F.col("_list")]).cast("int")).withColumn("asks", F.lit(False))

    @F.arrow_udf("array<int>")
    def lists(v: pa.Array) -> pa.Array:
        out: list[list[int]] = [[] for _ in range(len(v))]
        for _, at, x in arrays_of(v):
            for i, q in zip(at.tolist(), x, strict=True):
                out[i] = probed(q, centres, probes)
        return pa.array(out, pa.list_(pa.int32()))

    asked = queries.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.select("key", "v", F.explode(lists("v")).alias("_list")).filter(shards[F.col("_list")].isNotNull())
    asked = asked.select("key", "v", "_list", F.explode(F.sequence(F.lit(0), shards[F.col("_list")] - 1)).alias("shard"), F.lit(True).alias("asks"))
    kind = df.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts, shard = None, {}, {}
        for b in batches:
            where = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_list", "shard", "asks")])
            starts = np.flatnonzero(np.concatenate([[True], (where[:, 1:] != where[:, :-1]).any(0)]))
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                here, part = (where[0, a], where[1, a]), b.slice(a, z - a)
                if here != of:
                    of, parts, shard = here, {}, {}
                for dim, at, x in arrays_of(part.column("v")):
                    keys = part.column("key").take(pa.array(at))
                    if not where[2, a]:
                        parts.setdefault(dim, []).append((keys, x))
                    elif dim in parts:
                        shard[dim] = shard.get(dim) or one_shard(parts[dim])
                        yield from best_of(shard[dim], keys, x, k, digits)

    dealt = held.unionByName(asked).repartition("_list", "shard").sortWithinPartitions("_list", "shard", "asks")
    found = dealt.mapInArrow(each, f"query_id {kind}, key {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "key", "score")
