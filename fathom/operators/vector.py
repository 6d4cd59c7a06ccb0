"""Cosine nearest neighbours: one query, a batch of queries, and pruned candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal, norm

DEFAULT_K = 10
#: How rare a dimension is, least candidates, and when to give up.
RARE_SHARE, CANDIDATES_PER_K, CANDIDATE_SHARE, FULL_SCAN_SHARE = 0.05, 4, 0.01, 0.3
#: Vectors in a block and about as many as a shard holds; queries in one matrix product.
BLOCK, SHARD, QUERIES = 4096, 65_536, 256


def cosine_top(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int | None = None, norms: str | None = None, keep: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """(key, the columns of keep, score) of the k vectors of largest cosine, ties to the smaller key.

    A query of zeros has no neighbours; zero vectors and those of another length are
    none.  norms: a column that holds the vectors' norms already.  digits: scores are
    rounded before they rank.
    """
    k = DEFAULT_K if k is None else k
    length = float(np.sqrt(sum(float(v) ** 2 for v in query)))
    rows = df.filter(F.size(vector) == len(query)).withColumn("_norm", F.col(norms) if norms else norm(F.col(vector)))
    if length == 0:
        rows = rows.limit(0)
    score = dot(F.col(vector), literal(query)) / (F.col("_norm") * length)
    score = score if digits is None else F.round(score, digits)
    return rows.filter("_norm > 0").select(F.col(key).alias("key"), *keep, score.alias("score")).orderBy(F.desc("score"), "key").limit(k)


def arrays_of(v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places, unit vectors) of a column of vectors, by length; those without a direction left out."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.nan_to_num(pc.list_value_length(v).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        x = flat[starts[at, None] + np.arange(dim)]
        length = np.linalg.norm(x, axis=1)
        ok = length > 0
        yield dim, at[ok], x[ok] / length[ok, None]


def _blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim, keys, data): vectors of unit length in rows of up to BLOCK, as bytes; zero ones left out."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and size(v) > 0 and not exists(v, x -> x is null)")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in arrays_of(b.column("v")):
                for i in range(0, len(at), BLOCK):
                    keys = b.column("key").take(pa.array(at[i : i + BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([x[i : i + BLOCK].tobytes()], pa.binary())], ["dim", "keys", "data"])

    return rows.mapInArrow(packed, f"dim int, keys array<{kind}>, data binary")


def cosine_batch(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, rank, key, score): the k vectors of largest cosine for each of queries(key, vector).

    Vectors and queries go in blocks: a task holds one shard of the vectors and every
    block of queries passes by it in matrix products; a shard hands on k candidates a
    query, and a window merges them.  Ties go to the smaller key; digits: scores are
    rounded before they rank.  Vectors of zeros or of another length are no neighbours.
    """
    shards = -(-df.count() // SHARD) or 1
    held, asked = _blocks(df, key, vector), _blocks(queries, key, vector)
    kinds = [f.dataType.elementType.simpleString() for f in (asked.schema["keys"], held.schema["keys"])]
    if kinds[0] != kinds[1]:
        raise ValueError("queries and vectors need keys of one type")
    held = held.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")).withColumn("asks", F.lit(False))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts, shard = None, [], None
        for b in batches:
            for row in range(b.num_rows):
                here, dim, asks = (b.column("shard")[row].as_py(), b.column("dim")[row].as_py()), b.column("dim")[row].as_py(), b.column("asks")[row].as_py()
                keys, x = b.column("keys")[row].values, np.frombuffer(b.column("data")[row].as_py(), np.float64).reshape(-1, dim)
                if not asks:
                    of, parts, shard = here, [*(parts if of == here else []), (keys, x)], None
                elif of == here:
                    shard = shard or one_shard(parts)
                    yield from best_of(shard, keys, x, k, digits)

    streams = held.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks")
    found = streams.mapInArrow(each, f"query_id {kinds[0]}, key {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def one_shard(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """All blocks of a shard as one, by key: columns in the order in which ties go."""
    keys = pa.concat_arrays([k for k, _ in parts])
    order = pc.sort_indices(keys)
    return keys.take(order), np.concatenate([x for _, x in parts])[order.to_numpy()]


def best_of(shard: tuple[pa.Array, np.ndarray], ids: pa.Array, q: np.ndarray, k: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    keys, x = shard
    for a in range(0, len(q), QUERIES):
        score = q[a : a + QUERIES] @ x.T
        if digits is not None:
            score = np.round(score, digits)
        n = min(k, len(x))
        query, column = np.nonzero(score >= np.partition(score, -n, axis=1)[:, -n, None])
        order = np.lexsort((column, -score[query, column], query))
        query, column = query[order], column[order]
        first = np.searchsorted(query, np.arange(len(score)))
        best = np.arange(len(query)) - first[query] < n
        query, column = query[best], column[best]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + query)), keys.take(pa.array(column)), pa.array(score[query, column])], ["query_id", "key", "score"])


def dim_postings(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim, key, value) of the positive components."""
    return df.select(F.col(key).alias("key"), F.posexplode(vector).alias("dim", "value")).filter("value > 0")


def candidates(df: DataFrame, key: str, query: Sequence[float], k: int, postings: DataFrame) -> DataFrame | None:
    """(key): vectors of df to score, those that share most of the query's rare dimensions; None: all.

    Rare dimensions are positive in the query and in few vectors.  Without any, or
    with too few or too many candidates, all vectors are scored.  The candidates' least
    overlap comes from a count by steps of overlap, so that no task ranks more than
    those of one step.
    """
    n = df.count()
    asked = [i for i, v in enumerate(query) if v > 0]
    counts = postings.filter(F.col("dim").isin(asked)).groupBy("dim").count().collect()  # a row a dimension
    rare = [r["dim"] for r in counts if 1 <= r["count"] <= max(1, int(RARE_SHARE * n))]
    limit = max(CANDIDATES_PER_K * k, int(CANDIDATE_SHARE * n))
    if not rare or limit >= FULL_SCAN_SHARE * n:
        return None
    weight = F.create_map(*[F.lit(x) for d in rare for x in (d, float(query[d]))])[F.col("dim")]
    shared = postings.filter(F.col("dim").isin(rare)).groupBy("key").agg(F.sum(F.col("value").cast("double") * weight).alias("overlap"))
    step, above, least = F.floor(F.log2("overlap") * 64), 0, None
    for r in shared.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some thousand steps at most
        if above + r["count"] >= limit:
            least = r["step"]
            break
        above += r["count"]
    if least is None:
        return None
    last = shared.filter(step == least).orderBy(F.desc("overlap"), "key").limit(limit - above)
    return shared.filter(step > least).unionByName(last).select("key")


def cosine_pruned(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int = DEFAULT_K, postings: DataFrame | None = None, norms: str | None = None, digits: int | None = None) -> DataFrame:
    """As cosine_top, over the `candidates` alone; postings: those of dim_postings, if held."""
    postings = dim_postings(df, key, vector) if postings is None else postings
    chosen = candidates(df, key, query, k, postings)
    if chosen is not None:
        df = df.join(chosen.select(F.col("key").alias("_key")), F.col(key) == F.col("_key"), "left_semi")
    return cosine_top(df, key, vector, query, k, norms, digits=digits)
