"""k-means by scalable seeding and mini-batches, over vectors of any number.

Seeds come from a few passes that each choose about twice as many vectors as there
are to be centres, far ones more likely (k-means||, Bahmani and others, 2012).  Then
batches move the centres: each centre goes towards the mean of its vectors by their
share of all that it has seen.  All choices are by hashes of keys, so the result
depends on neither files nor partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes of seeding, vectors chosen in each, as a multiple of the centres.
PASSES, OVER = 4, 2
#: Batches and vectors of each at least; fewer vectors than all batches want are one batch, seen again.
BATCHES, BATCH, PER_CENTRE = 24, 20_000, 100


def matrix(v: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, exact for equal vectors; rows of x by blocks."""
    out = np.empty((len(x), len(centres)))
    for a in range(0, len(x), 512):
        for b in range(0, len(centres), 64):
            out[a : a + 512, b : b + 64] = ((x[a : a + 512, None] - centres[None, b : b + 64]) ** 2).sum(2)
    return out


def assigned(df: DataFrame, vector: str, centres: np.ndarray, word: str = "word", digits: int | None = None) -> DataFrame:
    """df with the number of each vector's nearest centre, the first of equally near ones; null for a null vector.

    digits: squared distances are rounded before they are compared.
    """
    held = df.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        known = v.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(v), np.int32)
        if known.any():
            d = distances(matrix(v.filter(pa.array(known))), held.value)
            out[known] = (d if digits is None else np.round(d, digits)).argmin(1)
        return pa.array(out, mask=~known)

    return df.withColumn(word, nearest(F.col(vector).cast("array<double>")))


def fit(df: DataFrame, key: str, vector: str, k: int, written: Callable[[DataFrame, str], DataFrame]) -> np.ndarray:
    """k centres of df's vectors, which are of one length; fewer where there are fewer distinct ones.

    written: writes a table down under a name and gives it back as read.  The vectors
    of all batches are written once, with the number of their batch, so a round reads
    its own.  Null vectors take no part.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.xxhash64(key, vector).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        raise ValueError("no vectors to learn from")
    size = max(BATCH, PER_CENTRE * k)
    share = min(1.0, BATCHES * size / n)
    several = n >= BATCHES * size
    part = F.pmod(F.xxhash64("h", F.lit(-1)), F.lit(BATCHES if several else 1)).cast("int")
    chosen = rows.filter(_uniform(0) < share) if share < 1 else rows
    held = written(chosen.select("h", "v", part.alias("batch")).repartition("batch", F.pmod("h", F.lit(64))), "batches")
    centres = _seeds(held, k)
    seen = np.zeros(len(centres))
    for i in range(BATCHES):
        batch = held.filter(F.col("batch") == (i if several else 0))
        sums, counts = _sums(batch, centres)
        if not several:  # all vectors at once: each centre is their mean
            seen[:] = 0
        seen += counts
        moved = centres + (sums - counts[:, None] * centres) / np.maximum(seen, 1)[:, None]
        still, centres = np.allclose(moved, centres, rtol=0, atol=1e-6), moved
        if still and not several:
            break
    return centres


def _uniform(turn: int):
    """A number from 0 to 1 for each row, by its hash and a number of the turn."""
    return F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)


def _sums(df: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the vectors nearest to each centre: a row a task and centre, added up by centre."""
    held = df.sparkSession.sparkContext.broadcast(centres)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(held.value.shape), np.zeros(len(held.value), np.int64)
        for b in batches:
            x = matrix(b.column("v"))
            if len(x):
                near = distances(x, held.value).argmin(1)
                np.add.at(sums, near, x)
                counts += np.bincount(near, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at].tolist(), pa.list_(pa.float64())), pa.array(counts[at])], ["word", "sum", "n"])

    found = df.select("v").mapInArrow(each, "word int, sum array<double>, n long")
    width = centres.shape[1]
    total = found.groupBy("word").agg(F.array(*[F.sum(F.col("sum")[i]) for i in range(width)]).alias("sum"), F.sum("n").alias("n")).collect()  # a row a centre
    sums, counts = np.zeros(centres.shape), np.zeros(len(centres))
    for r in total:
        sums[r["word"]], counts[r["word"]] = r["sum"], r["n"]
    return sums, counts


def _seeds(df: DataFrame, k: int) -> np.ndarray:
    """Up to k distinct vectors to begin with: all of them where they are no more."""
    few = matrix(df.select("v").distinct().limit(k + 1).toArrow().column("v"))
    if len(few) <= k:
        return np.unique(few, axis=0)
    chosen = np.array([df.orderBy("h").first()["v"]])
    for turn in range(1, PASSES + 1):
        held = df.sparkSession.sparkContext.broadcast(chosen)

        @F.arrow_udf("double")
        def off(v: pa.Array) -> pa.Array:
            return pa.array(distances(matrix(v), held.value).min(1) if len(v) else np.zeros(0))  # noqa: B023

        far = df.select("h", "v", off("v").alias("off"))
        whole = far.agg(F.sum("off")).first()[0] or 0.0
        if whole <= 0:
            break
        more = far.filter(_uniform(turn) * whole < F.col("off") * float(OVER * k)).orderBy("h").select("v").toArrow()  # about OVER x k rows
        chosen = np.unique(np.concatenate([chosen, matrix(more.column("v")).reshape(-1, chosen.shape[1])]), axis=0)
    if len(chosen) <= k:
        return chosen
    _, weight = _sums(df, chosen)
    # The candidates are few: each next seed is the one that lowers the weighed distance most, as far as weight times distance tells.
    at = [int(weight.argmax())]
    near = distances(chosen, chosen[at])[:, 0]
    while len(at) < k and (near * weight).max() > 0:
        at.append(int((near * weight).argmax()))
        near = np.minimum(near, distances(chosen, chosen[at[-1:]])[:, 0])
    centres = chosen[at]
    for _ in range(10):  # rounds among the candidates, by their weights
        mine = distances(chosen, centres).argmin(1)
        for c in np.unique(mine):
            own = mine == c
            if weight[own].sum() > 0:
                centres[c] = (chosen[own] * weight[own, None]).sum(0) / weight[own].sum()
    return centres
