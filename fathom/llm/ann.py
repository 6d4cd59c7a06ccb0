"""Nearest neighbours by inner product: an HNSW graph for each shard.

Vectors are dealt to shards by a hash of their id.  A shard's graph (Malkov and
Yashunin, 2018) is built by one task and stored as flat arrays: vectors, ids and a
fixed number of neighbours a node and layer.  The ground layer is built by
insertion; the layers above, a sixteenth of a shard at most, by exact neighbours.
Every query searches every shard, in blocks, and the shards' results are merged.  Searches and insertions go through the
graph in lockstep, many at a time, so that each step is a few numpy calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, salt, saved

#: Neighbours of a node above the ground layer; the ground layer has twice as many.
M = 16
EF_BUILD, EF_SEARCH = 96, 192
#: Nodes inserted, or queries searched, in lockstep; best nodes expanded in a step.
LANES, WIDTH = 512, 4
#: A shard has at most so many vectors, and bytes of them.
SHARD_ROWS, SHARD_BYTES, LEAST_SHARDS = 65_536, 64 << 20, 8
#: Queries that one task takes to a shard.
BLOCK_QUERIES = 4096

GRAPH = "dim int, shard int, ids binary, starts binary, vectors binary, nodes array<binary>, links array<binary>"


def augmented(x: np.ndarray) -> np.ndarray:
    """One more component makes all norms equal: the order by inner product stays that of nearness."""
    if x.dtype == np.float64:  # doubles may be too large for their squares, and for floats
        x = x / max(np.abs(x).max(initial=0), np.finfo(float).tiny)
    square = (x.astype(np.float64) ** 2).sum(1)
    top = square.max(initial=1e-300)
    return (np.column_stack([x, np.sqrt(np.maximum(top - square, 0))]) / np.sqrt(top)).astype(np.float32)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nodes nearest to each query that best-first search finds: nodes (-1: none) and nearness.

    links: (nodes, degree), -1 where there are fewer.  entry: (queries, any number).
    """
    n, rows = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    ids = np.full((len(q), max(ef, entry.shape[1])), -1, np.int32)
    near = np.full(ids.shape, -np.inf, np.float32)
    done = np.zeros(ids.shape, bool)
    ids[:, : entry.shape[1]] = entry
    near[:, : entry.shape[1]] = np.einsum("rmd,rd->rm", x[entry], q)
    seen[rows[:, None], entry] = True
    width = min(WIDTH, ids.shape[1])
    while len(rows):
        open_ = np.where(done[rows], -np.inf, near[rows])
        best = np.argpartition(-open_, width - 1, axis=1)[:, :width] if width < open_.shape[1] else np.tile(np.arange(width), (len(rows), 1))
        live = np.take_along_axis(open_, best, 1) > -np.inf
        still = live.any(1)
        rows, best, live = rows[still], best[still], live[still]
        if not len(rows):
            break
        node = np.where(live, ids[rows[:, None], best], 0)
        done[rows[:, None], best] = True
        found = np.where(live[:, :, None], links[node], -1).reshape(len(rows), -1)
        found.sort(axis=1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        found = np.where(fresh, found, 0)
        fresh &= ~seen[rows[:, None], found]
        r, c = np.nonzero(fresh)
        seen[rows[r], found[r, c]] = True
        got = np.full(found.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("ed,ed->e", x[found[r, c]], q[rows[r]])
        all_near = np.concatenate([near[rows], got], axis=1)
        all_ids = np.concatenate([ids[rows], found], axis=1)
        all_done = np.concatenate([done[rows], np.zeros(found.shape, bool)], axis=1)
        top = np.argpartition(-all_near, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
        near[rows], ids[rows], done[rows] = (np.take_along_axis(a, top, 1) for a in (all_near, all_ids, all_done))
        done[rows] |= near[rows] == -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
    return np.where(near > -np.inf, ids, -1), near


def diverse(x: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) the neighbours to keep, -1 padded.

    A candidate is kept if it is nearer to the node than to any that is kept; free
    places go to the nearest of the others.
    """
    rows, c = ids.shape
    own = x[np.maximum(ids, 0)]
    among = np.matmul(own, own.transpose(0, 2, 1))
    kept, closest = np.zeros((rows, c), bool), np.full((rows, c), -np.inf, np.float32)
    for k in range(c):
        kept[:, k] = (ids[:, k] >= 0) & (near[:, k] > closest[:, k]) & (kept.sum(1) < most)
        closest = np.where(kept[:, k : k + 1], np.maximum(closest, among[:, k]), closest)
    rank = np.where(ids < 0, 2 * c, np.where(kept, 0, c)) + np.arange(c)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return out if c >= most else np.pad(out, ((0, 0), (0, most - c)), constant_values=-1)


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """The neighbours of each node among all, found by brute force: for small layers."""
    n, c = len(x), min(len(x) - 1, 2 * most)
    out = np.full((n, most), -1, np.int32)
    for a in range(0, n if c else 0, LANES):
        near = x[a : a + LANES] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        ids = np.argpartition(-near, c - 1, axis=1)[:, :c].astype(np.int32)
        near = np.take_along_axis(near, ids, 1)
        order = np.argsort(-near, axis=1)
        out[a : a + LANES] = diverse(x, np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), most)
    return out


def _linked_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Add the links from the neighbours of the nodes `new` back to them."""
    source = np.repeat(new, links.shape[1])
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(nodes), LANES):
        part = nodes[a : a + LANES]
        n = count[a : a + LANES]
        more = np.full((len(part), n.max()), -1, np.int32)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        more[np.repeat(np.arange(len(part)), n), at] = source[first[a] : first[a] + n.sum()]
        ids = np.sort(np.concatenate([links[part], more], axis=1), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        near = np.where(ids >= 0, np.einsum("rmd,rd->rm", x[np.maximum(ids, 0)], x[part]), -np.inf)
        order = np.argsort(-near, axis=1)[:, : 2 * links.shape[1]]
        links[part] = diverse(x, np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), links.shape[1])


def descend(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray) -> np.ndarray:
    """Where to enter the ground layer: the nearest nodes that the upper layers lead to."""
    entry = np.zeros((len(q), 1), np.int64)
    for nodes, links in reversed(layers):
        found, _ = beam(x[nodes], links, q, np.searchsorted(nodes, entry), 4)
        entry = nodes[np.where(found >= 0, found, found[:, :1])]
    return entry


def build(x: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the ground up: (nodes, ascending; links within the layer) of distinct vectors x."""
    n = len(x)
    levels = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(M)), 5).astype(int)
    levels[0] = max(levels.max(initial=0), 1)  # node 0 is where all searches begin
    upper = []
    for level in range(1, levels.max(initial=0) + 1):
        nodes = np.flatnonzero(levels >= level)
        links = _exact(x[nodes], M)
        _linked_back(x[nodes], links, np.arange(len(nodes)))
        upper.append((nodes, links))
    ground = np.full((n, 2 * M), -1, np.int32)
    if upper:
        first = upper[0][0]
        near = _exact(x[first], 2 * M)
        ground[first] = np.where(near >= 0, first[near], -1)
        _linked_back(x, ground, first)
    rest, at = np.flatnonzero(levels == 0), 0
    while at < len(rest):
        new = rest[at : at + min(LANES, max(32, (n - len(rest) + at) // 2))]
        ids, near = beam(x, ground, x[new], descend(x, upper, x[new]), EF_BUILD)
        c = min(len(new) - 1, 2 * M)
        if c > 0:  # nodes of one batch don't find each other in the graph
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            top = np.argpartition(-own, c - 1, axis=1)[:, :c]
            ids = np.concatenate([ids, new[top].astype(np.int32)], axis=1)
            near = np.concatenate([near, np.take_along_axis(own, top, 1)], axis=1)
        order = np.argsort(-near, axis=1)[:, : 4 * M]
        ground[new] = diverse(x, np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), 2 * M)
        _linked_back(x, ground, new)
        at += len(new)
    return [(np.arange(n), ground), *upper]


def _graph_of(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
    """One row that holds a shard: its distinct vectors, their ids and the layers."""
    x = np.stack(rows["v"].to_numpy())
    ids = rows["vec_id"].to_numpy()
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))
    shuffled = np.random.default_rng(len(starts)).permutation(len(starts))
    groups = [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
    groups, x = [groups[i] for i in shuffled], x[starts][shuffled]
    layers = build(augmented(x))
    bounds = np.cumsum([0, *map(len, groups)])
    return pd.DataFrame([(*key, np.concatenate(groups).astype("<i8").tobytes(), bounds.astype("<i8").tobytes(), x.astype(x.dtype.newbyteorder("<")).tobytes(), [n.astype("<i4").tobytes() for n, _ in layers], [e.astype("<i4").tobytes() for _, e in layers])], columns=["dim", "shard", "ids", "starts", "vectors", "nodes", "links"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: vectors without null or non-finite parts, not zero."""
    # Floats stay floats, all else becomes doubles, so scores are those of the original vectors.
    kind = vectors.schema["embedding"].dataType.simpleString() if "embedding" in vectors.columns else ""
    rows = columns(vectors, vec_id="long", embedding="array<float>" if kind == "array<float>" else "array<double>").withColumnRenamed("embedding", "v")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Graphs of all shards, a row each, written down; and the number of shards."""
    rows = usable(vectors).dropDuplicates(["vec_id", "v"])
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // ((4 if "float" in rows.schema["v"].simpleString() else 8) * dim)))
    shards = max(LEAST_SHARDS, -(-n // most))
    dealt = rows.withColumn("shard", salt("vec_id", of=shards))
    return saved(dealt.groupBy("dim", "shard").applyInPandas(_graph_of, GRAPH), "graphs"), shards


def numbers(data: bytes, rows: int, dim: int) -> np.ndarray:
    """Rows of floats or of doubles, as many bytes as there are."""
    return np.frombuffer(data, "<f8" if len(data) == 8 * rows * dim else "<f4").reshape(rows, dim)


def opened(graph: dict) -> tuple:
    """The arrays of a shard's row: vectors, the same augmented, ids, where each vector's ids start, layers."""
    starts = np.frombuffer(graph["starts"], "<i8")
    x = numbers(graph["vectors"], len(starts) - 1, graph["dim"])
    layers = [(np.frombuffer(n, "<i4").astype(np.int64), np.frombuffer(e, "<i4").reshape(len(n) // 4, -1)) for n, e in zip(graph["nodes"], graph["links"], strict=True)]
    return x.astype(np.float64), augmented(x), np.frombuffer(graph["ids"], "<i8"), starts, layers


def search_shard(shard: tuple, q: np.ndarray, own: np.ndarray, k: int, ef: int = EF_SEARCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its row, the ids found and their inner products, k at most, best first."""
    exact, wide, ids, starts, layers = shard
    scaled = q / np.maximum(np.abs(q).max(1, initial=0), np.finfo(float).tiny)[:, None] if q.dtype == np.float64 else q
    turned = np.column_stack([scaled, np.zeros(len(q))]).astype(np.float32)
    for a in range(0, len(q), LANES):
        part = turned[a : a + LANES]
        found, _ = beam(wide, layers[0][1], part, descend(wide, layers[1:], part), ef)
        for i, nodes in enumerate(found, a):
            nodes = nodes[nodes >= 0]
            score = (exact[nodes] * q[i].astype(np.float64)).sum(1)
            # Of equal vectors the k + 1 least ids are enough, as one may be the query's own.
            each = [ids[starts[n] : starts[n + 1]][: k + 1] for n in nodes]
            got, score = np.concatenate(each), np.repeat(score, [len(e) for e in each])
            other = got != own[i]
            got, score = got[other], score[other]
            top = np.lexsort((got, -score))[:k]
            yield i, got[top], score[top]


def nearest(queries: DataFrame, index: DataFrame, shards: int, k: int = 20) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score.

    queries: (vec_id, embedding).  Nearest first by inner product in doubles, ties to
    the smaller id; a query's own id is no candidate.  Vectors of another dimension
    are no candidates either.  Vectors that are null, zero, or hold null or
    non-finite parts take no part, on either side; nor do null ids.  Repeated rows
    count once.  Where an id has several vectors, the least of them (component by
    component) is its query, and its best score counts as a candidate's.  With fewer
    than k candidates, all are returned.

    The index is shuffled once, whatever the number of queries; every block of
    queries goes to every shard.
    """
    rows = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ids = b.column("dim").to_numpy(), b.column("vec_id").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                for i in range(0, len(at), BLOCK_QUERIES):
                    block = (ids[at[i : i + BLOCK_QUERIES]].astype("<i8").tobytes(), v[i : i + BLOCK_QUERIES].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block[0]], pa.binary()), pa.array([block[1]], pa.binary())], ["dim", "ids", "vectors"])

    blocks = saved(rows.mapInArrow(packed, "dim int, ids binary, vectors binary"), "blocks")
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = sent.select(*[F.col(f.name) if f.name in sent.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema], F.lit(True).alias("asks"))
    # A shard's graph comes first, then its queries pass by it, a block at a time.
    streams = index.withColumn("asks", F.lit(False)).unionByName(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shard = None, ()
        for b in batches:
            for row in range(b.num_rows):
                one = {c: b.column(c)[row].as_py() for c in b.schema.names}
                if not one["asks"]:
                    of, shard = (one["dim"], one["shard"]), opened(one)
                elif of == (one["dim"], one["shard"]):
                    own = np.frombuffer(one["ids"], "<i8")
                    out = [(own[[i] * len(ids)], ids, score) for i, ids, score in search_shard(shard, numbers(one["vectors"], len(own), one["dim"]), own, k)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = streams.mapInArrow(searched, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
