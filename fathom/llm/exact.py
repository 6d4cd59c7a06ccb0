"""Exact deduplication with static binary-fuse filters.

A snapshot is a folder of immutable layers.  A layer keeps the texts that it took in,
normalised, a bucket for each of their digests and, sharded by digest, a binary-fuse
filter (Graf and Lemire, 2022) of about 1.13 bytes a digest.  A new batch is first
grouped by itself; its distinct digests are screened by the filters, and only
positives join the layers' buckets.  Texts of all groups of two or more are then
compared by their bytes, so equal digests never decide alone.  The texts that a
snapshot was made of are not needed again, and a batch becomes a further layer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fresh, fresh_folder, join_unique, only_result, saved, whole_rows

#: Distinct digests in a shard, which is built and probed by one task.
SHARD_KEYS = 100_000
#: A screen has so many shards at least, so that a small one isn't built by one task.
SCREEN_SHARDS = 32
#: Bytes of filters that are broadcast; more ids than that are joined by a shuffle.
SCREEN_BYTES = 256 << 20
#: Groups of two or more whose keys may be broadcast for the byte check.
BROADCAST_GROUPS = 500_000

ROWS = "doc_id long, digest string, points int, norm string"
BUCKETS = "digest string, n long, best struct<points:int,anonymous:boolean,doc_id:long>"
FILTER = "shard int, seed long, segment int, segments int, prints binary"
WHITE = " \t\n\x0b\x0c\r"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(int(seed) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift in (33, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slots(mix: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots for each key, in three neighbouring segments."""
    first = ((mix >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    within = [((mix >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 12, 24)]
    return np.stack([(first + i) * segment + w for i, w in enumerate(within)], axis=1)


def _print(mix: np.ndarray) -> np.ndarray:
    return ((mix * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8)


def build_filter(keys: np.ndarray, most_tries: int = 64) -> tuple[int, int, int, bytes]:
    """(seed, segment length, first segments, prints) for distinct uint64 keys.

    Keys are peeled in rounds, whole arrays at a time; a seed whose keys don't all
    peel is passed over, and each eighth try makes the table a tenth larger.
    """
    n = max(len(keys), 1)
    segment = 1 << max(2, min(12, int(np.log(n) / np.log(3.33) + 2.25)))
    for seed in range(1, most_tries + 1):
        size = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * 1.1 ** ((seed - 1) // 8)
        segments = max(1, int(np.ceil(size / segment)) - 2)
        mix = _mixed(keys, seed)
        at = _slots(mix, segment, segments)
        total = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=total)
        owner = np.zeros(total, np.int64)
        np.add.at(owner, at.ravel(), np.repeat(np.arange(len(keys)), 3))
        order, front = [], np.flatnonzero(count == 1)
        while len(front):
            key, first = np.unique(owner[front], return_index=True)
            order.append((key, front[first]))
            touched = at[key].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(owner, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            front = touched[count[touched] == 1]
        if sum(len(k) for k, _ in order) == len(keys):
            prints, want = np.zeros(total, np.uint8), _print(mix)
            for key, slot in reversed(order):
                prints[slot] = want[key] ^ np.bitwise_xor.reduce(prints[at[key]], axis=1) ^ prints[slot]
            return seed, segment, segments, prints.tobytes()
    raise ValueError("no binary-fuse filter found: keys must be distinct")


def probe(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    """True for every key of the filter, and for one in 256 of the others."""
    mix = _mixed(keys, seed)
    table = np.frombuffer(prints, np.uint8)
    return np.bitwise_xor.reduce(table[_slots(mix, segment, segments)], axis=1) == _print(mix)


def _filter_of(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(rows["shard"].iloc[0], *build_filter(rows["key"].to_numpy().view(np.uint64)))], columns=["shard", "seed", "segment", "segments", "prints"])


def _screened(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    rows = rows.copy()
    rows["maybe"] = probe(rows["key"].to_numpy().view(np.uint64), *filters.iloc[0][["seed", "segment", "segments", "prints"]]) if len(filters) else False
    return rows


def screen(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray] | None:
    """Which longs may be among keys(key long): all that are, and one in 256 of the others.

    Its filters are broadcast, 1.13 bytes a key (more where they are few), so rows of
    texts that have none of the keys needn't be shuffled to find that out.  None: they
    would take more than SCREEN_BYTES, so the caller has to join.
    """
    spark = keys.sparkSession
    keys = saved(keys.select("key").distinct(), "screen")
    n = keys.count()
    if n * 1.2 > SCREEN_BYTES:
        return None
    shards = max(SCREEN_SHARDS, -(-n // SHARD_KEYS))
    rows = keys.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_filter_of, FILTER).collect()
    held = spark.sparkContext.broadcast({r["shard"]: (r["seed"], r["segment"], r["segments"], bytes(r["prints"])) for r in rows})

    def maybe(key: np.ndarray) -> np.ndarray:
        found, shard = np.zeros(len(key), bool), key % shards
        for s in np.unique(shard).tolist():
            if s in held.value:
                mine = np.flatnonzero(shard == s)
                found[mine] = probe(key[mine].view(np.uint64), *held.value[s])
        return found

    return maybe


def by_id(docs: DataFrame, ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose doc_id may be among ids(name), a null too, and all other rows.

    Where the ids are too many for a screen, any row's may be.
    """
    maybe = screen(ids.select(F.xxhash64(name).alias("key")))
    if maybe is None:
        return docs, docs.limit(0)

    @F.arrow_udf("boolean")
    def each(key: pa.Array) -> pa.Array:
        return pa.array(maybe(key.to_numpy(zero_copy_only=False)), pa.bool_())

    doc_id = docs["doc_id"] if "doc_id" in docs.columns else F.lit(None)
    listed = each(F.xxhash64(doc_id.cast("long")))
    return docs.filter(listed), docs.filter(~listed)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, points, norm) of docs(doc_id, text): what is kept of a text."""
    docs = columns(docs, doc_id="long", text="string").withColumn("norm", normalised(F.col("text")))
    return docs.select("doc_id", F.sha2("norm", 256).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("points"), "norm")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: how many rows, and the one that would stay."""
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("anonymous"), "doc_id"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best"))


class Layer(NamedTuple):
    """rows (doc_id, digest, points, norm), buckets (digest, n, best) and the filters of the buckets' digests."""

    rows: DataFrame
    buckets: DataFrame
    filters: DataFrame
    shards: int


class Snapshot:
    """Texts that were taken in, as immutable layers in a folder; the folder may be opened again at any time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.layers = spark, folder.rstrip("/"), []
        for name in self._names():
            at = f"{self.folder}/{name}"
            filters = spark.read.schema(FILTER).parquet(f"{at}/filters")
            rows = spark.read.schema(ROWS).parquet(f"{at}/rows")
            self.layers.append(Layer(rows, spark.read.schema(BUCKETS).parquet(f"{at}/buckets"), filters, int(name.rpartition("-")[2])))

    def _names(self) -> list[str]:
        """Whole layers, oldest first: layer-<number>-<shards>."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
        return [n for n in names if n.startswith("layer-")]

    def extended(self, docs: DataFrame) -> Snapshot:
        """The snapshot with docs(doc_id, text) as a further layer; this one stays as it is."""
        at = f"{self.folder}/new-{uuid.uuid4().hex}"
        rows, buckets = (self.spark.read.schema(s) for s in (ROWS, BUCKETS))
        _rows(docs).write.parquet(f"{at}/rows")
        _grouped(rows.parquet(f"{at}/rows")).write.parquet(f"{at}/buckets")
        held = buckets.parquet(f"{at}/buckets")
        shards = -(-held.count() // SHARD_KEYS) or 1
        keys = held.select(F.xxhash64("digest").alias("key")).distinct().withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
        keys.groupBy("shard").applyInPandas(_filter_of, FILTER).write.parquet(f"{at}/filters")
        # A layer is there once it has its name, so one that was cut off is never seen.
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        path(at).getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(path(at), path(f"{self.folder}/layer-{len(self.layers):06d}-{shards}"))
        return Snapshot(self.spark, self.folder)


def _positives(groups: DataFrame, layer: Layer, n: int) -> DataFrame:
    """The digests of n groups(digest) that a layer's filters let pass.

    Groups and filters meet by shard; where a shard has more groups than SHARD_KEYS, they
    are dealt over several tasks, each with a copy of the shard's filter.
    """
    salts = -(-n // (layer.shards * SHARD_KEYS)) or 1
    keys = groups.select("digest", F.xxhash64("digest").alias("key"))
    keys = keys.withColumn("shard", F.pmod("key", F.lit(layer.shards)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(salts)).cast("int"))
    filters = layer.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = keys.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(_screened, "digest string, key long, shard int, salt int, maybe boolean")
    return found.filter("maybe").select("digest")


def exact_dedup(batch: DataFrame, snapshot: Snapshot | DataFrame | None = None) -> DataFrame:
    """Group documents whose texts are equal but for ASCII white space.

    batch: (doc_id, text); snapshot: what came before, or a table from which one is made.
    Result, for each row of both: doc_id, keep_id, group_size, kept, text_sha256 and
    from_snapshot.  Of a group the text with most code points stays, then the least
    doc_id, null ids last.

    A null text counts as empty; all empty texts are one group.  A row without
    doc_id is kept only where its whole group has none.  Rows that repeat an id and
    its text are the same document and share their kept.  Empty tables give no rows.
    Texts may be of any length; groups of any size are counted before they are shuffled.
    """
    if isinstance(snapshot, DataFrame):
        snapshot = Snapshot(batch.sparkSession, fresh_folder(batch.sparkSession, "snapshot")).extended(snapshot)
    layers = snapshot.layers if snapshot else []
    new = saved(_rows(batch), "digests")
    mine = saved(_grouped(new.drop("norm")), "batch")
    n, total = (mine.count(), mine) if layers else (0, mine)
    for i, layer in enumerate(layers):
        both = saved(_positives(mine, layer, n), f"positives{i}")
        hits = layer.buckets.join(both, "digest", "left_semi")
        # Other digests of the layer are groups as they stand, but for later layers.
        total = total.unionByName(hits)
    known = total.groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best")) if layers else total
    if layers:
        rest = reduce(DataFrame.unionByName, [x.buckets for x in layers]).join(mine.select("digest"), "digest", "left_anti")
        rest = rest.groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best")) if len(layers) > 1 else rest
        known = known.unionByName(rest)
    groups = saved(known.select("digest", "n", F.col("best.doc_id").alias("keep_id")), "groups")

    rows = reduce(DataFrame.unionByName, [new.withColumn("old", F.lit(False)), *(x.rows.withColumn("old", F.lit(True)) for x in layers)])
    found = join_unique(rows.drop("norm", "points"), groups, "digest", "n", ["keep_id"])
    clash = _clashes(rows, groups)
    out = found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.expr("doc_id <=> keep_id").alias("kept"), F.col("digest").alias("text_sha256"), F.col("old").alias("from_snapshot"))
    if clash is None:
        return out
    return out.join(clash.select(F.col("digest").alias("text_sha256")).distinct(), "text_sha256", "left_anti").unionByName(_by_bytes(rows, clash))


def _clashes(rows: DataFrame, groups: DataFrame) -> DataFrame | None:
    """The byte check: digests that stand for more than one text, or None.

    Only texts of groups of two or more are compared.  Equal texts are put together
    before the shuffle, so that a large group sends a row from each task.
    """
    several = groups.filter("n > 1").select("digest")
    side = F.broadcast(several) if several.count() <= BROADCAST_GROUPS else several
    compared = rows.select("digest", "norm").join(side, "digest", "left_semi")
    differ = saved(compared.groupBy("digest", "norm").count().groupBy("digest").count().filter("count > 1").select("digest"), "clashes")
    return differ if differ.take(1) else None


def _by_bytes(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """Groups by the text itself, for the digests of clash only."""
    rows = rows.join(clash, "digest", "left_semi")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("anonymous"), "doc_id"))
    groups = rows.groupBy("norm").agg(F.count("*").alias("n"), best.alias("best"))
    return rows.join(groups, "norm").select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.expr("doc_id <=> best.doc_id").alias("kept"), F.col("digest").alias("text_sha256"), F.col("old").alias("from_snapshot"))


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One table as a snapshot and a batch after it: together every row."""
    later = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return docs.filter(~later), docs.filter(later)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Null texts are empty ones, which are one group; of rows without doc_id those stay
    whose group has no other; an empty table gives none.  Of rows that repeat both an id and its text one is left, whichever comes first.
    """
    old, new = halves(columns(docs, doc_id="long", text="string"))
    _id, _sha, kept, times = fresh(docs, "id", "sha", "kept", "times")

    def listed() -> DataFrame:
        rows = exact_dedup(new, old).select(F.col("doc_id").alias(_id), F.col("text_sha256").alias(_sha), F.col("kept").alias(kept))
        return rows.groupBy(_id, _sha, kept).agg(F.count("*").alias(times)).filter(~F.col(kept) | (F.col(times) > 1))

    report = only_result(listed, "report")  # the texts that it kept are deleted with it
    # Tables of their own, so that Spark sees how small they are, where they are, and sends them to all.
    dropped = saved(report.filter(~F.col(kept)).select(_id, _sha), "dropped")
    again = saved(report.filter(kept).select(_id, _sha), "repeated")
    # Only rows whose id may be in one of them are joined: whole texts of the others stay where they are.
    docs, others = by_id(docs, report, _id)
    text, doc_id = (docs[c] if c in docs.columns else F.lit(None) for c in ("text", "doc_id"))
    same = doc_id.cast("long").eqNullSafe(F.col(_id)) & (F.sha2(normalised(text.cast("string")), 256) == F.col(_sha))
    out = docs.join(dropped, same, "left_anti")
    if not again.take(1):
        return others.unionByName(out)
    several = out.join(again, same, "left_semi")
    once = several.select(whole_rows(several).alias("row"), doc_id.alias("id"), F.sha2(normalised(text.cast("string")), 256).alias("sha")).dropDuplicates(["id", "sha"])
    return others.unionByName(out.join(again, same, "left_anti")).unionByName(once.select("row.*"))
