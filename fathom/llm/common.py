"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more rows than this and more than one in HOT_KEYS of all
#: rows, so there are never more than HOT_KEYS hot keys and they can be broadcast.
HOT_ROWS, HOT_KEYS = 1000, 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a
    temporary folder is made and remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("fathom.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("fathom.shared.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A name that nothing has yet in the shared folder, for a table or more."""
    path = f"{shared_folder(spark)}/fathom-{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows reads the table, and a lost executor costs
    at most the tasks that it was running.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The folders that `saved` wrote within the innermost `only_result` that this thread runs.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def only_result(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows, written down; the tables that were saved on the way are deleted then.

    The result needs none of them once it is written, so later stages find the shared
    folder as empty as it can be.
    """
    outer = _written.set([])
    try:
        found = make()
        spark = found.sparkSession
        path = f"{shared_folder(spark)}/fathom-{name}-{uuid.uuid4().hex}"
        found.write.parquet(path)
    finally:
        folders = _written.get()
        _written.reset(outer)
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if (written := _written.get()) is not None:
        written.append(path)
    return spark.read.schema(found.schema).parquet(path)


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a column that df lacks is null.

    Operators start from this, so further columns of any name do no harm.
    """
    have = set(df.columns)
    return df.select(*[(df[c] if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it one that df doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def whole_rows(df: DataFrame) -> Column:
    """All columns of df as one struct, so that none meets a name of the operator's own."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def filed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the place of each row: the file that it is read from, and its row there.

    Files that one write made are named by partition, so their order is the order of
    the rows that were written.  Where rows don't come from files as they are, their
    partitions stand for files.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        file, row = meta["file_name"], meta["row_index"]
        docs.select(file, row)
    except AnalysisException:
        file, row = F.lpad(F.spark_partition_id().cast("string"), 10, "0"), F.monotonically_increasing_id() % (1 << 33)
    named = [(docs[c] if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in (("doc_id", "long"), ("text", "string"))]
    return docs.select(*named, file.alias("file"), row.alias("row"))


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: str, names: Iterable[str] = ()) -> DataFrame:
    """Inner join with a right side that has one row for each key.

    rows: the column of right that tells how many rows of left have the key.  The
    few hot keys (at most HOT_KEYS, see there) go by broadcast, so that a key with a
    third of all rows is never gathered in one task; all others are shuffled.
    Both sides are read twice where there are hot keys: pass saved tables.
    """
    right = right.select(key, rows, *names)
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.filter(F.col(rows) > limit)
    if not hot.take(1):
        return left.join(right, key)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(right.filter(F.col(rows) <= limit), key))


def salt(*cols: Column | str, of: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(of)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a long, b long): rows (node, root).

    root is the least node of the component; every node of an edge has one row.
    Alternating large-star and small-star rounds (Kiveris and others, 2014): all
    steps are joins and partial aggregates, each round is written to the shared
    folder, and rounds grow with the logarithm of the longest chain.  Loops (a = b)
    are allowed; null ends are not links and are left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops, mark = saved(loops.distinct(), "loops"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = saved(small.select("e.a", F.col("e.m").alias("b")).filter("a <> b").distinct(), "edges")
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    alone = loops.join(found, "node", "left_anti").withColumn("root", F.col("node"))
    return found.unionByName(alone)
