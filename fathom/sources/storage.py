"""Tables in a warehouse folder: Parquet parts, marks of deleted rows, and a numbered catalog.

Everything goes through Spark's file systems, so the folder may be anywhere that
Spark reads.  An append adds a part, a deletion adds a bitmap of row numbers; the
catalog then names them.  Each change is a new catalog file, created only if no
other writer has taken its number, else made again on top of what that one wrote.
Derived tables (the indexes) belong to one part and hold for as long as it does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import one_of

ROW = "_rid"  # order of insertion
#: A row's number within its part; the part's base makes it _rid.
PLACE = "_row"
#: Parts of a table from which on the newer half is merged, and marks of deletions from which on they are.
MOST_PARTS, MOST_MARKS = 16, 16
#: A share of deleted rows from which on the table's parts are written anew without them.
MOST_DEAD = 0.25
#: Bitmaps of deleted rows, of 4 KB each, that are broadcast: more of them are joined by a shuffle.
BROADCAST_BITMAPS = 8192
#: Catalogs that vacuum leaves, and tries of a change against other writers.
KEPT_CATALOGS, TRIES = 8, 64
#: Rows of a page of a derived table.
PAGE_ROWS = 1000
TYPES = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(), "VECTOR": T.ArrayType(T.DoubleType()), "BOOL": T.BooleanType()}

R = TypeVar("R")


@dataclass
class Part:
    path: str
    base: int = 0
    rows: int = 0


@dataclass
class Marks:
    """A table of bitmaps (bucket, bits) of deleted rows."""

    path: str
    rows: int = 0
    buckets: int = 0


@dataclass
class Table:
    name: str
    columns: list[tuple[str, str]]
    indexes: dict[str, dict[str, Any]] = field(default_factory=dict)  # column -> kind, options
    parts: list[Part] = field(default_factory=list)  # of the present snapshot
    marks: list[Marks] = field(default_factory=list)
    version: int = 0
    next_row: int = 0
    ledger: dict[str, int] = field(default_factory=dict)  # stream -> its last batch that is in the table

    def __post_init__(self):
        self.columns = [tuple(c) for c in self.columns]
        self.parts = [p if isinstance(p, Part) else Part(**p) for p in self.parts]
        self.marks = [m if isinstance(m, Marks) else Marks(**m) for m in self.marks]

    def fields(self) -> T.StructType:
        # A VECTOR column may hold names of media files, kept beside the vectors.
        out = T.StructType([T.StructField(n, TYPES[k]) for n, k in self.columns])
        for n, k in self.columns:
            if k == "VECTOR":
                out.add(f"{n}_ref", T.StringType())
        return out

    def schema(self) -> T.StructType:
        return self.fields().add(ROW, T.LongType())

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)

    @property
    def dead(self) -> int:
        return sum(m.rows for m in self.marks)


class Storage:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.number = 0  # of the catalog that was read
        self.written = 0  # files, since the session began
        self._schemas: dict[str, T.StructType] = {}  # of derived tables, which never change
        self.refresh()

    # Files
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> str:
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Writes a file whole, or not at all where it exists: False."""
        fs, new = self._path(f"_catalog/{uuid.uuid4().hex}.new")
        stream = fs.create(new, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(self._path(name)[1]), options)
            return True
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False

    def _count(self, folder: str) -> None:
        fs, path = self._path(folder)
        self.written += max(0, fs.getContentSummary(path).getFileCount() - 1)  # all but _SUCCESS

    # Catalog
    def _numbers(self) -> list[int]:
        fs, path = self._path("_catalog")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def refresh(self) -> None:
        """Takes over what other writers have committed."""
        numbers = self._numbers()
        if numbers and numbers[-1] != self.number:
            self.number = numbers[-1]
            self.tables = {x["name"]: Table(**x) for x in json.loads(self._read(f"_catalog/{self.number:012d}.json"))}

    def commit(self, change: Callable[[dict[str, Table]], R]) -> R:
        """Makes change(tables) on the latest catalog and writes the next one; again, where another writer was faster."""
        for _ in range(TRIES):
            self.refresh()
            tables = {n: Table(**asdict(t)) for n, t in self.tables.items()}
            out = change(tables)
            if self._create(f"_catalog/{self.number + 1:012d}.json", json.dumps([asdict(t) for t in tables.values()])):
                self.number, self.tables = self.number + 1, tables
                return out
        raise RuntimeError(f"{TRIES} other writers were faster")

    def get(self, name: str) -> Table:
        return _table(self.tables, name)

    def create(self, name: str, columns: list[tuple[str, str]]) -> Table:
        if len({c for c, _ in columns}) < len(columns):
            raise ValueError("a column is named twice")

        def change(tables: dict[str, Table]) -> None:
            if name in tables:
                raise ValueError(f"table {name} exists")
            tables[name] = Table(name, columns)

        self.commit(change)
        return self.tables[name]

    def drop(self, name: str) -> None:
        if name in self.tables:
            self.commit(lambda tables: tables.pop(name, None))
            fs, path = self._path(name)
            fs.delete(path, True)

    def add_index(self, name: str, column: str, kind: str, options: dict[str, Any]) -> None:
        def change(tables: dict[str, Table]) -> None:
            table = _table(tables, name)
            if column not in dict(table.columns):
                raise ValueError(f"no column {name}.{column}")
            table.indexes[column] = {"kind": kind, "options": options}
            table.version += 1

        self.commit(change)

    # Rows
    def part(self, name: str, part: Part) -> DataFrame:
        """All rows of a part, deleted ones too."""
        fields = self.get(name).fields()
        df = self.spark.read.schema(T.StructType([*fields, T.StructField(PLACE, T.LongType())])).parquet(f"{self.folder}/{part.path}")
        return df.select(*fields.names, (F.col(PLACE) + part.base).alias(ROW))

    def read(self, name: str, where: Callable[[Part], Column] | None = None) -> DataFrame:
        """The rows of a table; where: a condition on PLACE by part, which reaches the files' statistics."""
        table = self.get(name)
        if not table.parts:
            return self.spark.createDataFrame([], table.schema())
        fields, out = table.fields(), []
        for part in table.parts:
            df = self.spark.read.schema(T.StructType([*fields, T.StructField(PLACE, T.LongType())])).parquet(f"{self.folder}/{part.path}")
            df = df if where is None else df.filter(where(part))
            out.append(df.select(*fields.names, (F.col(PLACE) + part.base).alias(ROW)))
        return self.alive(name, reduce(DataFrame.unionByName, out))

    def rows_of(self, name: str, ids: list[int]) -> DataFrame:
        """The rows of a few numbers: parts and row groups without any of them aren't read."""
        table = self.get(name)
        return self.read(name, lambda part: one_of(PLACE, [i - part.base for i in ids])) if ids else self.spark.createDataFrame([], table.schema())

    def bitmaps(self, name: str) -> DataFrame | None:
        """(_bucket, _bits) of all deleted rows, a row a bucket."""
        marks = self.get(name).marks
        if not marks:
            return None
        df = self.spark.read.schema("_bucket long, _bits binary").parquet(*[f"{self.folder}/{m.path}" for m in marks])
        return df if len(marks) == 1 else df.groupBy("_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))

    def alive(self, name: str, df: DataFrame, row: str = ROW) -> DataFrame:
        """df without the rows whose number `row` is of a deleted row."""
        bitmaps = self.bitmaps(name)
        return df if bitmaps is None else self.marked(name, df, bitmaps, row, False)

    def marked(self, name: str, df: DataFrame, bitmaps: DataFrame, row: str = ROW, deleted: bool = True) -> DataFrame:
        """The rows of df that are in the bitmaps, or that are not."""
        few = sum(m.buckets for m in self.get(name).marks) <= BROADCAST_BITMAPS
        bitmaps = F.broadcast(bitmaps) if few else bitmaps
        at = F.bitmap_bit_position(F.col(row))
        byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("bit_get", byte, (at % 8).cast("int")) == 1
        joined = df.join(bitmaps, F.bitmap_bucket_number(F.col(row)) == F.col("_bucket"), "inner" if deleted else "left")
        return joined.filter(hit if deleted else F.col("_bits").isNull() | ~hit).select(*df.columns)

    def append(self, name: str, rows: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Add rows, in their order where they are few; one bulk write whatever their number.

        The rows are evaluated once; their number comes from what was written.  stream,
        batch: a batch of a stream that is in the table already is not added again.
        """
        table = self.get(name)
        if stream is not None and table.ledger.get(stream, -1) >= batch:
            return 0
        path, fields = f"{name}/p{uuid.uuid4().hex}", table.fields()
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields], F.monotonically_increasing_id().alias(PLACE)).write.parquet(f"{self.folder}/{path}")
        self._count(path)
        n, last = self.spark.read.parquet(f"{self.folder}/{path}").agg(F.count("*"), F.max(PLACE)).first()

        def change(tables: dict[str, Table]) -> int:
            table = _table(tables, name)
            if stream is not None:
                if table.ledger.get(stream, -1) >= batch:  # the same batch by another writer
                    return 0
                table.ledger[stream] = batch
            if n:
                table.parts.append(Part(path, table.next_row, n))
                table.version, table.next_row = table.version + 1, table.next_row + last + 1
            return n

        added = self.commit(change)
        if len(self.get(name).parts) >= MOST_PARTS:
            self._merge(name, MOST_PARTS // 2)
        return added

    def delete(self, name: str, hits: DataFrame) -> int:
        """Marks the rows of hits(_rid) as deleted; how many: a bitmap is written, and nothing else.

        Marks are merged when they are many.  When a large share of the rows is gone, the
        parts are written anew without them.
        """
        path = f"{name}/d{uuid.uuid4().hex}"
        marks = hits.groupBy(F.bitmap_bucket_number(ROW).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ROW)).alias("_bits"))
        marks.write.parquet(f"{self.folder}/{path}")
        n, buckets = self.spark.read.parquet(f"{self.folder}/{path}").agg(F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0)), F.count("*")).first()
        if not n:
            return 0
        self._count(path)

        def change(tables: dict[str, Table]) -> None:
            table = _table(tables, name)
            table.marks.append(Marks(path, n, buckets))
            table.version += 1

        self.commit(change)
        table = self.get(name)
        if table.dead > MOST_DEAD * table.rows:
            self._merge(name, 0)
        elif len(table.marks) >= MOST_MARKS:
            self._merge_marks(name)
        return n

    def _merge_marks(self, name: str) -> None:
        old, path = {m.path for m in self.get(name).marks}, f"{name}/d{uuid.uuid4().hex}"
        self.bitmaps(name).write.parquet(f"{self.folder}/{path}")
        self._count(path)
        n, buckets = self.spark.read.parquet(f"{self.folder}/{path}").agg(F.sum(F.bitmap_count("_bits")), F.count("*")).first()

        def change(tables: dict[str, Table]) -> None:
            table = _table(tables, name)
            if old <= {m.path for m in table.marks}:
                table.marks = [*(m for m in table.marks if m.path not in old), Marks(path, n, buckets)]

        self.commit(change)

    def _merge(self, name: str, kept: int) -> None:
        """Parts from the kept-th on become one, without deleted rows; numbers of rows stay."""
        table = self.get(name)
        old, path, marks = {p.path for p in table.parts[kept:]}, f"{name}/p{uuid.uuid4().hex}", {m.path for m in table.marks}
        merged = reduce(DataFrame.unionByName, [self.part(name, p) for p in table.parts[kept:]])
        self.alive(name, merged).withColumnRenamed(ROW, PLACE).write.parquet(f"{self.folder}/{path}")
        self._count(path)
        n = self.spark.read.parquet(f"{self.folder}/{path}").count()

        def change(tables: dict[str, Table]) -> None:
            table = _table(tables, name)
            if old <= {p.path for p in table.parts}:  # else another writer has merged them
                table.parts = [*(p for p in table.parts if p.path not in old), Part(path, 0, n)]
                if not kept:  # marks that were there are worked in; later ones still name rows by their numbers
                    table.marks = [m for m in table.marks if m.path not in marks]
                table.version += 1

        self.commit(change)

    # Derived tables
    def _built(self, at: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The derived table of that name, built where it isn't there; by: a column whose values are folders."""
        fs, path = self._path(f"{at}/_SUCCESS")
        if not fs.exists(path):
            made = build()
            # Short pages, so that looking up a few rows reads few.
            writer = made.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS)
            (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/{at}")
            self._count(at)
            self._schemas[at] = made.schema
        if at not in self._schemas:
            try:
                self._schemas[at] = self.spark.read.parquet(f"{self.folder}/{at}").schema
            except AnalysisException:  # no row, so no file in any folder
                self._schemas[at] = build().schema
        return self.spark.read.schema(self._schemas[at]).parquet(f"{self.folder}/{at}")

    def derived(self, name: str, what: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from the present snapshot, built when first asked for."""
        return self._built(f"{name}/i{self.get(name).version}-{what}", build)

    def each_part(self, name: str, what: str, build: Callable[[DataFrame], DataFrame], by: str | None = None) -> list[DataFrame]:
        """For each part a table that follows from it, all its rows: build(rows), when first asked for."""
        return [self._built(f"{p.path}-{what}", lambda p=p: build(self.part(name, p)), by) for p in self.get(name).parts]

    def vacuum(self, name: str) -> int:
        """Delete folders that the catalog no longer needs; how many.  For times without readers and writers."""
        self.refresh()
        table, gone = self.get(name), 0
        fs, path = self._path(name)
        named = [x.path for x in (*table.parts, *table.marks)]
        for status in fs.listStatus(path) if fs.exists(path) else []:
            at = f"{name}/{status.getPath().getName()}"
            if not (at.startswith(f"{name}/i{table.version}-") or any(at == p or at.startswith(f"{p}-") for p in named)):
                gone += bool(fs.delete(status.getPath(), True))
        for number in self._numbers()[:-KEPT_CATALOGS]:
            fs.delete(self._path(f"_catalog/{number:012d}.json")[1], False)
        return gone


def _table(tables: dict[str, Table], name: str) -> Table:
    if name not in tables:
        raise ValueError(f"no table {name}")
    return tables[name]
