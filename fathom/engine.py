"""The engine: SQL text in, a result with rows, plan lines and timings out."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import Analyzer, name_of, with_chunks
from .operators import fusion, impact, ivf, lookup, spatial, vector
from .operators import text as text_ops
from .plans import explain
from .plans.parser import CreateIndex, CreateTable, Delete, DropTable, Hybrid, Insert, Knn, Match, Select, SqlError, parse
from .plans.planner import Plan, column_of, kinds, plan_select, predicate_of
from .sources import layout
from .sources.storage import ROW, Storage


#: Results that are looked up by their numbers; more are joined.
MOST_LOOKED_UP = 500

Fuse = Callable[[list[DataFrame], int], DataFrame]


@dataclass
class Result:
    """df is lazy; rows() runs it once and then knows time and plan lines."""

    df: DataFrame
    index_type: str | None = None
    predicate_kind: str | None = None
    affected: int | None = None
    plan: Plan | None = None
    lines: list[tuple[int, str]] = field(default_factory=list)
    elapsed_ms: float = 0.0
    reads: int = 0  # files
    writes: int = 0
    done: Callable[[Result], None] | None = None
    _rows: list[Row] | None = None

    def rows(self) -> list[Row]:
        if self._rows is None:
            began = time.perf_counter()
            self._rows = self.df.collect()
            self.elapsed_ms = round((time.perf_counter() - began) * 1e3, 3)
            if self.plan:
                self.reads = explain.files_read(self.df)
                self.lines = explain.select_lines(self.plan, explain.Cost(self.elapsed_ms, len(self._rows), self.reads, self.writes))
            if self.done:
                self.done(self)
        return self._rows

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def spark_plan(self) -> str:
        """Spark's own plan; after rows() the one that ran."""
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def explain(self) -> list[tuple[int, str]]:
        self.rows()
        return self.lines


class Engine:
    """Tables, indexes and queries over a warehouse folder.

    resolver: turns a media file name into a vector (see sources.media); analyzer,
    chunker: how texts become terms and chunks; fuse: how a hybrid search joins two
    rankings (key, score) to the k best.
    """

    def __init__(self, spark: SparkSession, warehouse: str, resolver: Any = None, analyzer: Analyzer = "rule", chunker: text_ops.Chunker = with_chunks, fuse: Fuse = fusion.reciprocal_rank):
        self.chunker, self.fuse = chunker, fuse
        self.spark, self.storage, self.resolver, self.analyzer = spark, Storage(spark, warehouse), resolver, analyzer
        self.last_sql: str | None = None
        self._centroids: dict[str, np.ndarray] = {}
        self._indexes: dict[tuple[str, str, int], impact.ImpactIndex] = {}  # the last of each text column
        self.reset_metrics()

    def reset_metrics(self) -> None:
        """Totals over statements: their number, milliseconds, and files read and written."""
        self.totals = {"statements": 0, "elapsed_ms": 0.0, "reads": 0, "writes": 0}

    def _counted(self, result: Result) -> None:
        self.totals["reads"] += result.reads

    def tables(self) -> list[str]:
        return sorted(self.storage.tables)

    def sql(self, text: str) -> Result:
        self.last_sql, began, written = text, time.perf_counter(), self.storage.written
        ast = parse(text)
        self.storage.refresh()
        run = {CreateTable: self._create, DropTable: self._drop, CreateIndex: self._index, Insert: self._insert, Delete: self._delete, Select: self._select}[type(ast)]
        out = run(ast)
        self.totals["statements"] += 1
        self.totals["elapsed_ms"] += (time.perf_counter() - began) * 1e3
        self.totals["writes"] += self.storage.written - written
        out.writes, out.done = self.storage.written - written, self._counted
        return out

    # Definition
    def _done(self, label: str, table: str, affected: int, began: float, cond: str | None = None, written: int | None = None) -> Result:
        written = self.storage.written if written is None else written
        ms = round((time.perf_counter() - began) * 1e3, 3)
        df = self.spark.createDataFrame([(affected,)], "affected long")
        cost = explain.Cost(ms, 1, 0, self.storage.written - written)
        return Result(df, affected=affected, lines=explain.write_lines(label, table, cost, affected, cond), elapsed_ms=ms, _rows=[Row(affected=affected)])

    def _create(self, ast: CreateTable) -> Result:
        began = time.perf_counter()
        self.storage.create(ast.table, ast.columns)
        return self._done("Create Table", ast.table, 0, began)

    def _drop(self, ast: DropTable) -> Result:
        began = time.perf_counter()
        self.storage.drop(ast.table)
        return self._done("Drop Table", ast.table, 0, began)

    def _index(self, ast: CreateIndex) -> Result:
        began, kind = time.perf_counter(), ast.kind.lower()
        if kind not in kinds():
            raise SqlError(f"unknown index kind: {ast.kind}")
        for option in ("vocabulary", "lists", "probes"):
            size = ast.options.get(option, 1)
            if isinstance(size, bool) or not isinstance(size, int) or size < 1:
                raise SqlError(f"{option} must be a positive whole number")
        self.storage.add_index(ast.table, ast.column, kind, {k: ast.options[k] for k in ("vocabulary", "exact", "lists", "probes") if ast.options.get(k)})
        return self._done(f"Create Index using {kind}", ast.table, 0, began)

    # Changes
    def _vector(self, value: Any) -> tuple[list[float] | None, str | None]:
        if not isinstance(value, str):
            return None if value is None else [float(v) for v in value], None
        if self.resolver is None:
            raise ValueError(f"no resolver for media file {value}")
        return [float(v) for v in self.resolver.resolve(value)], value

    def _insert(self, ast: Insert) -> Result:
        began, table = time.perf_counter(), self.storage.get(ast.table)
        kinds = dict(table.columns)
        names = ast.columns or list(kinds)
        if unknown := [n for n in names if n not in kinds]:
            raise SqlError(f"no column {ast.table}.{unknown[0]}")
        rows = []
        for values in ast.rows:
            if len(values) != len(names):
                raise SqlError(f"{len(values)} values for {len(names)} columns")
            row: dict[str, Any] = {}
            for name, value in zip(names, values, strict=True):
                if kinds[name] == "VECTOR":
                    row[name], row[f"{name}_ref"] = self._vector(value)
                elif kinds[name] == "FLOAT" and isinstance(value, int):
                    row[name] = float(value)
                else:
                    row[name] = value
            rows.append(row)
        fields = table.fields()
        df = self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields).coalesce(1)
        written = self.storage.written
        return self._done("Insert", ast.table, self.storage.append(ast.table, df), began, written=written)

    def load(self, name: str, df: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Bulk insert of a DataFrame: one write, whatever its size; how many rows.

        stream, batch: a batch of a stream that the table has already adds nothing.
        """
        have, fields = set(df.columns), self.storage.get(name).fields()
        rows = df.select(*[(df[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        return self.storage.append(name, rows, stream, batch)

    def _delete(self, ast: Delete) -> Result:
        """Deletes what equality and range predicates select, everywhere; without one, nothing."""
        began = time.perf_counter()
        kind, p = predicate_of(ast.where)
        if kind is None:
            return self._done("Delete", ast.table, 0, began)
        if kind not in ("equality", "range"):
            raise SqlError("DELETE takes a comparison or BETWEEN")
        df, written = layout.layout(self.storage, ast.table, column_of(kind, p), p), self.storage.written
        affected = self.storage.delete(ast.table, self._filter(ast.table, df, kind, p).select(ROW))
        return self._done("Delete", ast.table, affected, began, explain.condition(kind, p), written)

    def _filter(self, table: str, df: DataFrame, kind: str, p: Any) -> DataFrame:
        column = column_of(kind, p)
        declared = dict(self.storage.get(table).columns).get(column)
        if declared is None:
            raise SqlError(f"no column {table}.{column}")
        if kind == "range":
            return df.filter(p[1].column(F.col(column)))
        if declared == "VECTOR" and isinstance(p.value, str):
            return df.filter(F.col(f"{column}_ref") == p.value)
        if declared == "VECTOR":
            return df.filter(F.col(column) == F.array(*[F.lit(float(v)) for v in p.value]))
        return lookup.equal(df, column, p.value)

    # Queries
    def _select(self, ast: Select) -> Result:
        table = self.storage.get(ast.table)
        kinds = dict(table.columns)
        if unknown := [c for c in ast.columns if c != "*" and c not in kinds]:
            raise SqlError(f"no column {ast.table}.{unknown[0]}")
        plan = plan_select(ast, {c: i["kind"] for c, i in table.indexes.items()})
        wanted = list(kinds) if ast.columns == ["*"] else ast.columns
        p, k = plan.predicate, plan.k
        if plan.kind == "hybrid":
            df = self._hybrid(ast.table, p, wanted)
        elif plan.kind == "text":
            df = self._match(ast.table, p, k).select(*wanted, "score")
        elif plan.kind == "knn":
            df = self._nearest_points(ast.table, p, wanted) if plan.access == "rtree" else self._knn(ast.table, p, wanted)
        else:
            df = self._scan(plan, next(iter(table.indexes), None)).select(*wanted)
        return Result(df, plan.access, plan.kind, plan=plan)

    def _scan(self, plan: Plan, first_index: str | None) -> DataFrame:
        column = column_of(plan.kind, plan.predicate)
        if plan.kind == "spatial":
            p, held = plan.predicate, layout.points(self.storage, plan.table, column)
            df = self._near(plan.table, column)[0] if held is None else held.within(p.low, p.high)
            df = spatial.within(df, layout.axes_of(df), p.low, p.high)
        elif plan.kind:
            df = self._filter(plan.table, layout.layout(self.storage, plan.table, column, plan.predicate), plan.kind, plan.predicate)
            df = df.orderBy(column, ROW)
        else:
            df = self.storage.read(plan.table)
            df = df.orderBy(first_index, ROW) if first_index and self.storage.get(plan.table).indexes[first_index]["kind"] not in ("inverted", "knn") else df.orderBy(ROW)
        return df if plan.k is None else df.limit(plan.k)

    def _near(self, table: str, column: str) -> tuple[DataFrame, list[str]]:
        """Coordinates of a column that has no spatial layout."""
        return self.storage.read(table).select("*", F.get(F.col(column), F.lit(0)).alias("_x0"), F.get(F.col(column), F.lit(1)).alias("_x1")), ["_x0", "_x1"]

    def _nearest_points(self, table: str, p: Knn, wanted: list[str]) -> DataFrame:
        held = layout.points(self.storage, table, p.column)
        df = self._near(table, p.column)[0] if held is None else held.near(p.query, p.k)
        return spatial.nearest_points(df, layout.axes_of(df), p.query, p.k, (ROW,)).select(*wanted, "distance")

    # Vectors
    def _key(self, table: str, column: str) -> F.Column:
        """A vector row's key: its media file's name, else its first column."""
        first = self.storage.get(table).columns[0][0]
        return F.coalesce(F.col(f"{column}_ref"), F.col(first).cast("string"))

    def _keyed(self, table: str, rows: DataFrame, column: str) -> DataFrame:
        return rows.filter(F.col(column).isNotNull()).select(self._key(table, column).alias("key"), F.col(ROW).alias("rid"), F.col(column).alias("vec"))

    def _lists(self, table: str, column: str) -> tuple[list[DataFrame], list[DataFrame], np.ndarray]:
        """Vectors in lists and keys in order, part by part, and the centroids: those of the first part."""
        parts, spark = self.storage.get(table).parts, self.spark
        lists = self.storage.get(table).indexes.get(column, {}).get("options", {}).get("lists")

        def fitted() -> DataFrame:
            rows = ivf.fit(self._keyed(table, self.storage.part(table, parts[0]), column), "rid", "vec", lists)
            return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "list int, centre array<double>").coalesce(1)

        at = f"{parts[0].path}-{column}-centroids"
        if at not in self._centroids:
            rows = self.storage._built(at, fitted).orderBy("list").collect()  # MOST_LISTS rows at most
            self._centroids[at] = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))
        centres, name = self._centroids[at], f"{column}-lists-{parts[0].path.rpartition('/')[2]}"

        def laid(rows: DataFrame) -> DataFrame:
            return ivf.assigned(self._keyed(table, rows, column), "vec", centres).hint("rebalance", F.col("_list")).sortWithinPartitions("_list", "key")

        held = self.storage.each_part(table, name, laid, by="_list")
        keys = self.storage.each_part(table, f"{column}-keys", lambda rows: self._keyed(table, rows, column).select("key", "rid").repartitionByRange("key").sortWithinPartitions("key", "rid"))
        return held, keys, centres

    def _nearest(self, table: str, p: Knn) -> list[tuple[str, int, float]] | None:
        """(key, _rid, score) of the k vectors of largest cosine among the lists of an index; None: there is none, or k is large.

        Of rows of one key the last counts.
        """
        query, k = self._vector(p.query)[0], vector.DEFAULT_K if p.k is None else p.k
        index = self.storage.get(table).indexes.get(p.column, {})
        if index.get("kind") != "knn" or not self.storage.get(table).parts or k > MOST_LOOKED_UP:
            return None
        held, keys, centres = self._lists(table, p.column)
        probes = len(centres) if index["options"].get("exact") else index["options"].get("probes")
        lists, take = ivf.probed(query, centres, probes), 2 * k
        while True:
            read = self.storage.alive(table, reduce(DataFrame.unionByName, [h.filter(F.col("_list").isin(lists)) for h in held]), "rid")
            found = vector.cosine_top(read, "key", "vec", query, take, norms="norm", keep=("rid",)).collect()
            asked, latest = sorted({r["key"] for r in found}), {}
            if asked:  # keys are in order in their files
                where = F.col("key").isin(asked) & F.col("key").between(asked[0], asked[-1])
                rows = self.storage.alive(table, reduce(DataFrame.unionByName, [x.filter(where) for x in keys]), "rid").collect()
                for r in rows:
                    latest[r["key"]] = max(r["rid"], latest.get(r["key"], r["rid"]))
            best = [(r["key"], r["rid"], r["score"]) for r in found if latest[r["key"]] == r["rid"]]
            if len(best) >= k:
                return best[:k]
            if len(found) >= take:
                take *= 4
            elif len(lists) <= len(centres):
                lists = ivf.probed(query, centres, 2 * len(lists))  # those that were read have too few
            else:
                return best

    def _ranked(self, table: str, p: Knn) -> DataFrame:
        """The same as rows (key, rid, score), whatever k is."""
        found = self._nearest(table, p)
        if found is not None:
            return self.spark.createDataFrame(found, "key string, rid long, score double")
        rows = self._keyed(table, self.storage.read(table), p.column)
        last = rows.groupBy("key").agg(F.max_by(F.struct("rid", "vec"), "rid").alias("r")).select("key", "r.rid", "r.vec")
        return vector.cosine_top(last, "key", "vec", self._vector(p.query)[0], p.k, keep=("rid",))

    def _knn(self, table: str, p: Knn, wanted: list[str]) -> DataFrame:
        found = self._nearest(table, p)
        if found is not None:
            rows = self._looked_up(table, {rid: {"key": key, "score": score} for key, rid, score in found}, "struct<key:string,score:double>").select("*", "_found.key", "_found.score")
        else:
            rows = self.storage.read(table).join(self._ranked(table, p), F.col(ROW) == F.col("rid"))
        return rows.orderBy(F.desc("score"), "key").select("key", *[F.col(c) for c in wanted if c != "key"], "score")

    # Full text
    def _held(self, table: str, column: str) -> tuple[str, dict[str, Any]]:
        """What names the derived tables of a text column, and its options."""
        return f"{column}-{self.chunker.__name__}-{name_of(self.analyzer)}", self.storage.get(table).indexes.get(column, {}).get("options", {})

    def _text_parts(self, table: str, column: str) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
        """Chunks' vectors, postings and counts of terms, part by part: an INSERT builds those of its own part."""
        name, _ = self._held(table, column)
        each, parts = self.storage.each_part, self.storage.get(table).parts
        vectors = each(table, f"{name}-vectors", lambda rows: impact.vectors(rows, ROW, column, self.analyzer, self.chunker))
        held = dict(zip((p.path for p in parts), vectors, strict=True))
        postings = [self.storage._built(f"{p.path}-{name}-postings", lambda p=p: impact.postings(held[p.path])) for p in parts]
        listed = dict(zip((p.path for p in parts), postings, strict=True))
        heads = [self.storage._built(f"{p.path}-{name}-heads", lambda p=p: impact.heads(held[p.path], listed[p.path])) for p in parts]
        return vectors, postings, heads

    def text_index(self, table: str, column: str) -> text_ops.TextIndex:
        """Chunks and postings of the live rows, as tables to score whole."""
        name, options = self._held(table, column)
        vectors, _, _ = self._text_parts(table, column)
        if not vectors:
            return text_ops.index_text(self.storage.read(table), ROW, column, options.get("vocabulary"), self.analyzer, chunker=self.chunker)
        return text_ops.of_rows(self.storage.alive(table, reduce(DataFrame.unionByName, vectors), "rid"), "rid", options.get("vocabulary"), self.analyzer)

    def impact_index(self, table: str, column: str) -> impact.ImpactIndex | None:
        """The postings by impact, with counts merged from those of the parts; None where the table has no parts."""
        held = self.storage.get(table)
        key = table, self._held(table, column)[0], self.storage.number
        if key in self._indexes:
            return self._indexes[key]
        vectors, postings, heads = self._text_parts(table, column)
        if not vectors:
            return None
        name = key[1]

        def of_rows(ids: list[int] | None) -> DataFrame:
            where = F.lit(True) if ids is None else lookup.one_of("rid", ids)
            return self.storage.alive(table, reduce(DataFrame.unionByName, [v.filter(where) for v in vectors]), "rid")

        def gone() -> list[DataFrame]:
            bitmaps = self.storage.bitmaps(table)
            every = reduce(DataFrame.unionByName, vectors)
            return [] if bitmaps is None else [impact.lost(self.storage.marked(table, every, bitmaps, "rid"))]

        now = self.storage.derived(table, f"{name}-merged", lambda: impact.merged(heads, gone()))
        whole = len(heads) == 1 and not held.marks
        rows = [] if whole else self.storage.derived(table, f"{name}-ratios", lambda: impact.ratios(heads, now)).collect()  # a row a part
        ratios = {r["part"]: (r["least"], r["most"]) for r in rows}
        numbered = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(postings)])
        found = impact.ImpactIndex(of_rows, self.storage.alive(table, numbered, "rid"), reduce(DataFrame.unionByName, heads), now, {i: ratios.get(i, (1.0, 1.0)) for i in range(len(heads))}, {})
        self._indexes = {k: v for k, v in self._indexes.items() if k[:2] != key[:2]} | {key: found}
        return found

    def _top_texts(self, table: str, p: Match, k: int | None) -> list[tuple[int, float, str]] | None:
        """(_rid, score, best chunk) of the k best documents, from the best postings; None: all have to be scored."""
        index = None if k is None or "vocabulary" in self._held(table, p.column)[1] else self.impact_index(table, p.column)
        if index is None:
            return None
        return index.top(text_ops.query_terms(text_ops.TextIndex(index.merged, index.merged, None, self.analyzer), p.terms), k)

    def _match(self, table: str, p: Match, k: int | None) -> DataFrame:
        top = self._top_texts(table, p, k)
        if top is not None and len(top) <= MOST_LOOKED_UP:
            rows = self._looked_up(table, {rid: {"score": score, "best_chunk": chunk} for rid, score, chunk in top}, "struct<score:double,best_chunk:string>")
            return rows.select("*", "_found.score", "_found.best_chunk").drop("_found").orderBy(F.desc("score"), "best_chunk")
        if top is not None:
            found = self.spark.createDataFrame(top, f"{ROW} long, score double, best_chunk string")
        else:
            found = text_ops.match(self.text_index(table, p.column), p.terms, k).select(F.col("doc_id").cast("long").alias(ROW), "score", "best_chunk")
        return self.storage.read(table).join(found, ROW).orderBy(F.desc("score"), "best_chunk")

    def _looked_up(self, table: str, facts: dict[int, dict[str, Any]], kind: str) -> DataFrame:
        """The rows of a few numbers, in one partition, with what is known of each as `_found`."""
        rows = self.storage.rows_of(table, list(facts)).coalesce(1)
        held = F.from_json(F.lit(json.dumps(facts)), f"map<string,{kind}>")  # folded into a constant
        return rows.withColumn("_found", held[F.col(ROW).cast("string")])

    def _hybrid(self, table: str, p: Hybrid, wanted: list[str]) -> DataFrame:
        """Both searches, fused by reciprocal ranks; rows by the media column's key."""
        fetch = p.k * fusion.OVERFETCH
        seen = self._ranked(table, Knn(p.media_column, p.file, fetch)).drop("rid")
        texts = self._match(table, Match(p.text_column, p.terms), fetch).withColumn("key", self._key(table, p.media_column))
        texts = texts.groupBy("key").agg(F.max("score").alias("score"))
        fused = self.fuse([seen, texts], p.k).withColumnRenamed("score", "fused_score")
        scores = fused.join(seen.withColumnRenamed("score", "visual_score"), "key", "left").join(texts.withColumnRenamed("score", "text_score"), "key", "left")
        last = Window.partitionBy("key").orderBy(F.desc(ROW))
        base = self.storage.read(table).withColumn("key", self._key(table, p.media_column)).join(F.broadcast(scores), "key", "right")
        rows = base.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        names = [F.coalesce(F.col(f"{c}_ref"), F.col(c).cast("string")).alias(c) if c == p.media_column else F.col(c) for c in wanted]
        return rows.orderBy(F.desc("fused_score"), "key").select(*names, "fused_score", "visual_score", "text_score")
