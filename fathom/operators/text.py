"""Full-text search: chunks, postings, TF-IDF and cosine ranking.

An index is a set of tables.  Building them is an explode and grouped counts, whose
shuffles sort, spill and merge; a query touches the postings of its terms alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WINDOW, Analyzer, Counted, cut, spread, spread_to_keep, terms, with_chunks

#: A way to cut texts, as with_chunks does.
Chunker = Callable[[DataFrame, str, list[str], int], DataFrame]


#: Chunks that a task sends on at once.
HELD_CHUNKS = 4096
#: A capped vocabulary of up to so many terms is broadcast, and weights of as many frequent terms at most.
BROADCAST_TERMS = 500_000


@dataclass
class TextIndex:
    """chunks(doc_id, chunk_no, chunk_id), postings(term, chunk_id, tf), the cap, N and the analyzer."""

    chunks: DataFrame
    postings: DataFrame
    vocabulary: int | None = None
    analyzer: Analyzer = "rule"
    rows: DataFrame | None = None  # of term_rows, from which both follow

    def posting_files(self) -> int:
        """How many files hold the postings."""
        return len(self.postings.inputFiles())

    def document_norm(self, chunk_id: str) -> float:
        """The length of one chunk's weighted terms; 0 where it has none."""
        row = self.norms(self.chunks.filter(F.col("chunk_id") == chunk_id).select("chunk_id")).first()
        return row["norm"] if row else 0.0

    def visible(self, of: DataFrame | None = None) -> DataFrame:
        """The postings, or those in `of`, of the `vocabulary` most frequent terms, ties by term; all without a cap."""
        of = self.postings if of is None else of
        if self.vocabulary is None:
            return of
        top = self.postings.groupBy("term").agg(F.sum("tf").alias("cf")).orderBy(F.desc("cf"), "term").limit(self.vocabulary).select("term")
        return of.join(F.broadcast(top) if self.vocabulary <= BROADCAST_TERMS else top, "term", "left_semi")

    def idf(self, of: DataFrame | None = None) -> DataFrame:
        """(term, df, idf): ln((N + 1) / (df + 1)) + 1 over N chunks."""
        n = max(self.chunks.count(), 1)
        if of is None:
            plain = self.rows is not None and self.vocabulary is None
            of = self.rows.select(F.explode("terms").alias("term")) if plain else self.visible()
        counted = of.groupBy("term").agg(F.count("*").alias("df"))
        return counted.withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)

    def norms(self, of: DataFrame | None = None) -> DataFrame:
        """(chunk_id, norm): the length of each chunk's weighted terms; of the chunks in of(chunk_id) alone, if given."""
        held = self.postings if of is None else self.postings.join(of, "chunk_id", "left_semi")
        return lengths(held, self.idf().persist(), ["chunk_id"])


def lengths(held: DataFrame, weights: DataFrame, chunk: list[str], **sums: Column) -> DataFrame:
    """(chunk, norm, sums) of held(chunk, term, tf) by weights(term, df, idf), and sums over postings beside.

    weights is read several times.  Those of frequent terms are broadcast, less than
    BROADCAST_TERMS as each has more than that part of all postings; only postings of the
    other terms, about a tenth, are shuffled.
    """
    least = (weights.agg(F.sum("df")).first()[0] or 0) / BROADCAST_TERMS
    often, w = F.broadcast(weights.filter(F.col("df") > least).select("term", "idf")), F.col("tf") * F.col("idf")

    def added(of: DataFrame) -> DataFrame:
        return of.groupBy(*chunk).agg(F.sum(w * w).alias("squares"), *[F.sum(c).alias(name) for name, c in sums.items()])

    out = added(held.join(often, "term"))
    if least >= 1:
        rest = held.join(F.broadcast(often.select("term")), "term", "left_anti").join(weights.filter(F.col("df") <= least).select("term", "idf"), "term")
        both = out.unionByName(added(rest)).groupBy(*chunk)
        out = both.agg(F.sum("squares").alias("squares"), *[F.sum(name).alias(name) for name in sums])
    return out.select(*chunk, F.sqrt("squares").alias("norm"), *sums)


def chunk_table(df: DataFrame, key: str, text: str, window: int = WINDOW, chunker: Chunker = with_chunks) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, chunk): a lone chunk has the document's id, others add #number."""
    named = spread(df).select(F.col(key).cast("string").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    each = cut_rows(named, "doc_id", window) if chunker is with_chunks else chunked(named, "doc_id", chunker, window)
    return each.select("doc_id", "chunk_no", chunk_name("doc_id", "chunks").alias("chunk_id"), "chunk")


def chunk_name(key: str, chunks: str) -> Column:
    return F.when(F.col(chunks) == 1, F.col(key).cast("string")).otherwise(F.concat_ws("#", F.col(key).cast("string"), F.col("chunk_no").cast("string")))


def chunked(df: DataFrame, key: str, chunker: Chunker, window: int = WINDOW) -> DataFrame:
    """(key, chunks, chunk_no, chunk) of df(key, text): chunks is their number."""
    return chunker(df, "text", [key], window).select(key, F.size("chunks").alias("chunks"), F.posexplode("chunks").alias("chunk_no", "chunk"))


def _by_row(df: DataFrame, key: str, each: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """(key, chunks, chunk_no, fields): each(text) gives a tuple of fields for each of a text's chunks."""
    names = [key, "chunks", "chunk_no", *(f for f, _, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A text at a time, in batches of some size, so that what is held doesn't grow with the batch.
            at, many, numbers, columns = [], [], [], [[] for _ in fields]
            for i, text in enumerate(b.column("text")):
                found = each(text.as_py())
                at += [i] * len(found)
                many += [len(found)] * len(found)
                numbers += range(len(found))
                for column, values in zip(columns, zip(*found, strict=True), strict=True):
                    column.extend(values)
                if len(at) >= HELD_CHUNKS or i == b.num_rows - 1:
                    arrays = [pa.array(c, kind) for c, (_, kind, _) in zip(columns, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(many, pa.int32()), pa.array(numbers, pa.int32()), *arrays], names)
                    at, many, numbers, columns = [], [], [], [[] for _ in fields]

    kinds = [df.schema[key].dataType.simpleString(), "int", "int", *(t for _, _, t in fields)]
    return df.select(key, "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))


def cut_rows(df: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """As chunked, by the chunker of this library."""
    return _by_row(df, key, lambda text: [(c,) for c in cut(text, window)], [("chunk", pa.string(), "string")])


def term_rows(df: DataFrame, key: str, analyzer: Analyzer = "rule", window: int = WINDOW, chunker: Chunker = with_chunks) -> DataFrame:
    """(key, chunks, chunk_no, terms, tfs) of df(key, text): a row a chunk, its terms and how often it has each."""
    named = df.select(key, F.coalesce("text", F.lit("")).alias("text"))
    if not callable(analyzer):
        count = Counted(analyzer)
        fields = [("terms", pa.list_(pa.string()), "array<string>"), ("tfs", pa.list_(pa.int32()), "array<int>")]
        if chunker is with_chunks:
            return _by_row(named, key, lambda text: [(list(f), list(f.values())) for f in map(count, cut(text, window))], fields)
        each = chunked(named, key, chunker, window)
        whole = each.select(F.struct(key, "chunks", "chunk_no").alias("row"), F.col("chunk").alias("text"))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [count(t) for t in b.column("text").to_pylist()]
                lists = [pa.array([list(f) for f in found], fields[0][1]), pa.array([list(f.values()) for f in found], fields[1][1])]
                yield pa.RecordBatch.from_arrays([b.column("row"), *lists], ["row", "terms", "tfs"])

        return whole.mapInArrow(counted, f"row {whole.schema['row'].dataType.simpleString()}, terms array<string>, tfs array<int>").select("row.*", "terms", "tfs")
    each = chunked(named, key, chunker, window)
    found = terms(each, "chunk", [key, "chunk_no", "chunks"], analyzer).groupBy(key, "chunk_no", "chunks", "term").agg(F.count("*").cast("int").alias("tf"))
    found = found.unionByName(each.select(key, "chunk_no", "chunks", F.lit("").alias("term"), F.lit(0).alias("tf")))
    lists = found.groupBy(key, "chunk_no", "chunks").agg(F.expr("filter(sort_array(collect_list(struct(term, tf))), x -> x.term <> '')").alias("v"))
    return lists.select(key, "chunks", "chunk_no", F.col("v.term").alias("terms"), F.col("v.tf").alias("tfs"))


def index_text(df: DataFrame, key: str, text: str, vocabulary: int | None = None, analyzer: Analyzer = "rule", window: int = WINDOW, chunker: Chunker = with_chunks) -> TextIndex:
    """chunker: from (rows, text column, columns to keep, window) to those columns and `chunks`, an array."""
    named = spread_to_keep(df.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")))
    return of_rows(term_rows(named, "doc_id", analyzer, window, chunker), "doc_id", vocabulary, analyzer)


def of_rows(rows: DataFrame, key: str, vocabulary: int | None = None, analyzer: Analyzer = "rule") -> TextIndex:
    """The index of term_rows."""
    named = rows.select(F.col(key).cast("string").alias("doc_id"), "chunk_no", chunk_name(key, "chunks").alias("chunk_id"))
    return TextIndex(named, flat(rows).select("term", "chunk_id", "tf"), vocabulary, analyzer, rows)


def flat(rows: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_id, term, tf) of term_rows, or of the asked terms alone."""
    key, v = rows.columns[0], F.arrays_zip("terms", "tfs")
    if asked is not None:
        rows, v = having(rows, asked), F.filter(v, lambda p: p["terms"].isin(asked))
    each = rows.select(F.col(key).cast("string").alias("doc_id"), chunk_name(key, "chunks").alias("chunk_id"), F.explode(v).alias("p"))
    return each.select("doc_id", "chunk_id", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))


def having(rows: DataFrame, asked: list[str]) -> DataFrame:
    """The term_rows that have one of the terms."""
    return rows.filter(F.arrays_overlap("terms", F.array(*map(F.lit, asked)))) if asked else rows.limit(0)


def held(index: TextIndex) -> TextIndex:
    """The index with what it follows from held, as a query reads it several times; the cache drops what it has no room for."""
    if index.rows is None:
        return TextIndex(index.chunks.persist(), index.postings.persist(), index.vocabulary, index.analyzer)
    return of_rows(index.rows.persist(), index.rows.columns[0], index.vocabulary, index.analyzer)


def frozen(index: TextIndex) -> TextIndex:
    """The index with its present vocabulary alone: later additions never add terms."""
    return TextIndex(index.chunks, index.visible(), None, index.analyzer)


def query_terms(index: TextIndex, query: str) -> dict[str, int]:
    """The query's terms and how often it has them: a few rows, on the driver."""
    if not callable(index.analyzer):
        return Counted(index.analyzer)(query)
    spark = index.chunks.sparkSession
    rows = terms(spark.sql("SELECT :q AS q", args={"q": query}), "q", [], index.analyzer).collect()
    return reduce(lambda d, r: d | {r["term"]: d.get(r["term"], 0) + 1}, rows, {})


def _scored(index: TextIndex, query: str, norms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score) of match_chunks, with doc_id where the index has rows and no norms are given."""
    asked = query_terms(index, query)
    hits = index.visible(index.postings.filter(F.col("term").isin(list(asked))) if index.rows is None else flat(index.rows, list(asked)))
    known = {r["term"]: r["idf"] for r in index.idf(hits).collect()}
    length = math.sqrt(sum((asked[t] * w) ** 2 for t, w in known.items()))
    if not length:
        return hits.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*[F.lit(x) for t, w in known.items() for x in (t, w * asked[t] * w)])[F.col("term")]
    score = (F.col("dot") / (F.col("norm") * F.lit(length))).alias("score")
    if index.rows is not None and norms is None:
        dot = F.when(F.col("term").isin(list(known)), F.col("tf") * weight)
        held = lengths(flat(having(index.rows, list(known))), index.idf().persist(), ["doc_id", "chunk_id"], dot=dot)
        return held.filter("norm > 0 and dot is not null").select("doc_id", "chunk_id", score)
    dots = hits.groupBy("chunk_id").agg(F.sum(F.col("tf") * weight).alias("dot"))
    norms = index.norms(dots.select("chunk_id")) if norms is None else norms
    return dots.join(norms, "chunk_id").filter("norm > 0").select("chunk_id", score)


def match_chunks(index: TextIndex, query: str, norms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score): cosine of the query's and each chunk's weighted terms."""
    return _scored(index, query, norms).select("chunk_id", "score")


def match(index: TextIndex, query: str, k: int | None = None, norms: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(doc_id, score, best_chunk): each document once, by its best chunk; the k best.

    Ties go to the smaller chunk id.  digits: scores are rounded before they rank.
    """
    scored = _scored(index, query, norms)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    if "doc_id" not in scored.columns:
        scored = scored.join(index.chunks.select("doc_id", "chunk_id"), "chunk_id")
    found = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("best"))
    out = found.select("doc_id", (-F.col("best.s")).alias("score"), F.col("best.chunk_id").alias("best_chunk")).orderBy(F.desc("score"), "best_chunk")
    return out if k is None else out.limit(k)


def match_batch(index: TextIndex, queries: DataFrame, key: str, text: str, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score, best_chunk): as match, for each of queries(key, text), in one job.

    Each chunk is dealt with its length, by document, and meets the terms of queries, which
    are broadcast unless they are many; so dot products are added up and the best of each
    task found where the chunk lies.  Queries without known terms have no rows; null
    texts have no terms.
    """
    asked = queries.select(F.col(key).alias("query_id"), F.coalesce(text, F.lit("")).alias("text"))
    if callable(index.analyzer):
        asked = terms(asked, "text", ["query_id"], index.analyzer).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    else:
        count = Counted(index.analyzer)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i, t, n) for i, q in enumerate(b.column("text").to_pylist()) for t, n in count(q).items()]
                at, words, times = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(times, pa.int64())], ["query_id", "term", "qtf"])

        asked = asked.mapInArrow(counted, f"query_id {asked.schema['query_id'].dataType.simpleString()}, term string, qtf long")
    weights = index.idf().persist()
    weighed = asked.join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf") * F.col("idf")).alias("w"), (F.col("qtf") * F.col("idf")).alias("q")).persist()
    asks, whole = F.broadcast(weighed) if weighed.count() <= BROADCAST_TERMS else weighed, weighed.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    if index.rows is None:
        of, held = ["chunk_id"], index.postings
        chunks = held.groupBy("chunk_id").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs")).join(index.chunks.select("doc_id", "chunk_id"), "chunk_id")
    else:
        key = index.rows.columns[0]
        chunks = index.rows.select(F.col(key).cast("string").alias("doc_id"), chunk_name(key, "chunks").alias("chunk_id"), "terms", "tfs")
        of, held = ["doc_id", "chunk_id"], flat(index.rows)
    norms = lengths(held, weights, of)
    norms = norms if index.rows is not None else norms.join(index.chunks.select("doc_id", "chunk_id"), "chunk_id")
    # A join by document and chunk would deal by both, and each document's chunks anew.
    same = Window.partitionBy("doc_id").orderBy("chunk_id").rangeBetween(Window.currentRow, Window.currentRow)
    dealt = chunks.unionByName(norms.filter("norm > 0").select("doc_id", "chunk_id", "norm"), allowMissingColumns=True).withColumn("norm", F.max("norm").over(same))
    each = dealt.filter("terms is not null and norm > 0").select("doc_id", "chunk_id", "norm", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    met = each.select("doc_id", "chunk_id", "norm", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).join(asks, "term")
    dots = met.groupBy("doc_id", "chunk_id", "query_id").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"), F.first("norm").alias("norm"))
    score = F.col("dot") / (F.col("norm") * F.col("length"))
    scored = dots.join(F.broadcast(whole), "query_id").select("query_id", "doc_id", "chunk_id", (score if digits is None else F.round(score, digits)).alias("score"))
    found = scored.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("best"))
    order = Window.partitionBy("query_id").orderBy("best")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", (-F.col("best.s")).alias("score"), F.col("best.chunk_id").alias("best_chunk"))


def postings_for(index: TextIndex, text: str) -> DataFrame:
    """The postings of the first term of a text."""
    first = next(iter(query_terms(index, text)), None)
    return index.visible().filter(F.col("term") == F.lit(first)).select("chunk_id", "tf")
