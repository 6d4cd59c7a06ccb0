"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import spread, stem_sql, stop_sql, terms
from .functions.vectors import dot, norm
from .operators import evaluate, fusion, impact, ivf, kmeans, lookup, proximity, spatial, text, vector
from .operators.lookup import Range

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
QUERY_TEXT, TOP = "the thand of tion ing", 10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Look-up
ORDER = "o_orderkey", "o_totalprice"


def _order_query(name: str, bounds: Range, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lookup.ranged(table(spark, d, "orders").select(*ORDER), "o_orderkey", bounds)

    query(name, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {where}")(run)


_order_query("range_between", Range(100, 200), "o_orderkey BETWEEN 100 AND 200")
_order_query("range_lt", Range(None, 100, True, False), "o_orderkey < 100")
_order_query("range_le", Range(None, 100), "o_orderkey <= 100")
_order_query("range_gt", Range(1000, None, False), "o_orderkey > 1000")
_order_query("range_ge", Range(1000), "o_orderkey >= 1000")
_order_query("range_open_bounds", Range(100, 200, False, False), "o_orderkey > 100 AND o_orderkey < 200")


@query("eq_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def eq_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.equal(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 42)


@query("eq_string", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def eq_string(spark: SparkSession, d: str) -> DataFrame:
    return lookup.equal(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING")


@query("range_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 50 AND 500 ORDER BY o_orderkey LIMIT 10")
def range_limit(spark: SparkSession, d: str) -> DataFrame:
    return lookup.ranged(table(spark, d, "orders").select(*ORDER), "o_orderkey", Range(50, 500), limit=10)


@query("full_scan", "SELECT * FROM region")
def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").orderBy("r_regionkey")


@query("project", "SELECT s_suppkey, s_name FROM supplier")
def project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_name")


def _engine(spark: SparkSession, sql: list[str], load: tuple[str, DataFrame] | None = None):
    from .engine import Engine
    from .sources.scratch import scratch

    engine = Engine(spark, scratch(spark))
    engine.sql(sql[0])
    if load:
        engine.load(*load)
    for s in sql[1:]:
        out = engine.sql(s)
    return out.df


NATION = "CREATE TABLE nation (n_nationkey INT, n_name TEXT, n_regionkey INT)"


@query("insert_select", "SELECT n_nationkey, n_name FROM (SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (100, 'ATLANTIS'), (101, 'LEMURIA')) WHERE n_nationkey >= 20")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    insert = 'INSERT INTO nation VALUES (100, "ATLANTIS", 1), (101, "LEMURIA", 2)'
    out = _engine(spark, [NATION, insert, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 20"], ("nation", table(spark, d, "nation")))
    return out.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("delete_eq", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 7")
def delete_eq(spark: SparkSession, d: str) -> DataFrame:
    out = _engine(spark, [NATION, "CREATE INDEX ON nation (n_nationkey) USING bplus", "DELETE FROM nation WHERE n_nationkey = 7", "SELECT n_nationkey, n_name FROM nation"], ("nation", table(spark, d, "nation")))
    return out.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("delete_range", "SELECT n_nationkey, n_name FROM nation WHERE NOT n_nationkey BETWEEN 3 AND 9")
def delete_range(spark: SparkSession, d: str) -> DataFrame:
    out = _engine(spark, [NATION, "DELETE FROM nation WHERE n_nationkey BETWEEN 3 AND 9", "SELECT n_nationkey, n_name FROM nation"], ("nation", table(spark, d, "nation")))
    return out.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


# Points
def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


PART = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part"


@query("spatial_within", f"SELECT * FROM ({PART}) WHERE x BETWEEN 10 AND 20 AND y BETWEEN 950 AND 1200")
def spatial_within(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within(_points(spark, d), ("x", "y"), (10, 950), (20, 1200))


@query("spatial_point_eq", f"SELECT p.* FROM ({PART}) p JOIN (SELECT CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part WHERE p_partkey = 7) q ON x = a AND y = b")
def spatial_point_eq(spark: SparkSession, d: str) -> DataFrame:
    df = _points(spark, d)
    p = df.filter("p_partkey = 7").first()
    return spatial.at_point(df, ("x", "y"), (p["x"], p["y"]))


@query("spatial_knn", f"SELECT p_partkey, x, y, round(sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)), 6) AS distance FROM ({PART}) ORDER BY sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)), p_partkey LIMIT 10")
def spatial_knn(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_points(_points(spark, d), ("x", "y"), (25, 1000), TOP, ("p_partkey",)).withColumn("distance", F.round("distance", 6))


PLACES = ["CREATE TABLE places (p_partkey INT, at VECTOR)", "CREATE INDEX ON places (at) USING rtree"]


def _places(spark: SparkSession, d: str, *sql: str) -> DataFrame:
    """Points of all parts in a spatial layout of the engine."""
    rows = _points(spark, d).select("p_partkey", F.array("x", "y").alias("at"))
    return _engine(spark, [PLACES[0], PLACES[1], *sql], ("places", rows))


@query("spatial_cells_within", f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, x, y FROM ({PART}) WHERE x BETWEEN 10 AND 20 AND y BETWEEN 950 AND 1200")
def spatial_cells_within(spark: SparkSession, d: str) -> DataFrame:
    """The box, from the cells that it meets."""
    return _places(spark, d, "SELECT p_partkey, at FROM places WHERE WITHIN(at, [10, 950], [20, 1200])").select("p_partkey", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))


@query("spatial_cells_knn", f"SELECT round(sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)), 6) AS distance FROM ({PART}) WHERE p_partkey % 3 <> 0 OR x < 20 OR x > 30 ORDER BY sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)) LIMIT {TOP}")
def spatial_cells_knn(spark: SparkSession, d: str) -> DataFrame:
    """The nearest points, from the cells near enough, after some of the nearest were deleted."""
    rows = _points(spark, d).select("p_partkey", F.array("x", "y").alias("at"), F.when((F.col("p_partkey") % 3 == 0) & F.col("x").between(20, 30), 1).otherwise(0).alias("gone"))
    out = _engine(spark, ["CREATE TABLE places (p_partkey INT, at VECTOR, gone INT)", PLACES[1], "DELETE FROM places WHERE gone = 1", f"SELECT p_partkey FROM places WHERE KNN(at, [25, 1000], {TOP})"], ("places", rows))
    return out.select(F.round("distance", 6).alias("distance"))


@query("hash_eq", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice FROM orders WHERE o_custkey = 42")
def hash_eq(spark: SparkSession, d: str) -> DataFrame:
    """Equality on a key with many rows, by the bucket of a hashed layout."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _engine(spark, ["CREATE TABLE o (o_orderkey INT, o_custkey INT, o_totalprice FLOAT)", "CREATE INDEX ON o (o_custkey) USING hash", "SELECT o_orderkey, o_custkey, o_totalprice FROM o WHERE o_custkey = 42"], ("o", rows))


# Text
CHUNKS = r"""
p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
w AS (SELECT *, string_split_regex(ps[1], '\s+') AS ws FROM p),
cs AS (SELECT doc_id, CASE WHEN len(ps) = 0 THEN [text] WHEN len(ps) > 1 THEN ps WHEN len(ws) <= 100 THEN ps
  ELSE list_transform(range(0, (len(ws) - 1) // 100 + 1), lambda i: array_to_string(ws[i * 100 + 1 : i * 100 + 100], ' ')) END AS c FROM w),
chunks AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_no, unnest(c) AS chunk, len(c) AS n FROM cs),
named AS (SELECT doc_id, chunk_no, CASE WHEN n = 1 THEN doc_id ELSE doc_id || '#' || chunk_no END AS chunk_id, chunk FROM chunks)"""
POSTINGS = f"""{CHUNKS},
raw AS (SELECT chunk_id, unnest(regexp_extract_all(lower(chunk), '[a-z0-9]+')) AS t FROM named),
stems AS (SELECT chunk_id, {stem_sql("t")} AS term FROM raw WHERE length(t) >= 2 AND NOT {stop_sql("t")}),
postings AS (SELECT term, chunk_id, count(*) AS tf FROM stems WHERE term <> '' AND NOT {stop_sql("term")} GROUP BY ALL)"""
VOCABULARY = 500
CAPPED = "top AS (SELECT term FROM (SELECT term, sum(tf) AS cf FROM postings GROUP BY term) ORDER BY cf DESC, term LIMIT {n}), seen AS (SELECT * FROM postings WHERE term IN (SELECT term FROM top))"
ALL_SEEN = "seen AS (SELECT * FROM postings)"
WEIGHTS = """
idf AS (SELECT term, count(*) AS df, ln((greatest((SELECT count(*) FROM named), 1) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM seen GROUP BY term),
norms AS (SELECT chunk_id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM seen JOIN idf USING (term) GROUP BY chunk_id)"""
MATCHED = f"""
qraw AS (SELECT unnest(regexp_extract_all(lower('{QUERY_TEXT}'), '[a-z0-9]+')) AS t),
q AS (SELECT {stem_sql("t")} AS term, count(*) AS qtf FROM qraw WHERE length(t) >= 2 AND NOT {stop_sql("t")} GROUP BY ALL),
qw AS (SELECT term, idf, qtf * idf AS w FROM q JOIN idf USING (term)),
scored AS (SELECT chunk_id, round(sum(tf * idf * w) / (any_value(norm) * (SELECT sqrt(sum(w * w)) FROM qw)), 6) AS score FROM seen JOIN qw USING (term) JOIN norms USING (chunk_id) WHERE norm > 0 GROUP BY chunk_id)"""
BEST = "best AS (SELECT doc_id, max(score) AS score, arg_min(chunk_id, (-score, chunk_id)) AS best_chunk FROM scored JOIN named USING (chunk_id) GROUP BY doc_id)"


def _index(spark: SparkSession, d: str, vocabulary: int | None = None, analyzer: str = "rule") -> text.TextIndex:
    return text.held(text.index_text(table(spark, d, "documents"), "doc_id", "text", vocabulary, analyzer))


@query("chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk_id, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS md5 FROM named")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    found = text.chunk_table(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk_no", "chunk_id", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("md5"))


@query("tokens_count", f"WITH {POSTINGS} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY term")
def tokens_count(spark: SparkSession, d: str) -> DataFrame:
    return terms(spread(table(spark, d, "documents")), "text", ["doc_id"]).groupBy("term").agg(F.count("*").alias("n"))


@query("postings", f"WITH {POSTINGS} SELECT term, chunk_id, tf FROM postings")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings


@query("term_df_idf", f"WITH {POSTINGS}, {ALL_SEEN}, {WEIGHTS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_df_idf(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query("doc_norms", f"WITH {POSTINGS}, {ALL_SEEN}, {WEIGHTS} SELECT chunk_id, round(norm, 6) AS norm FROM norms")
def doc_norms(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).norms().select("chunk_id", F.round("norm", 6).alias("norm"))


@query("vocab_topn", f"WITH {POSTINGS} SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term ORDER BY cf DESC, term LIMIT 100")
def vocab_topn(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings.groupBy("term").agg(F.sum("tf").alias("cf")).orderBy(F.desc("cf"), "term").limit(100)


@query("match_chunks", f"WITH {POSTINGS}, {ALL_SEEN}, {WEIGHTS}, {MATCHED} SELECT chunk_id, score FROM scored")
def match_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.match_chunks(_index(spark, d), QUERY_TEXT).withColumn("score", F.round("score", 6))


@query("match_topk", f"WITH {POSTINGS}, {ALL_SEEN}, {WEIGHTS}, {MATCHED}, {BEST} SELECT * FROM best ORDER BY score DESC, best_chunk LIMIT {TOP}")
def match_topk(spark: SparkSession, d: str) -> DataFrame:
    return text.match(_index(spark, d), QUERY_TEXT, TOP, digits=6)


@query("match_vocab", f"WITH {POSTINGS}, {CAPPED.format(n=VOCABULARY)}, {WEIGHTS}, {MATCHED}, {BEST} SELECT * FROM best ORDER BY score DESC, best_chunk LIMIT {TOP}")
def match_vocab(spark: SparkSession, d: str) -> DataFrame:
    return text.match(_index(spark, d, VOCABULARY), QUERY_TEXT, TOP, digits=6)


def _saver(spark: SparkSession):
    from .sources.scratch import scratch

    folder = scratch(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return written


def _top(spark: SparkSession, index: impact.ImpactIndex) -> DataFrame:
    from .functions.text import Counted

    found = index.top(Counted("rule")(QUERY_TEXT), TOP, digits=6)
    return spark.createDataFrame([(str(i), s, c) for i, s, c in found], "doc_id string, score double, best_chunk string")


@query("match_early", f"WITH {POSTINGS}, {ALL_SEEN}, {WEIGHTS}, {MATCHED}, {BEST} SELECT * FROM best ORDER BY score DESC, best_chunk LIMIT {TOP}")
def match_early(spark: SparkSession, d: str) -> DataFrame:
    """As match_topk, from the best postings alone."""
    return _top(spark, impact.index([table(spark, d, "documents")], "doc_id", "text", _saver(spark)))


LEFT = CHUNKS.replace("FROM documents", "FROM documents WHERE coalesce(lang, '') <> 'fr'")


@query("match_parts", f"WITH {POSTINGS.replace(CHUNKS, LEFT)}, {ALL_SEEN}, {WEIGHTS}, {MATCHED}, {BEST} SELECT * FROM best ORDER BY score DESC, best_chunk LIMIT {TOP}")
def match_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same over an index of three parts, of which a language was deleted: counts are merged, no part is built anew."""
    docs = table(spark, d, "documents")
    parts = [docs.filter(F.col("doc_id") % 7 < 4), docs.filter(F.col("doc_id") % 7 == 4), docs.filter(F.col("doc_id") % 7 > 4)]
    return _top(spark, impact.index(parts, "doc_id", "text", _saver(spark), docs.filter("lang = 'fr'")))


@query("match_batch", f"""WITH {POSTINGS}, {ALL_SEEN}, {WEIGHTS},
qraw AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
q AS (SELECT query_id, {stem_sql("t")} AS term, count(*) AS qtf FROM qraw WHERE length(t) >= 2 AND NOT {stop_sql("t")} GROUP BY ALL),
qw AS (SELECT query_id, term, idf, qtf * idf AS w FROM q JOIN idf USING (term)),
ql AS (SELECT query_id, sqrt(sum(w * w)) AS length FROM qw GROUP BY ALL),
dots AS (SELECT query_id, chunk_id, sum(tf * idf * w) AS dot FROM seen JOIN qw USING (term) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(dot / (norm * length), 6) AS score FROM dots JOIN norms USING (chunk_id) JOIN ql USING (query_id) WHERE norm > 0),
best AS (SELECT query_id, doc_id, max(score) AS score, arg_min(chunk_id, (-score, chunk_id)) AS best_chunk FROM scored JOIN named USING (chunk_id) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_chunk) AS INTEGER) AS rank, doc_id, score, best_chunk FROM best QUALIFY rank <= {TOP}""")
def match_batch(spark: SparkSession, d: str) -> DataFrame:
    return text.match_batch(_index(spark, d), table(spark, d, "benchmark"), "item_id", "text", TOP, digits=6)


#: Words that many documents have all of.
ALL_OF = "tion ing"
COVERS = f"""
place AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), 1) - 1 AS pos FROM documents),
stem AS (SELECT doc_id, pos, {stem_sql("t")} AS term FROM place WHERE length(t) >= 2 AND NOT {stop_sql("t")}),
ev AS (SELECT *, max(CASE WHEN term = 'tion' THEN pos END) OVER w AS a, max(CASE WHEN term = 'ing' THEN pos END) OVER w AS b FROM stem WHERE term IN ('tion', 'ing') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cover AS (SELECT doc_id, least(a, b) AS lo, min(pos) AS hi FROM ev WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
near AS (SELECT doc_id, round(sum(2.0::DOUBLE / (hi - lo + 1)), 6) AS score FROM cover GROUP BY doc_id)"""


@query("match_all", f"WITH {COVERS} SELECT doc_id, score FROM near")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    """All documents that have every word, by cover density."""
    return proximity.match_all(proximity.positions(table(spark, d, "documents"), "doc_id", "text"), ALL_OF, digits=6)


@query("overlap_with_match", f"""WITH {POSTINGS}, {ALL_SEEN}, {WEIGHTS}, {MATCHED.replace(QUERY_TEXT, ALL_OF)}, {BEST}, {COVERS},
x AS (SELECT list(doc_id) AS f FROM (SELECT doc_id FROM near ORDER BY score DESC, doc_id LIMIT {TOP})),
y AS (SELECT list(doc_id) AS t FROM (SELECT doc_id FROM best ORDER BY score DESC, best_chunk LIMIT {TOP}))
SELECT round(len(list_intersect(f, t)) / len(list_distinct(list_concat(f, t))), 3) AS overlap FROM x, y""")
def overlap_with_match(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten best documents both kinds of full-text search have."""
    found = proximity.match_all(proximity.positions(table(spark, d, "documents"), "doc_id", "text"), ALL_OF, TOP, digits=6)
    both = [x.select(F.lit(0).alias("query_id"), F.col("doc_id").alias("key")) for x in (found, text.match(_index(spark, d), ALL_OF, TOP, digits=6))]
    return evaluate.jaccard(*both)


@query("match_porter2")
def match_porter2(spark: SparkSession, d: str) -> DataFrame:
    return text.match(_index(spark, d, analyzer="porter2"), QUERY_TEXT, TOP, digits=6)


# Vectors
ASKED = 3
#: Batch searches ask with every row whose id is divisible by this, against all rows.
EVERY = 100
COSINE = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
BATCH = f"(SELECT q.vec_id AS query_id, e.vec_id AS key, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0)"


def _asked(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").filter(F.col("vec_id") == ASKED).first()["embedding"]


def _batch(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.cosine_batch(e.filter(where), "vec_id", "embedding", e.filter(F.col("vec_id") % EVERY == 0), TOP, digits=6)


@query("knn_cosine", f"SELECT e.vec_id AS key, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY {COSINE} DESC, e.vec_id LIMIT {TOP}")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.cosine_top(e, "vec_id", "embedding", _asked(spark, d), TOP, digits=6)


@query("knn_batch", f"SELECT query_id, key, score, CAST(rank AS INTEGER) AS rank FROM {BATCH} WHERE rank <= {TOP}")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d)


SPARSE = 0.25


@query("knn_pruned", f"""
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x >= {SPARSE} THEN x ELSE 0.0 END) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM v), d AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM v),
rare AS (SELECT p.dim, any_value(q.x) AS w FROM d p JOIN (SELECT dim, x FROM d WHERE vec_id = 3 AND x > 0) q ON p.dim = q.dim WHERE p.x > 0 GROUP BY p.dim HAVING count(*) BETWEEN 1 AND greatest(1, CAST(floor(0.05 * (SELECT n FROM n)) AS INT))),
o AS (SELECT vec_id, sum(x * w) AS overlap FROM d JOIN rare USING (dim) WHERE x > 0 GROUP BY vec_id),
lim AS (SELECT greatest(40, CAST(floor(0.01 * n) AS INT)) AS m, n FROM n),
c AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY overlap DESC, vec_id) AS r FROM o) WHERE r <= (SELECT m FROM lim)),
use AS (SELECT (SELECT count(*) FROM rare) > 0 AND (SELECT m < 0.3 * n FROM lim) AND (SELECT count(*) FROM o) >= (SELECT m FROM lim) AS ok)
SELECT a.vec_id AS key, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a, (SELECT v FROM v WHERE vec_id = 3) b
WHERE list_sum(a.v) > 0 AND (NOT (SELECT ok FROM use) OR a.vec_id IN (SELECT vec_id FROM c)) ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, a.vec_id LIMIT {TOP}""")
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    sparse = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x >= SPARSE, x).otherwise(0.0)).alias("v"))
    asked = sparse.filter("vec_id = 3").first()["v"]
    return vector.cosine_pruned(sparse, "vec_id", "v", asked, TOP, digits=6)


#: Lists that queries by inverted files read, of all.
LISTS, PROBES = 32, 20


def _ivf(spark: SparkSession, d: str, probes: int | None) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = ivf.fit(e, "vec_id", "embedding", LISTS)
    laid = _saver(spark)(ivf.assigned(e, "embedding", centres), "lists")
    return ivf.batch(laid, "vec_id", "embedding", e.filter(F.col("vec_id") % EVERY == 0), TOP, centres, probes, digits=6)


@query("knn_ivf", f"SELECT query_id, key, score, CAST(rank AS INTEGER) AS rank FROM {BATCH} WHERE rank <= {TOP}")
def knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    """Inverted-file search that reads all of its lists: exact."""
    return _ivf(spark, d, LISTS)


@query("ivf_recall", f"SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % {EVERY} = 0")
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether five eighths of the lists have nine of the ten nearest, held against all vectors."""
    found, true = _ivf(spark, d, PROBES).select("query_id", "key"), _batch(spark, d).select("query_id", "key")
    queries = true.agg(F.countDistinct("query_id").alias("queries"))
    return evaluate.recall(found, true).crossJoin(queries).select("queries", (F.col("recall") >= 0.9).alias("enough"))


# Fusion and evaluation: documents and embeddings meet at doc_id = vec_id
DEEP = 3 * TOP
TWO = f"""{POSTINGS}, {ALL_SEEN}, {WEIGHTS}, {MATCHED}, {BEST},
texts AS (SELECT doc_id AS key, score FROM best ORDER BY score DESC, key LIMIT {DEEP}),
seen_v AS (SELECT CAST(e.vec_id AS VARCHAR) AS key, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY 2 DESC, 1 LIMIT {DEEP})"""
RANKED = "SELECT key, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, key)) AS part FROM {}"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = text.match(_index(spark, d), QUERY_TEXT, digits=6).select(F.col("doc_id").alias("key"), "score")
    e = table(spark, d, "embeddings")
    asked = F.array(*[F.lit(float(x)) for x in _asked(spark, d)])
    cosine = F.round(dot(F.col("embedding"), asked) / (norm(F.col("embedding")) * norm(asked)), 6)
    seen = e.select(F.col("vec_id").cast("string").alias("key"), cosine.alias("score"))
    # Short lists, each read more than once.
    return tuple(x.orderBy(F.desc("score"), "key").limit(DEEP).persist() for x in (seen, found))


@query("rrf_fuse", f"WITH {TWO} SELECT key, round(sum(part), 9) AS score FROM ({RANKED.format('seen_v')} UNION ALL {RANKED.format('texts')}) GROUP BY key ORDER BY sum(part) DESC, key LIMIT {TOP}")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank(list(_sides(spark, d)), TOP).withColumn("score", F.round("score", 9))


@query("weighted_fuse", f"WITH {TWO}, s1 AS (SELECT key, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END * 0.6 AS part FROM seen_v), s2 AS (SELECT key, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END * 0.4 AS part FROM texts) SELECT key, round(sum(part), 6) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY key")
def weighted_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted_sum(*_sides(spark, d), 0.6).withColumn("score", F.round("score", 6))


@query("hybrid", f"WITH {TWO}, f AS (SELECT key, sum(part) AS s FROM ({RANKED.format('seen_v')} UNION ALL {RANKED.format('texts')}) GROUP BY key ORDER BY s DESC, key LIMIT {TOP}) SELECT f.key, d.lang, round(s, 9) AS fused_score, v.score AS visual_score, t.score AS text_score FROM f LEFT JOIN seen_v v USING (key) LEFT JOIN texts t USING (key) LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = f.key")
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    seen, found = _sides(spark, d)
    fused = fusion.reciprocal_rank([seen, found], TOP).select("key", F.round("score", 9).alias("fused_score"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang")
    scores = fused.join(seen.withColumnRenamed("score", "visual_score"), "key", "left").join(found.withColumnRenamed("score", "text_score"), "key", "left")
    return docs.join(F.broadcast(scores), "key", "right").select("key", "lang", "fused_score", "visual_score", "text_score")


HALF = "(SELECT q.vec_id AS query_id, e.vec_id AS key, row_number() OVER (PARTITION BY q.vec_id ORDER BY " + COSINE + f" DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0 AND e.label < 5)"


def _found_true(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(_batch(spark, d, where).select("query_id", "key") for where in ("label < 5", "true"))


SETS = f"t AS (SELECT query_id, list(key) AS t FROM {BATCH} WHERE rank <= {TOP} GROUP BY query_id), f AS (SELECT query_id, list(key) AS f FROM {HALF} WHERE rank <= {TOP} GROUP BY query_id)"


@query("recall_at_k", f"WITH {SETS} SELECT round(avg(len(list_intersect(f, t)) / greatest(len(t), 1)), 3) AS recall FROM t JOIN f USING (query_id)")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall(*_found_true(spark, d))


@query("jaccard_overlap", f"WITH {SETS} SELECT round(avg(len(list_intersect(f, t)) / len(list_distinct(list_concat(f, t)))), 3) AS overlap FROM t JOIN f USING (query_id)")
def jaccard_overlap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.jaccard(*_found_true(spark, d))


# Codebook: embeddings as descriptors of fifty media, mean vectors by label as words
WORDS = "d AS (SELECT vec_id, vec_id % 50 AS key, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, label FROM embeddings), c AS (SELECT label AS word, i, avg(x) AS m FROM d GROUP BY ALL), n AS (SELECT vec_id, key, word, sum((x - m) * (x - m)) AS dist FROM d JOIN c USING (i) GROUP BY ALL), near AS (SELECT vec_id, key, word FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), word) = 1)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The nearest word of each embedding, in one pass: centres are few."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("key"), "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy("label").collect()  # a row a label
    named = F.array(*[F.lit(r["label"]) for r in rows])
    near = kmeans.assigned(e, "embedding", np.array([[x["m"] for x in r["c"]] for r in rows]), "at", digits=9)
    return near.select("vec_id", "key", named[F.col("at")].alias("word"))


def _counted(words: DataFrame) -> DataFrame:
    """(key, word, n, keys, df): words of each medium, all media, and media that have the word: by windows over small counts."""
    counts = words.groupBy("key", "word").agg(F.count("*").alias("n"))
    media = counts.agg(F.countDistinct("key").alias("keys"))
    return counts.withColumn("df", F.count("*").over(Window.partitionBy("word"))).crossJoin(F.broadcast(media))


@query("codebook_idf", f"WITH {WORDS} SELECT word, round(ln((SELECT count(DISTINCT key) + 1.0 FROM near) / (count(DISTINCT key) + 1.0)), 6) AS idf FROM near GROUP BY word")
def codebook_idf(spark: SparkSession, d: str) -> DataFrame:
    return _counted(_words(spark, d)).groupBy("word").agg(F.round(F.log((F.first("keys") + 1.0) / (F.first("df") + 1.0)), 6).alias("idf"))


@query("quantize_histogram", f"WITH {WORDS}, idf AS (SELECT word, ln((SELECT count(DISTINCT key) + 1.0 FROM near) / (count(DISTINCT key) + 1.0)) AS idf FROM near GROUP BY word), h AS (SELECT key, word, count(*) / sum(count(*)) OVER (PARTITION BY key) * any_value(idf) AS w FROM near JOIN idf USING (word) GROUP BY key, word) SELECT key, word, round(CASE WHEN s > 0 THEN w / sqrt(s) ELSE w END, 6) AS w FROM (SELECT *, sum(w * w) OVER (PARTITION BY key) AS s FROM h)")
def quantize_histogram(spark: SparkSession, d: str) -> DataFrame:
    of = Window.partitionBy("key")
    h = _counted(_words(spark, d)).withColumn("w", F.col("n") / F.sum("n").over(of) * F.log((F.col("keys") + 1.0) / (F.col("df") + 1.0)))
    h = h.withColumn("s", F.sum(F.col("w") * F.col("w")).over(of))
    return h.select("key", "word", F.round(F.when(F.col("s") > 0, F.col("w") / F.sqrt("s")).otherwise(F.col("w")), 6).alias("w"))


# Loading
@query("ingest_join", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def ingest_join(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, d, "documents").join(labels, "doc_id").select("doc_id", "lang", "quality")


@query("ingest_left_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def ingest_left_default(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("ingest_semi", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def ingest_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("clean_text", r"""SELECT page_id, md5(trim(regexp_replace(translate(html, '\"', ' '''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS md5 FROM pages""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    from .functions.text import flattened

    return table(spark, d, "pages").select("page_id", F.md5(flattened(F.col("html")).cast("binary")).alias("md5"))


@query("literal_parse", """SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k FROM events""")
def literal_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", '"k": ([0-9]+)', 1).alias("k"))


@query("pad_ids", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded FROM customer")
def pad_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"))


@query("kmeans_fit")
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    from .sources.media import Codebook

    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("key"), F.col("embedding").alias("descriptor"))
    return Codebook(8).fit(rows).histograms(rows)


@query("explain_lines")
def explain_lines(spark: SparkSession, d: str) -> DataFrame:
    from .engine import Engine
    from .sources.scratch import scratch

    engine = Engine(spark, scratch(spark))
    engine.sql(NATION)
    engine.sql("CREATE INDEX ON nation (n_nationkey) USING bplus")
    engine.load("nation", table(spark, d, "nation"))
    lines = engine.sql("SELECT n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 9 LIMIT 5").explain()
    return spark.createDataFrame(lines, "depth int, line string")
