"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from fathom.functions.text import Counted, cut
from fathom.queries import ORACLES, QUERIES, QUERY_TEXT, TOP
from fathom.sources.media import Codebook

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(df[columns].astype(str).itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_the_rest_is_tested_here():
    assert set(QUERIES) - set(ORACLES) == {"match_porter2", "kmeans_fit", "explain_lines"}


def test_porter2_against_loops(spark):
    count, chunks = Counted("porter2"), {}
    for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        parts = cut(r["text"] or "")
        for i, c in enumerate(parts):
            chunks[str(r["doc_id"]) if len(parts) == 1 else f"{r['doc_id']}#{i}"] = str(r["doc_id"]), count(c)
    df = Counter(t for _, tf in chunks.values() for t in tf)
    idf = {t: math.log((len(chunks) + 1) / (n + 1)) + 1 for t, n in df.items()}
    asked = {t: n * idf[t] for t, n in count(QUERY_TEXT).items() if t in idf}
    length, best = math.sqrt(sum(w * w for w in asked.values())), {}
    for chunk, (doc, tf) in chunks.items():
        if dot := sum(n * idf[t] * asked[t] for t, n in tf.items() if t in asked):
            score = round(dot / math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items())) / length, 6)
            best[doc] = min(best.get(doc, (0.0, "~")), (-score, chunk))
    want = sorted((s, c, doc) for doc, (s, c) in best.items())[:TOP]
    got = QUERIES["match_porter2"](spark, DATA).collect()
    assert [(-r["score"], r["best_chunk"], r["doc_id"]) for r in got] == want


def test_codebook_histograms_are_consistent(spark):
    """Each medium's vector follows from the words of its descriptors, which centres give; equal runs give equal rows."""
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("vec_id % 50 AS key", "embedding AS descriptor")
    book = Codebook(8).fit(df)
    by_key = {}
    for r in rows:
        by_key.setdefault(r["vec_id"] % 50, []).append(r["embedding"])
    got = {r["key"]: r["vec"] for r in QUERIES["kmeans_fit"](spark, DATA).collect()}
    assert len(book.centers) == 8 and got.keys() == by_key.keys()
    assert all(np.allclose(got[k], book.quantize(np.array(v)), atol=1e-6) for k, v in by_key.items())


def test_plan_lines(spark):
    rows = [(r["depth"], re.sub(r"time=[0-9.]+ ms", "time=T", r["line"])) for r in QUERIES["explain_lines"](spark, DATA).collect()]
    assert rows[0][1].startswith("Index Range Scan using bplus on nation  (actual time=T  rows=5  reads=1")
    assert rows[1:] == [(1, "Index Cond: n_nationkey >= 3 AND n_nationkey <= 9"), (1, "Limit: 5"), (1, "Planner: range predicate uses bplus")]


def test_both_sides_of_a_hybrid_search_are_found_once(spark):
    """Ranks, scores and the join read lists that are kept."""
    from fathom.queries import _sides

    assert all(side.is_cached and side.count() == 30 for side in _sides(spark, DATA))
