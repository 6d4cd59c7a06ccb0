"""Parts, marks of deletions, commits of several writers, and how little of a table a query reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.engine import Engine
from fathom.functions import text as words
from fathom.operators import impact, ivf, text, vector
from fathom.sources import layout, storage
from fathom.streaming.append import append_stream


def column(result, name):
    return [row[name] for row in result.rows()]


@pytest.fixture
def stock(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "stock"))
    e.sql("CREATE TABLE bolts (no INT, size FLOAT, note TEXT)")
    e.load("bolts", spark.range(4000).selectExpr("id AS no", "id % 40 AS size", "concat('bolt ', id % 7) AS note"))
    return e


def files(engine, table):
    """Bytes of all files of a table, by folder."""
    fs, path = engine.storage._path(table)
    return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(path)}


def test_deleting_writes_bitmaps_alone(stock):
    e = stock
    e.sql("CREATE INDEX ON bolts (size) USING bplus")
    e.sql("CREATE INDEX ON bolts (note) USING inverted")
    ask = "SELECT no FROM bolts WHERE size BETWEEN 3 AND 4"
    assert len(column(e.sql(ask), "no")) == 200 and len(column(e.sql('SELECT no FROM bolts WHERE MATCH(note, "bolt", 5)'), "no")) == 5
    before = files(e, "bolts")
    assert e.sql("DELETE FROM bolts WHERE size = 3").affected == 100 and e.sql("DELETE FROM bolts WHERE no < 10").affected == 9
    assert e.sql("DELETE FROM bolts WHERE no < 10").affected == 0
    new = {n: size for n, size in files(e, "bolts").items() if n not in before}
    assert sum(size for n, size in new.items()) < 20_000 and all(n.startswith("d") for n in new)
    assert sorted(column(e.sql(ask), "no")) == [i for i in range(10, 4000) if i % 40 == 4]
    assert len(column(e.sql("SELECT no FROM bolts"), "no")) == 4000 - 109
    assert set(before.items()) <= set(files(e, "bolts").items())  # no index was built anew
    assert e.sql("DELETE FROM bolts WHERE size < 20").affected == 2000 - 109
    assert not e.storage.get("bolts").marks and e.storage.get("bolts").rows == 2000  # many were gone: written anew
    assert len(column(e.sql("SELECT no FROM bolts"), "no")) == 2000 and e.storage.vacuum("bolts") > 0
    assert sorted(column(Engine(e.spark, e.storage.folder).sql(ask.replace("3 AND 4", "19 AND 20")), "no")) == list(range(20, 4000, 40))


def test_marks_are_merged(stock, monkeypatch):
    monkeypatch.setattr(storage, "MOST_MARKS", 3)
    for i in range(4):
        stock.sql(f"DELETE FROM bolts WHERE no = {i}")
    assert len(stock.storage.get("bolts").marks) == 2 and stock.storage.get("bolts").dead == 4
    assert len(column(stock.sql("SELECT no FROM bolts"), "no")) == 3996


def test_writers_lose_no_rows(stock, spark, monkeypatch):
    """Another writer commits between this one's reading of the catalog and its commit."""
    a, b = stock, Engine(spark, stock.storage.folder)
    create, once = a.storage._create, []

    def late(name, content):
        if not once:
            once.append(b.load("bolts", spark.createDataFrame([(9001,)], "no long")))
            b.sql("DELETE FROM bolts WHERE no = 5")
        return create(name, content)

    monkeypatch.setattr(a.storage, "_create", late)
    assert a.load("bolts", spark.createDataFrame([(9002,), (9003,)], "no long")) == 2
    for e in (a, b, Engine(spark, a.storage.folder)):
        found = e.sql("SELECT no FROM bolts WHERE no > 9000")
        assert sorted(column(found, "no")) == [9001, 9002, 9003]
        assert len(set(r["_rid"] for r in e.storage.read("bolts").collect())) == 4002


def test_a_replayed_batch_adds_nothing(stock, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,a\n2,b\n")
    stream = spark.readStream.schema("no long, note string").csv(str(tmp_path / "in"))
    append_stream(stock, "bolts", stream, str(tmp_path / "check")).awaitTermination(60)
    assert stock.storage.get("bolts").rows == 4002
    assert stock.load("bolts", spark.createDataFrame([(1,)], "no long"), stream=str(tmp_path / "check"), batch=0) == 0
    assert stock.load("bolts", spark.createDataFrame([(3,)], "no long"), stream=str(tmp_path / "check"), batch=1) == 1
    assert stock.load("bolts", spark.createDataFrame([(3,)], "no long"), stream="another", batch=1) == 1
    assert Engine(spark, stock.storage.folder).storage.get("bolts").rows == 4004


def test_leaves_are_cut_where_rows_are(spark, tmp_path, monkeypatch):
    """A hashed layout: an equality reads one leaf of each part, an append leaves the others as they are."""
    monkeypatch.setattr(layout, "LEAF_ROWS", 150)
    e = Engine(spark, str(tmp_path / "w"))
    e.sql("CREATE TABLE t (k INT, name TEXT)")
    e.sql("CREATE INDEX ON t (k) USING hash")
    rows = spark.range(3000).selectExpr("if(id < 1000, 7, id) AS k", "cast(id AS string) AS name")
    e.load("t", rows)
    found = e.sql("SELECT name FROM t WHERE k = 7")
    assert sorted(map(int, column(found, "name"))) == list(range(1000))
    leaves = {f for f in layout.layout(e.storage, "t", "k").inputFiles()}
    assert len(leaves) > 12 and found.reads <= 0.25 * len(leaves)
    one = e.sql("SELECT name FROM t WHERE k = 2500")
    assert column(one, "name") == ["2500"] and one.reads <= 2
    before = files(e, "t")
    e.load("t", spark.createDataFrame([(2500, "again")], "k long, name string"))
    assert column(e.sql("SELECT name FROM t WHERE k = 2500"), "name") == ["2500", "again"]
    assert set(before.items()) <= set(files(e, "t").items())
    assert column(e.sql("SELECT name FROM t WHERE k = 12345"), "name") == []


def test_spatial_queries_read_few_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "LEAF_ROWS", 60)
    r = random.Random(2)
    points = [(i, [r.gauss(0, 5), r.gauss(0, 1)] if i % 4 else [r.uniform(50, 60), r.uniform(50, 60)]) for i in range(2000)] + [(5000, None), (5001, [1.0])]
    e = Engine(spark, str(tmp_path / "m"))
    e.sql("CREATE TABLE p (no INT, at VECTOR)")
    e.sql("CREATE INDEX ON p (at) USING rtree")
    df = spark.createDataFrame(points, "no long, at array<double>")
    e.load("p", df.filter("no % 2 = 0"))
    e.load("p", df.filter("no % 2 = 1"))
    live = dict(points[:2000])

    def check():
        near = sorted(live, key=lambda i: (np.hypot(live[i][0] - 55, live[i][1] - 52)))[:20]
        found = e.sql("SELECT no FROM p WHERE KNN(at, [55, 52], 20)")
        assert column(found, "no") == near
        box = e.sql("SELECT no FROM p WHERE WITHIN(at, [-1, -1], [0, 0.5])")
        assert sorted(column(box, "no")) == sorted(i for i, (x, y) in live.items() if -1 <= x <= 0 and -1 <= y <= 0.5)
        return found.reads, box.reads

    whole = len(reduce_files(layout.points(e.storage, "p", "at")))
    assert max(check()) < 0.4 * whole
    for i in sorted(live, key=lambda i: np.hypot(live[i][0] - 55, live[i][1] - 52))[:30]:
        e.sql(f"DELETE FROM p WHERE no = {i}")
        del live[i]
    check()
    assert len(column(e.sql("SELECT no FROM p WHERE KNN(at, [0, 0], 4000)"), "no")) == len(live)


def reduce_files(held):
    return [f for p in held.parts for f in p.inputFiles()]


# Full text
def made_docs(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, "\n\n".join(" ".join(r.choices(vocabulary, weights, k=r.randint(1, 40))) for _ in range(r.randint(0, 3)))) for i in range(n)]


def saver(spark, folder):
    def written(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return written


@pytest.mark.parametrize(("parts", "fetched"), [(1, 30), (3, 30), (1, 0), (3, 10_000), (1, 10_000)])
def test_early_end_gives_the_same_rows(spark, tmp_path, monkeypatch, parts, fetched):
    """Against scoring everything, with few postings and chunks at a time, so that bounds decide."""
    monkeypatch.setattr(impact, "FIRST_LEAST", 20)
    monkeypatch.setattr(impact, "FIRST_PER_K", 2)
    monkeypatch.setattr(impact, "WEIGHED", 6)
    monkeypatch.setattr(impact, "FETCHED", fetched)
    docs = spark.createDataFrame(made_docs(400, parts) + [(1000, None), (1001, "w3"), (1002, "w3")], "doc_id long, text string")
    each = [docs.filter(F.col("doc_id") % parts == i) for i in range(parts)]
    gone = docs.filter("doc_id % 11 = 3") if parts > 1 else None
    live = docs if gone is None else docs.filter("doc_id % 11 <> 3")
    index = impact.index(each, "doc_id", "text", saver(spark, tmp_path), gone)
    plain = text.held(text.index_text(live, "doc_id", "text"))
    for query, k in (("w3", 4), ("w0 w1 w2", 10), ("w250 w7 w7", 3), ("w1 zz", 5), ("zz", 3), ("w299 w298 w0", 500), ("the", 3)):
        want = [(int(r["doc_id"]), round(r["score"], 6), r["best_chunk"]) for r in text.match(plain, query, k, digits=6).collect()]
        assert [(i, round(s, 6), c) for i, s, c in index.top(words.Counted("rule")(query), k, digits=6)] == want


def test_few_postings_are_read(spark, tmp_path, monkeypatch):
    """On 10,000 documents less than a tenth of the query's postings."""
    monkeypatch.setattr(impact, "FETCHED", 1000)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    index = impact.index([docs], "doc_id", "text", saver(spark, tmp_path))
    assert len(index.top(words.Counted("rule")("the thand of tion ing"), 10)) == 10 and 0 < index.read < index.whole / 10


def test_counts_follow_inserts_and_deletes(spark, tmp_path):
    """An INSERT builds tables of its own part; weights are those of an index made anew."""
    e = Engine(spark, str(tmp_path / "w"))
    e.sql("CREATE TABLE d (no INT, body TEXT)")
    e.sql("CREATE INDEX ON d (body) USING inverted")
    rows = made_docs(120, 5)
    e.load("d", spark.createDataFrame(rows[:90], "no long, body string"))
    ask = 'SELECT no FROM d WHERE MATCH(body, "w2 w40 w9", 12)'
    e.sql(ask).rows()
    before = files(e, "d")
    e.load("d", spark.createDataFrame(rows[90:], "no long, body string"))
    e.sql("DELETE FROM d WHERE no BETWEEN 40 AND 50")
    got = [(r["no"], round(r["score"], 9)) for r in e.sql(ask).rows()]
    first = e.storage.get("d").parts[0].path.rpartition("/")[2]
    assert {n: s for n, s in files(e, "d").items() if n.startswith(first)} == {n: s for n, s in before.items() if n.startswith(first)}
    anew = text.index_text(spark.createDataFrame([r for r in rows if not 40 <= r[0] <= 50], "no long, body string"), "no", "body")
    want = {int(r["doc_id"]): round(r["score"], 9) for r in text.match(anew, "w2 w40 w9").collect()}
    assert [s for _, s in got] == sorted(want.values(), reverse=True)[:12] and all(want[i] == s for i, s in got)
    assert len(e.sql('SELECT no FROM d WHERE MATCH(body, "w2 w40 w9")').rows()) == len(want)


def test_words_in_python_are_those_in_sql(spark):
    tokens = ["running", "hopped", "flies", "dried", "glass", "buses", "agreed", "nationalization", "ers", "sings", "seeing", "fully", "ably", "as", "its"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert [r[0] for r in df.select(F.expr(words.stem_sql("t"))).collect()] == [words.stem_rule(t) for t in tokens]
    texts = ["", " \n ", "one para", "a\n\nb \n \nc", "\n\n lone \n\n", " ".join(["w  x\t"] * 130), "x" * 500, "İSTANBUL KK é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r["chunks"] for r in words.with_chunks(rows, "text", ["i"]).orderBy("i").collect()] == [words.cut(t) for t in texts]
    for analyzer in ("rule", "porter2"):
        flat = words.terms(rows, "text", ["i"], analyzer).groupBy("i").agg(F.sort_array(F.collect_list("term")).alias("t")).collect()
        count = words.Counted(analyzer)
        assert {r["i"]: r["t"] for r in flat} == {i: sorted(x for x, n in c.items() for _ in range(n)) for i, t in enumerate(texts) if (c := count(t))}


def test_many_queries_at_once(spark):
    docs = spark.createDataFrame(made_docs(150, 8), "doc_id long, text string")
    asked = spark.createDataFrame([("a", "w1 w2"), ("b", "w77"), ("c", None), ("d", "nothing")], "id string, text string")
    index = text.held(text.index_text(docs, "doc_id", "text"))
    got = {}
    for r in text.match_batch(index, asked, "id", "text", 7, digits=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"], r["best_chunk"]))
    want = {q: [tuple(r) for r in text.match(index, t, 7, digits=6).collect()] for q, t in (("a", "w1 w2"), ("b", "w77"))}
    assert got == {q: rows for q, rows in want.items() if rows}


# Vectors
def test_inverted_lists(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(1500, 16)) + np.repeat(np.random.default_rng(4).normal(size=(15, 16)) * 2, 100, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, [1.0, 2.0]), (2001, None), (2002, [0.0] * 16)]
    df = spark.createDataFrame(rows, "no long, v array<double>")
    centres = ivf.fit(df, "no", "v", 24)
    laid = saver(spark, tmp_path)(ivf.assigned(df, "v", centres), "lists")
    assert {r["_list"] for r in laid.filter("no = 2000").collect()} == {ivf.OTHERS} and laid.count() == 1501
    asked = df.filter("no % 50 = 0")
    true = {(r["query_id"], r["rank"]): r["key"] for r in vector.cosine_batch(df, "no", "v", asked, 10).collect()}
    whole = {(r["query_id"], r["rank"]): r["key"] for r in ivf.batch(laid, "no", "v", asked, 10, centres, 24).collect()}
    assert whole == true
    some = ivf.batch(laid, "no", "v", asked, 10, centres, 8).collect()
    assert np.mean([r["key"] in {true.get((r["query_id"], i)) for i in range(1, 11)} for r in some]) >= 0.9


def test_lists_of_the_engine(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "LEAST", 100)
    x = np.random.default_rng(5).normal(size=(600, 8)).round(3)
    e = Engine(spark, str(tmp_path / "v"))
    e.sql("CREATE TABLE t (no INT, v VECTOR)")
    e.sql("CREATE INDEX ON t (v) USING knn WITH (lists = 12, probes = 12)")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "no long, v array<double>")
    e.load("t", df.filter("no < 500"))
    e.load("t", df.filter("no >= 500"))
    live = {i: v for i, v in enumerate(x)}

    def check(k=8):
        q = x[17]
        want = sorted(live, key=lambda i: (-round(float(live[i] @ q / np.linalg.norm(live[i]) / np.linalg.norm(q)), 12), str(i)))[:k]
        assert column(e.sql(f"SELECT no FROM t WHERE KNN(v, {q.tolist()}, {k})"), "no") == want
        return want

    best = check()
    for i in best[:2]:
        e.sql(f"DELETE FROM t WHERE no = {i}")
        del live[i]
    e.sql(f"INSERT INTO t VALUES ({best[2]}, {(-x[17]).tolist()})")  # the last vector of a key counts
    live[best[2]] = -x[17]
    check()
    check(700)


@pytest.mark.parametrize("most", [500_000, 40])
def test_postings_carry_lengths_without_being_collected(spark, monkeypatch, most):
    """Lengths of a loop; chunks meet them as they are, and postings are only dealt to their place."""
    from fathom.operators import text as text_ops

    monkeypatch.setattr(text_ops, "BROADCAST_TERMS", most)
    held = impact.vectors(spark.createDataFrame(made_docs(60, 2), "doc_id long, text string"), "doc_id", "text")
    found = impact.postings(held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange rangepartitioning(term") == 1
    tf = {(r["rid"], r["chunk_no"]): dict(zip(r["terms"], r["tfs"], strict=True)) for r in held.collect()}
    df = {}
    for t in (t for v in tf.values() for t in v):
        df[t] = df.get(t, 0) + 1
    norm = {c: np.sqrt(sum((n * (np.log((len(tf) + 1) / (df[t] + 1)) + 1)) ** 2 for t, n in v.items())) for c, v in tf.items()}
    rows = found.collect()
    assert sorted((r["rid"], r["chunk_no"], r["term"], r["tf"]) for r in rows) == sorted((*c, t, n) for c, v in tf.items() for t, n in v.items())
    assert all(abs(r["norm"] - norm[r["rid"], r["chunk_no"]]) < 1e-9 for r in rows)
