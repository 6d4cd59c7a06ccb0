import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions.porter2 import stem
from fathom.functions.text import spread
from fathom.operators import evaluate, fusion, synthetic, text, vector


def ranked(spark, **scores):
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "key string, score double")


def slow_rrf(rankings, k0):
    out = {}
    for r in rankings:
        for place, key in enumerate(sorted(r, key=lambda k: (-r[k], k)), 1):
            out[key] = out.get(key, 0) + 1 / (k0 + place)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("k0", [1, 60])
def test_reciprocal_ranks(spark, k0):
    sides = [{"oslo": 4, "rome": 4, "bern": 1}, {"bern": 0.2, "oslo": 0.1}, {"kiev": -3}]
    got = fusion.reciprocal_rank([ranked(spark, **s) for s in sides], k0=k0).collect()
    want = slow_rrf(sides, k0)
    assert [r["key"] for r in got] == [k for k, _ in want]
    assert np.allclose([r["score"] for r in got], [s for _, s in want])
    assert [r["key"] for r in fusion.reciprocal_rank([ranked(spark, **s) for s in sides], 1, k0).collect()] == [want[0][0]]


@pytest.mark.parametrize("wrong", [lambda r: fusion.reciprocal_rank([r], k0=-1), lambda r: fusion.reciprocal_rank([]), lambda r: fusion.weighted_sum(r, r, -0.1)])
def test_fusion_refuses(spark, wrong):
    with pytest.raises(ValueError):
        wrong(ranked(spark, x=1))


def test_weighted_sums_scale_each_side(spark):
    first, second = ranked(spark, oslo=30, rome=20, bern=10), ranked(spark, bern=7, kiev=7)
    got = {r["key"]: r["score"] for r in fusion.weighted_sum(first, second, 0.25).collect()}
    assert got == pytest.approx({"oslo": 0.25, "rome": 0.125, "bern": 0.75, "kiev": 0.75})  # equal scores scale to one


def cosines(x, q):
    with np.errstate(invalid="ignore"):
        return x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(12).normal(size=(700, 12)).round(2)
    x[50:90], x[5] = x[50], 0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "no long, v array<double>")


def test_cosine_top(spark, cloud):
    x, df = cloud
    score = np.where(np.linalg.norm(x, axis=1) > 0, cosines(x, x[50]), -9)
    want = sorted(range(700), key=lambda i: (-round(score[i], 9), i))[:45]
    got = [r["key"] for r in vector.cosine_top(df, "no", "v", x[50].tolist(), 45).collect()]
    assert set(got) == set(want) and not vector.cosine_top(df, "no", "v", [0.0] * 12).count() and not vector.cosine_top(df, "no", "v", [1.0]).count()


@pytest.mark.parametrize("shard", [100, 65_536])
def test_batches_against_brute_force(spark, cloud, monkeypatch, shard):
    x, df = cloud
    monkeypatch.setattr(vector, "SHARD", shard)
    monkeypatch.setattr(vector, "BLOCK", 64)
    asked = df.filter("no % 100 = 0 or no = 5").unionByName(spark.createDataFrame([(9000, [1.0]), (9001, None)], "no long, v array<double>"))
    got = {}
    for r in vector.cosine_batch(df.unionByName(spark.createDataFrame([(800, None), (None, x[0].tolist())], df.schema)), "no", "v", asked, 15, digits=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["key"], r["score"]))
    assert sorted(got) == list(range(0, 700, 100))
    for q, found in got.items():
        score = np.where(np.linalg.norm(x, axis=1) > 0, np.round(cosines(x, x[q]), 6), -9)
        assert [k for k, _ in found] == sorted(range(700), key=lambda i: (-score[i], i))[:15]
    assert vector.cosine_batch(df.limit(0), "no", "v", asked, 3).count() == 0 == vector.cosine_batch(df, "no", "v", asked.limit(0), 3).count()


def test_pruned_candidates_are_the_best_overlaps(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((2000, 80)) < 0.03, rng.random((2000, 80)), 0)
    q = np.where(rng.random(80) < 0.5, rng.random(80), 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "no long, v array<double>")
    few = (x > 0).sum(0)
    rare = np.flatnonzero((q > 0) & (few >= 1) & (few <= 100))
    overlap = x[:, rare] @ q[rare]
    want = sorted(np.flatnonzero(overlap > 0), key=lambda i: (-round(overlap[i], 12), i))[:40]
    got = vector.candidates(df, "no", q.tolist(), 10, vector.dim_postings(df, "no", "v"))
    assert sorted(r["key"] for r in got.collect()) == sorted(want)
    pruned = [r["key"] for r in vector.cosine_pruned(df, "no", "v", q.tolist(), 10).collect()]
    score = cosines(x[sorted(want)], q)
    assert pruned == [sorted(want)[i] for i in np.lexsort((sorted(want), -score))[:10]]
    assert vector.candidates(df.limit(50), "no", q.tolist(), 10, vector.dim_postings(df.limit(50), "no", "v")) is None


def test_recall_and_overlap(spark):
    def sets(*s):
        return spark.createDataFrame([(i, k) for i, x in enumerate(s) for k in x], "query_id int, key int")

    truth = sets([1, 2, 3, 4], [5, 6])
    assert evaluate.recall(sets([2, 3, 9], [5, 6]), truth).first()[0] == 0.75
    assert evaluate.recall(sets([2, 3, 9]), truth).first()[0] == 0.25
    assert evaluate.jaccard(sets([1, 2], [7]), truth).first()[0] == 0.25
    assert evaluate.jaccard(truth, truth).first()[0] == 1


def slow_chunks(body, window):
    import re

    paragraphs = [p for p in (re.sub(r"^\s+|\s+$", "", p, flags=re.A) for p in re.split(r"\n\s*\n", body or "", flags=re.A)) if p]
    if not paragraphs:
        return [body or ""]
    words = paragraphs[0].split()
    if len(paragraphs) > 1 or len(words) <= window:
        return paragraphs
    return [" ".join(words[i : i + window]) for i in range(0, len(words), window)]


def test_chunks_against_a_loop(spark):
    bodies = {"tide": "low\n\nhigh \n\t\n  slack", "calm": "  no\nwind ", "void": "", "blank": " \n\n ", "long": " ".join(f"mile{i}" for i in range(11)), "none": None, "fits": "a b c d e"}
    docs = spark.createDataFrame(list(bodies.items()), "name string, log string")
    got = {}
    for r in text.chunk_table(docs, "name", "log", 5).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
        assert r["chunk_id"] == (r["doc_id"] if len(slow_chunks(bodies[r["doc_id"]], 5)) == 1 else f"{r['doc_id']}#{r['chunk_no']}")
    assert got == {k: slow_chunks(v, 5) for k, v in bodies.items()}


def test_a_document_is_found_once_by_its_best_chunk(spark):
    docs = spark.createDataFrame([("kelp", "slow drift\n\nred kelp forest deep\n\nred kelp"), ("reef", "red coral"), ("sand", "pale dunes")], "name string, log string")
    index = text.index_text(docs, "name", "log")
    found = text.match(index, "red kelp").collect()
    assert [(r["doc_id"], r["best_chunk"]) for r in found] == [("kelp", "kelp#2"), ("reef", "reef")]
    # Lengths of the chunks that were hit are enough, and are those of all.
    whole = text.match(index, "red kelp", norms=index.norms()).collect()
    assert [r["score"] for r in found] == pytest.approx([r["score"] for r in whole])


def test_a_frozen_vocabulary_and_its_norms(spark):
    docs = spark.createDataFrame([("x", "gull crab gull"), ("y", "crab gull eel")], "name string, log string")
    index = text.frozen(text.index_text(docs, "name", "log", 1))
    assert {r["term"] for r in index.postings.collect()} == {"gull"}
    idf = math.log(3 / 3) + 1
    assert {r["chunk_id"]: r["norm"] for r in index.norms().collect()} == pytest.approx({"x": 2 * idf, "y": idf})


@pytest.mark.parametrize("word, want", [("sailing", "sail"), ("planned", "plan"), ("tides", "tide"), ("buoys", "buoy"), ("happily", "happili"), ("rational", "ration"), ("cries", "cri"), ("dying", "die"), ("news", "news"), ("by", "by")])
def test_porter2(word, want):
    assert stem(word) == want


def test_synthetic_tables(spark, tmp_path):
    docs = synthetic.documents(spark, 400).cache()
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count().orderBy(F.desc("count")).collect()
    assert sum(r["count"] for r in words) == 400 * synthetic.WORDS and words[0]["w"] == "word000" and words[0]["count"] > 5 * words[20]["count"]
    assert docs.exceptAll(synthetic.documents(spark, 400).repartition(3)).count() == 0
    v = np.array([r["vec"] for r in synthetic.vectors(spark, 300).collect()])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and 0.08 < (v > 0).mean() < 0.12
    asked = [r["query"].split() for r in synthetic.queries(docs, 7).collect()]
    assert len(asked) == 7 and all(len(q) == 2 and all(len(w) >= 4 for w in q) for q in asked)
    few = spark.createDataFrame([(f"k{i}", [float(i)]) for i in range(5)], "key string, vec array<double>")
    more = synthetic.resampled(few, 23).collect()
    assert sorted(r["nth"] for r in more) == list(range(23)) and {r["key"] for r in more} == {f"k{i}" for i in range(5)}
    with pytest.raises(ValueError):
        synthetic.resampled(few.limit(0), 3)
    synthetic.write_results(spark, [{"engine": "fathom", "size": 10}], str(tmp_path / "r"))
    row = spark.read.csv(str(tmp_path / "r"), header=True).first()
    assert tuple(row.asDict()) == synthetic.RESULT_COLUMNS and row["size"] == "10" and row["modality"] is None


def test_rounded_scores_rank_before_the_cut(spark):
    """Cosines that are equal to six digits go by key, also where only some of them fit."""
    rows = [(i, [1.0, 0.5 + (i % 7) * 1e-9]) for i in range(40)]
    df, query = spark.createDataFrame(rows, "no long, v array<double>"), [1.0, 0.0]
    for found in (vector.cosine_top(df, "no", "v", query, 5, digits=6), vector.cosine_pruned(df, "no", "v", query, 5, digits=6)):
        assert [(r["key"], r["score"]) for r in found.collect()] == [(i, 0.894427) for i in range(5)]


@pytest.fixture
def words(spark):
    r = np.random.default_rng(6)
    docs = [(i, "\n\n".join(" ".join(f"w{int(x)}" for x in r.zipf(1.6, 12) % 400) for _ in range(i % 4 + 1))) for i in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def kinds(index):
    """The index with its rows, and by its postings alone."""
    return index, text.TextIndex(index.chunks, index.postings, index.vocabulary, index.analyzer)


@pytest.mark.parametrize("most", [500_000, 20])
def test_lengths_by_frequent_and_other_terms(spark, words, monkeypatch, most):
    """Weights of few frequent terms are broadcast; lengths, scores and batches are those of a loop."""
    monkeypatch.setattr(text, "BROADCAST_TERMS", most)
    index = text.index_text(words, "doc_id", "text")
    tf = {}
    for r in index.postings.collect():
        tf.setdefault(r["chunk_id"], {})[r["term"]] = r["tf"]
    n, df = index.chunks.count(), {}
    for t in (t for c in tf.values() for t in c):
        df[t] = df.get(t, 0) + 1
    idf = {t: math.log((n + 1) / (m + 1)) + 1 for t, m in df.items()}
    norms = {c: math.sqrt(sum((x * idf[t]) ** 2 for t, x in v.items())) for c, v in tf.items()}
    for one in kinds(index):
        assert {r["chunk_id"]: r["norm"] for r in one.norms().collect()} == pytest.approx(norms)
        asked = {t: idf[t] for t in ("w1", "w5", "w33") if t in idf}
        length = math.sqrt(sum(w * w for w in asked.values()))
        want = {c: sum(v.get(t, 0) * idf[t] * w for t, w in asked.items()) / norms[c] / length for c, v in tf.items() if v.keys() & asked}
        assert {r["chunk_id"]: r["score"] for r in text.match_chunks(one, "w1 w5 w33 unknown").collect()} == pytest.approx(want)
        single = [tuple(r) for r in text.match(one, "w1 w5 w33", 6, digits=6).collect()]
        batch = text.match_batch(one, spark.createDataFrame([("a", "w1 w5 w33"), ("b", "unknown")], "q string, text string"), "q", "text", 6, digits=6).orderBy("rank").collect()
        assert [(r["doc_id"], r["score"], r["best_chunk"]) for r in batch] == single and len(single) == 6


def test_a_batch_deals_chunks_not_pairs(spark, words):
    """A batch's pairs of queries and chunks are added up where the chunk lies: none is shuffled before each task's best."""
    asked = spark.createDataFrame([(i, "w1 w2 w3") for i in range(9)], "q long, text string")
    plan = text.match_batch(text.index_text(words, "doc_id", "text"), asked, "q", "text", 3)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("hashpartitioning(query_id" in line and "chunk_id" in line for line in dealt) and any("hashpartitioning(doc_id" in line for line in dealt)


def test_a_small_number_of_partitions_is_dealt_by_size(spark):
    """A task's share of a table that is read as one partition doesn't grow with the table."""
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "50k"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(3000).coalesce(1).withColumn("text", F.concat_ws("", *[F.sha2((F.col("id") * 31 + i).cast("string"), 256) for i in range(16)]))
        parts = spread(df).select(F.spark_partition_id().alias("p"), "text").groupBy("p").agg(F.sum(F.length("text")).alias("n")).collect()
        assert len(parts) > 8 and max(r["n"] for r in parts) < 400_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_kept_terms_are_dealt_to_more_parts_than_texts_are_read_as(spark):
    """A table read as enough partitions for all cores is dealt too, as one task reads a kept partition whole."""
    df = spark.range(0, 3200, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("oslo")).alias("text"))
    index = text.held(text.index_text(df, "doc_id", "text"))
    parts = index.rows.groupBy(F.spark_partition_id()).count().collect()
    index.rows.unpersist()
    assert sum(r["count"] for r in parts) == 3200 and max(r["count"] for r in parts) <= 200
