"""Conjunctive search against loops, and mini-batch k-means against all vectors at once."""

import random
import re

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fathom.functions.text import Counted
from fathom.operators import kmeans, proximity


def slow_match_all(docs, query):
    count, out = Counted("rule"), {}
    asked = set(count(query))
    for doc_id, text in docs:
        at = [(i, count.of(w)) for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower()))]
        spots = [(i, t) for i, t in at if t in asked]
        covers = [(a, b) for a, _ in spots for b, _ in spots if a <= b and asked <= {t for i, t in spots if a <= i <= b}]
        shortest = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
        if shortest:
            out[str(doc_id)] = round(sum(len(asked) / (b - a + 1) for a, b in shortest), 6)
    return out


def test_match_all(spark):
    r = random.Random(9)
    docs = [(i, " ".join(r.choices(["red", "blues", "blue", "green", "the", "oak", "x"], k=r.randint(0, 25)))) for i in range(80)] + [(90, None), (91, "blue red green oak")]
    held = proximity.positions(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    for query in ("red blue", "green red blue oak", "oak", "red the blue red", "zebra red"):
        got = [(r["doc_id"], r["score"]) for r in proximity.match_all(held, query, digits=6).collect()]
        assert dict(got) == slow_match_all(docs, query) and got == sorted(got, key=lambda x: (-x[1], x[0]))
    assert proximity.match_all(held, "the of").count() == 0
    assert proximity.match_all(held, "red blue", 3).count() == 3


@pytest.fixture(scope="module")
def blobs(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(6000, 12)) + g.normal(size=(20, 12))[g.integers(0, 20, 6000)] * 4
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "no long, v array<double>")


def saver(spark, folder):
    def written(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return written


@pytest.mark.parametrize("batch", [20_000, 100])
def test_batches_come_near_to_all_vectors_at_once(spark, blobs, tmp_path, monkeypatch, batch):
    """Within two hundredths of Spark ML's k-means, which sees all vectors in each round; within five by batches of a few."""
    x, df = blobs
    monkeypatch.setattr(kmeans, "BATCH", batch)
    monkeypatch.setattr(kmeans, "PER_CENTRE", 5)
    centres = kmeans.fit(df, "no", "v", 40, saver(spark, tmp_path))
    model = KMeans(k=40, seed=1).fit(df.select(array_to_vector("v").alias("features")))
    cost = kmeans.distances(x, centres).min(1).sum()
    assert len(centres) == 40 and cost <= (1.02 if batch > 1000 else 1.05) * kmeans.distances(x, np.array(model.clusterCenters())).min(1).sum()


def test_centres_do_not_depend_on_partitions(spark, blobs, tmp_path):
    _, df = blobs
    one = kmeans.fit(df.coalesce(1), "no", "v", 8, saver(spark, tmp_path / "a"))
    many = kmeans.fit(df.repartition(7), "no", "v", 8, saver(spark, tmp_path / "b"))
    assert np.allclose(one, many, atol=1e-6)


def test_few_and_equal_vectors(spark, tmp_path):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 2.0]] * 5 + [[3.0, 4.0], None])], "no long, v array<double>")
    assert kmeans.fit(df, "no", "v", 5, saver(spark, tmp_path / "a")).tolist() == [[1.0, 2.0], [3.0, 4.0]]
    found = {r["no"]: r["word"] for r in kmeans.assigned(df, "v", np.array([[3.0, 4.0], [1.0, 2.0], [1.0, 2.0]])).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: None}
    with pytest.raises(ValueError):
        kmeans.fit(df.filter(F.col("v").isNull()), "no", "v", 2, saver(spark, tmp_path / "b"))
