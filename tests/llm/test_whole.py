"""Operators do the whole job where short cuts lost parts of it."""

import random

import numpy as np
import pytest

from fathom.llm import licenses, simhash

SCHEMA = "doc_id long, text string"


def slow_groups(docs):
    sets = {d: set(simhash.shingles(t, 5).tolist()) for d, t in docs}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
    return {d: r for d, r in root.items() if list(root.values()).count(r) > 1}


def boilerplate():
    """Texts of one boilerplate, in which others lie nearer by SimHash than the true copies do."""
    r = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    docs = []
    for i in range(60):
        own = [f"o{i}_{k}" for k in range(r.randint(8, 26))]
        docs.append((2 * i, " ".join(shared + own)))
        cut = r.randint(1, 6)
        docs.append((2 * i + 1, " ".join(shared[cut:] + own + [f"e{i}_{k}" for k in range(r.randint(0, 6))])))
    return docs


def found(spark, docs):
    return {r["node"]: r["root"] for r in simhash.similar_groups(spark.createDataFrame(docs, SCHEMA)).collect()}


def test_all_pairs_of_many_variants_are_found(spark):
    docs = boilerplate()
    assert found(spark, docs) == slow_groups(docs)


def test_nothing_depends_on_the_links_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "links", lambda *_: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(simhash.Bucket, "star", lambda _: iter(()))
    docs = boilerplate()
    assert found(spark, docs) == slow_groups(docs)


@pytest.mark.parametrize("seed", range(3))
def test_prefixes_of_similar_sets_meet(seed):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2000, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2000, n // 8).astype(np.uint64)]))
        common = np.unique(rng.integers(0, 2000, 300).astype(np.uint64))
        counts = rng.integers(1, 5, len(common))
        both = len(np.intersect1d(x, y))
        if both and both >= 0.8 * (len(x) + len(y) - both):
            p, q = (simhash.prefix(s, common, counts, 0.8) for s in (x, y))
            first = next(g for g in p if g in set(q.tolist()))
            at = np.array([list(p).index(first), list(q).index(first)])
            bits = np.array([simhash.parity(x), simhash.parity(y)])
            bucket = simhash.Bucket(np.array([1, 2]), np.array([len(x), len(y)]), at, bits[:, 0].copy(), bits[:, 1].copy(), np.array([1, 2]), 0.8)
            assert [(i.tolist(), j.tolist()) for i, j in bucket.pairs()] in ([([1], [2])], [([2], [1])])
            assert [(i.tolist(), j.tolist()) for i, j in bucket.star() if len(i)] == [([1], [2])]


def test_repeats_hide_no_similar_text(spark):
    words = [f"w{i}" for i in range(120)]
    text = " ".join(words)
    docs = [(1, text), (2, text + (" " + " ".join(words[:9])) * 300), (3, " ".join(f"v{i}" for i in range(50)))]
    assert found(spark, docs) == slow_groups(docs) == {1: 1, 2: 1}


def test_equal_prints_do_not_stand_for_each_other(spark):
    passage = " ".join(f"p{i}" for i in range(5))
    docs = [(d, f"{passage} " * 3000 + " ".join(f"{x}{i}" for i in range(40))) for d, x in ((1, "a"), (2, "b"), (3, "b"))]
    docs[2] = (3, docs[2][1] + " more")
    assert found(spark, docs) == slow_groups(docs) == {2: 2, 3: 2}


@pytest.mark.parametrize("copies", [2, 5])
@pytest.mark.parametrize("between", [" ", " Copyright 2020 A B "])
@pytest.mark.parametrize("gap", [0, 1])
def test_adjacent_copies_of_a_license_are_told_apart(copies, between, gap):
    words = licenses.words_of(licenses.TEMPLATES["MIT"])
    text = between.join([" ".join(words[: 60 - gap] + words[60:])] + [" ".join(words)] * (copies - 1))
    found = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST_COVERAGE).scan(text)
    size = len(words) - gap + len(between.split())
    assert [x[0] for x in found] == ["MIT"] * copies
    assert [x[2] for x in found] == [0, *(size + i * (size + gap) for i in range(copies - 1))]
    assert [x[1] for x in found[1:]] == [1] * (copies - 1)
