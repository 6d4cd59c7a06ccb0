import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathom.llm import ann, mixing, packing, tokens

from .conftest import ROWS


def test_packing_round_trip(odd, none):
    rows = packing.pack(odd).collect()
    e, by_doc, by_sequence = tokens.Encoder(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text, *_ in ROWS:
        ids = np.append(e.ids(text or ""), np.uint32(2)).astype("<u4")
        assert sum(r["length"] for r in by_doc[doc_id]) == len(ids) * (2 if doc_id == 8 else 1)
        for r in by_doc[doc_id]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["length"] == min(len(ids), 1024) or r["piece"] == 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) == math.ceil(sum(r["length"] for r in rows) / 1024)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_demand_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    demand = np.zeros(100, np.int64)
    demand[rng.integers(1, 100, 30)] = rng.integers(1, 400, 30)
    found, by_program, bound = packing.plan(demand, 100)
    assert (held_by(found, 100) == demand).all()
    assert (demand * np.arange(100)).sum() / 100 <= bound + 1e-6 and bound <= sum(t for _, t in found) + 1e-9
    assert sum(t for _, t in found) <= 1.05 * bound + 3 and 0 <= by_program <= demand.sum()


def held_by(found, capacity):
    got = np.zeros(capacity, np.int64)
    for filling, times in found:
        assert sum(n * k for n, k in filling.items()) <= capacity
        for n, k in filling.items():
            got[n] += k * times
    return got


@pytest.mark.parametrize("times", [1, 26])
def test_the_program_places_most_pieces_of_real_lengths(times):
    """Lengths of the 0.1 table's documents: the plan is the program's, and beats best fit decreasing."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    e = tokens.Encoder()
    demand = np.bincount([(len(e.ids(t or "")) + 1) % 1024 for t in texts], minlength=1024).astype(np.int64) * times
    demand[0] = 0
    found, by_program, bound = packing.plan(demand, 1024)
    assert (held_by(found, 1024) == demand).all()
    assert by_program >= 0.75 * demand.sum()
    size = sum(t for _, t in found)
    assert size <= sum(t for _, t in packing.best_fit(demand, 1024))
    assert size <= math.ceil(bound * 1.0002)


def test_weights_converge_to_the_bound():
    demand = np.zeros(101, np.int64)
    demand[[51, 27, 26, 23, 25]] = 600  # an optimum in the tens of thousandths isn't needed, a close one is
    used, bound = packing.solve(demand, 100)
    assert bound <= sum(used.values()) <= 1.1 * bound


def slow_knapsack(value, capacity):
    best = [0.0]
    for room in range(1, capacity + 1):
        best.append(max([best[-1], *(best[room - n] + v for n, v in enumerate(value) if 0 < n <= room and v > 0)]))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_knapsack_and_its_configurations_are_best(seed):
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(41) < 0.4, rng.random(41) * np.arange(41), 0)
    value[0] = 0
    best, taken = packing.knapsack(value, value > 0, 40)
    assert np.allclose(best, slow_knapsack(value, 40))
    first = np.flatnonzero(value > 0)
    for n, row in zip(first, packing.configurations(taken, first, np.full(41, 1000), 40), strict=True):
        assert n in row and row.sum() <= 40 and np.isclose(value[row].sum(), value[n] + best[40 - n])
    assert all(np.bincount(row, minlength=41)[n] <= 2 for row in packing.configurations(taken, first, np.full(41, 2), 40) for n in first)


def test_packing_follows_the_order_of_files(spark, tmp_path):
    texts = [" ".join(["word"] * (1 + 37 * i % 400)) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartitionByRange(5, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(str(tmp_path / "d"))
    rows = packing.pack(spark.read.parquet(str(tmp_path / "d")), in_order=True).toPandas()
    assert sorted(rows["doc_id"]) == list(range(600))
    first = rows.groupby("sequence_id")["doc_id"].max().sort_index()  # the earliest in files ordered by id, descending
    assert first.is_monotonic_decreasing and len(first) == packing.pack(docs).select("sequence_id").distinct().count()
    assert packing.pack(docs.filter("doc_id < 0"), in_order=True).count() == 0


def edf(weights, blocks):
    """Slot by slot, with rounds that shrink as sources run out."""
    out, left = [], dict(blocks)
    while any(left.values()):
        quota = {s: min(weights[s], left[s]) for s in sorted(left) if left[s]}
        size, done = sum(quota.values()), Counter()
        for t in range(size):
            ready = [(-(-(done[s] + 1) * size // q), s) for s, q in quota.items() if done[s] < q and done[s] * size // q <= t]
            s = min(ready)[1]
            out.append((s, blocks[s] - left[s]))
            done[s] += 1
            left[s] -= 1
    return out


def test_mixing_against_slots(spark):
    sizes, weights = {"a": 97, "b": 40, "c": 5, "": 1}, {"a": 3, "b": 2, "c": 1, "": 1}
    docs = [(i, s or None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    found = mixing.mixed(spark.createDataFrame(docs, "doc_id long, source string"), {"a": 3, "b": 2}, block=4).orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(len(docs)))
    runs = list(dict.fromkeys((r["source"], r["block"]) for r in found))
    assert runs == edf(weights, {s: -(-n // 4) for s, n in sizes.items()})
    # While all sources last, every prefix of blocks is within one block of the weights.
    total = sum(weights.values())
    for t in range(1, total + 1):
        have = Counter(s for s, _ in runs[:t])
        assert all(abs(have[s] - t * w / total) < 1 for s, w in weights.items())


def test_mixing_odd_rows(odd, none):
    got = mixing.mixed(odd, {"a": 2}, block=2)
    assert sorted(r["position"] for r in got.collect()) == list(range(len(ROWS)))
    assert mixing.in_mixed_order(odd, {"a": 2}).columns == odd.columns
    assert mixing.in_mixed_order(odd, {"a": 2}).count() == len(ROWS)
    assert mixing.mixed(none, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(odd, {"a": 0})


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors
    x[200:260] = x[200] + 1e-3 * rng.normal(size=(60, 16)).astype(np.float32)
    x[300] *= 7  # lengths differ
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index, shards = ann.build_index(df)
    found = defaultdict(list)
    for r in ann.nearest(df.filter("vec_id % 20 = 0"), index, shards).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 20):
        score = x.astype(np.float64) @ x[q].astype(np.float64)
        score[q] = -np.inf
        top = np.lexsort((np.arange(1500), -score))[:20]
        hits += len(set(top.tolist()) & {v for v, _ in found[q]})
        assert [v for v, _ in found[q]] == [v for v, _ in sorted(found[q], key=lambda p: (-p[1], p[0]))]
        assert all(np.isclose(s, score[v], rtol=1e-12) for v, s in found[q])
    assert hits / (20 * 75) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index, shards = ann.build_index(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df.filter("vec_id % 20 = 0"), index, shards).collect()}
    assert got == {(0, 1): (20, 1.0), (0, 2): (1, 0.5), (20, 1): (0, 1.0), (20, 2): (1, 0.5)}
    empty = df.filter("false")
    index, shards = ann.build_index(empty)
    assert ann.nearest(empty, index, shards).count() == 0 and ann.nearest(df, index, shards).count() == 0


def test_scores_are_of_the_original_vectors(spark):
    """Doubles that floats can't tell apart, and that are beyond them."""
    g = np.random.default_rng(8)
    x = 1 + g.normal(size=(300, 6)) * 1e-9
    for scale in (1.0, 1e150):
        rows = x * scale
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        index, shards = ann.build_index(df)
        got = ann.nearest(df.filter("vec_id % 100 = 0"), index, shards, 5).collect()
        assert len(got) == 15 and all(r["score"] == pytest.approx(float(rows[r["query_id"]] @ rows[r["vec_id"]]), rel=1e-14) for r in got)
    wide = spark.createDataFrame([(i, [1e300 * (i + 1), -1e300]) for i in range(5)], "vec_id long, embedding array<double>")
    index, shards = ann.build_index(wide)
    assert ann.nearest(wide.filter("vec_id = 0"), index, shards, 3).count() == 3
