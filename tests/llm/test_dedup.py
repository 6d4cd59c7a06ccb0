import hashlib
import re
import shutil
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from fathom.llm import exact, simhash
from fathom.llm.common import components

from .conftest import ROWS

WHITE = re.compile("[\x20\x09-\x0d]")


def test_exact_report(odd, none):
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[hashlib.sha256(WHITE.sub("", text or "").encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = sorted((str(d), str(min(g)[3]), len(g), d == min(g)[3], sha) for sha, g in groups.items() for *_, d in g)
    for split in ((odd, None), exact.halves(odd)[::-1]):
        got = exact.exact_dedup(*split).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == want
    assert exact.exact_dedup(none).count() == 0


def test_texts_of_equal_digests_are_told_apart(odd, spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "cd")], "doc_id long, text string")
    digest = hashlib.sha256(b"ab").hexdigest()
    found = exact._by_bytes(exact._rows(texts).selectExpr("*", "false AS old"), spark.createDataFrame([(digest,)], "digest string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == {(1, 2, 2), (2, 2, 2)}


def test_a_snapshot_is_kept_and_extended(spark, tmp_path):
    """Its texts' table may go; batches find what layers hold; the result is that of all texts at once."""
    texts = [(i, f"t{i % 40} {i % 3 * ' '}x") for i in range(120)] + [(None, "t1 x"), (7, "t7 x")]
    def table(rows): return spark.createDataFrame(rows, "doc_id long, text string")
    table(texts[:50]).write.parquet(str(tmp_path / "first"))
    exact.Snapshot(spark, str(tmp_path / "s")).extended(spark.read.parquet(str(tmp_path / "first")))
    shutil.rmtree(tmp_path / "first")
    held = exact.Snapshot(spark, str(tmp_path / "s"))
    want = {str(r) for r in exact.exact_dedup(table(texts[:80])).drop("from_snapshot").collect()}
    assert {str(r) for r in exact.exact_dedup(table(texts[50:80]), held).drop("from_snapshot").collect()} == want
    both = held.extended(table(texts[50:80]))
    assert len(held.layers) == 1 and len(both.layers) == 2 == len(exact.Snapshot(spark, str(tmp_path / "s")).layers)
    want = sorted(str(r) for r in exact.exact_dedup(table(texts)).drop("from_snapshot").collect())
    assert sorted(str(r) for r in exact.exact_dedup(table(texts[80:]), both).drop("from_snapshot").collect()) == want
    assert [r["old"] for r in exact.exact_dedup(table([]), both).groupBy().agg(F.min("from_snapshot").alias("old")).collect()] == [True]


def test_no_group_outgrows_a_shard(spark, tmp_path, monkeypatch):
    """A large batch against a small snapshot, and against none."""
    monkeypatch.setattr(exact, "SHARD_KEYS", 100)
    sizes = spark.sparkContext.accumulator([], ListOf())
    was = exact._screened
    def counted(rows, filters):
        sizes.add([len(rows)])
        return was(rows, filters)
    monkeypatch.setattr(exact, "_screened", counted)
    batch = spark.range(5000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    held = exact.Snapshot(spark, str(tmp_path / "s")).extended(batch.limit(10))
    assert exact.exact_dedup(batch.filter("doc_id >= 10"), held).filter("kept").count() == 5000
    assert 40 <= len(sizes.value) and max(sizes.value) < 200
    sizes.value = []
    assert exact.exact_dedup(batch).filter("kept").count() == 5000 and sizes.value == []


class ListOf(AccumulatorParam):
    def zero(self, value): return []
    def addInPlace(self, a, b): return a + b


def test_too_many_ids_for_a_screen(spark, odd, monkeypatch):
    want = sorted(map(str, exact.without_copies(odd).collect()))
    groups = sorted(map(str, simhash.similar_groups(odd).collect()))
    monkeypatch.setattr(exact, "SCREEN_BYTES", 0)
    assert exact.screen(odd.selectExpr("doc_id AS key")) is None
    assert sorted(map(str, exact.without_copies(odd).collect())) == want and sorted(map(str, simhash.similar_groups(odd).collect())) == groups


def test_repeated_ids_lose_no_text(spark):
    """One id, two texts: a near copy of another document goes, a text like no other stays, in either order."""
    a = " ".join(f"w{i}" for i in range(80))
    copy, other = f"{a} more", " ".join(f"o{i}" for i in range(60))
    for rows in ([(1, a), (2, copy), (2, other)], [(2, other), (1, a), (2, copy), (None, a)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS node", "'z' AS row", "'z' AS sha")
        left = simhash.without_similar(df.repartition(2))
        assert left.columns == df.columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("1", a), ("2", other), *([("None", a)] if len(rows) > 3 else [])])
    same = spark.createDataFrame([(5, a), (5, a), (4, copy), (5, other)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.without_similar(same).collect()) == [(4, copy), (5, other)]


def test_stage_keeps_one_of_each(odd):
    kept = exact.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "6", "7", "8", "9", "None"]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_filters_have_no_false_negatives(keys):
    keys = np.array(sorted(keys), np.uint64)
    built = exact.build_filter(keys)
    assert exact.probe(keys, *built).all()


def test_filters_reject_most_others():
    keys = np.random.default_rng(0).permutation(np.arange(200_000, dtype=np.uint64))
    built = exact.build_filter(keys[:100_000])
    assert exact.probe(keys[100_000:], *built).mean() < 0.01


def slow_print(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints, distance):
    root = list(range(len(prints)))
    for _ in prints:
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= distance:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_duplicates_on_odd_rows(odd, none):
    prints = [slow_print(t, 3) for _, t, *_ in ROWS]
    roots = slow_roots(prints, 2)
    want = []
    for (doc_id, *_), p, r in zip(ROWS, prints, roots, strict=True):
        ids = [d for (d, *_), q in zip(ROWS, roots, strict=True) if q == r and d is not None]
        want.append((str(doc_id), f"{p:016x}", str(min(ids, default=None))))
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted(want)
    assert simhash.near_duplicates(none).count() == 0


def test_all_links_of_chains_are_found(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    chains = [base]
    for _ in range(4):
        flips = np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))], np.uint64)
        chains.append(chains[-1] ^ flips)
    prints = np.unique(np.concatenate(chains))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    for hot, dense in ((20_000, 4096), (2, 1)):  # as usual, and with all buckets split and ball-joined
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        monkeypatch.setattr(simhash, "DENSE", dense)
        linked = simhash.links(df, 2)
        roots = {r["node"]: r["root"] for r in components(linked).collect()}
        got = [roots.get(int(x), int(x)) for x in prints.view(np.int64)]
        want = slow_roots([int(x) for x in prints], 2)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
        assert all((int(np.uint64(np.int64(r["a"]).view(np.uint64)) ^ np.int64(r["b"]).view(np.uint64))).bit_count() <= 2 for r in linked.collect())


def test_similar_texts_are_grouped_and_others_left(spark):
    words = [f"w{i}" for i in range(300)]
    near = words[:150] + ["new"] + words[151:]
    far = words[:100] + [f"v{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, "")], "doc_id long, text string")
    assert {(r["node"], r["root"]) for r in simhash.similar_groups(docs).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4)}
    assert sorted(r["doc_id"] for r in simhash.without_similar(docs).collect()) == [1, 3, 4]


def test_sketches():
    rng = np.random.default_rng(3)
    for a, b in ((0, 0), (0, 5), (300, 300), (300, 377), (40, 2000)):
        whole = rng.integers(0, 1 << 63, a + b, dtype=np.uint64)
        s, t = np.unique(whole[:a]), np.unique(whole[a // 10 : b + a // 10])
        both = len(np.intersect1d(s, t))
        least = both / max(len(s) + len(t) - both, 1)
        assert simhash.may_reach(simhash.sketch(s), simhash.sketch(t), (len(s), len(t)), least - 1e-9)
    s, t = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)), np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    assert not simhash.may_reach(simhash.sketch(s), simhash.sketch(t), (500, 500), 0.8)


def test_large_buckets_are_cut_and_no_link_is_lost():
    """30,000 fingerprints with one segment in common: pieces outside it cut the bucket, and linked ones share one."""
    rng = np.random.default_rng(1)
    segments = simhash.segments_for(2)
    prints = rng.integers(0, 1 << 32, 30_000, dtype=np.uint64) | np.uint64(0xABCD << 40)
    key = np.full(len(prints), 77, np.uint64)
    cut = simhash.cut_further(key, prints, np.full(len(prints), 1), segments, 2)
    assert max(np.unique(k, return_counts=True)[1].max() for k in cut) < len(prints) / 200
    other = prints.copy()
    for _ in range(2):
        other ^= np.uint64(1) << rng.integers(0, 32, len(prints)).astype(np.uint64)
    assert (cut == simhash.cut_further(key, other, np.full(len(prints), 1), segments, 2)).any(axis=0).all()


def test_shingle_sets_are_those_of_shingles():
    held = simhash._Words()
    texts = ["a b c d e f g", "A b c d e F g ", "x", "", None, "a b c d e a b c d e a b c d e", "é ü a b c d"]
    slow = [frozenset(simhash.shingles(t, 5).tolist()) for t in texts]
    fast = [frozenset(simhash.shingle_set(t, 5, held).tolist()) for t in texts]
    assert [[x == y for y in slow] for x in slow] == [[x == y for y in fast] for x in fast]
    assert [[len(x & y) for y in slow] for x in slow] == [[len(x & y) for y in fast] for x in fast]


def test_a_group_of_variants_takes_a_pair_a_member(spark):
    """400 variants of one text: leaders' pairs join them, so that hardly any are left for all pairs."""
    rng = np.random.default_rng(8)
    base, docs = [f"w{i}" for i in range(200)], []
    for i in range(400):
        text = base.copy()
        for k in rng.integers(0, 200, 3):
            text[k] = f"v{i}_{k}"
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = simhash._described(df, 5, 0.8)
    members = sets.selectExpr("doc_id", "size", "p", "q", "posexplode(prefix) AS (at, key)").selectExpr("*", "doc_id AS root")
    assert 0 < simhash._in_buckets(members, 0.8, "star").filter("a is not null").select("a", "b").distinct().count() < 20 * 400
    assert {r["root"] for r in simhash.similar_groups(df).collect()} == {0}


def test_screens_miss_no_key_and_few_others(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 5000):
        keys = rng.integers(-(2**63), 2**63, n)
        maybe = exact.screen(spark.createDataFrame([(int(k),) for k in keys], "key long"))
        assert maybe(keys).all() and maybe(rng.integers(-(2**63), 2**63, 20_000)).mean() < 0.01


def shuffled(spark, run):
    """Bytes that run() shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def so_far():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = so_far()
    run()
    return sum(n for stage, n in so_far().items() if stage not in before)


def test_whole_texts_are_not_shuffled(spark):
    """Where nothing is small enough for Spark to send it to all tasks, as on large tables."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{w:08x}" for w in rng.integers(0, 2**32, 2000)) for _ in range(200)]
    docs = simhash.saved(spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:4])], "doc_id long, text string"), "long")
    once = docs.filter("doc_id < 200")
    pairs = simhash.saved(spark.createDataFrame([(i, i + 1) for i in range(199)], "a long, b long"), "pairs")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: exact.without_copies(docs).write.format("noop").mode("overwrite").save()) < sum(map(len, texts)) / 4
        assert shuffled(spark, lambda: simhash._verified(pairs, once, 5, 0.8)) < sum(map(len, texts)) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(r["doc_id"] for r in exact.without_copies(docs).select("doc_id").collect()) == list(range(200))


def test_sets_are_made_of_few_texts_at_once():
    parts = list(simhash._slices(iter([pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 2500, 3)])))
    assert max(p.num_rows for p in parts) <= simhash.HELD_SETS and [x for p in parts for x in p.column("x").to_pylist()] == [*range(2500), *range(3)]
