import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from fathom.llm import exact, language, mixing, op4, simhash, tokens
from fathom.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(df[columns].astype(str).itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_pipeline_stages(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if i < 4:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            docs = out
    empty = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    assert all(stage(spark, empty, DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_stages_take_columns_of_any_name(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= docs.count() > 0
    bare = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert mixing.in_mixed_order(bare, {"a": 2}).columns == ["doc_id", "text"] and mixing.in_mixed_order(bare, {}).count() == 2
    for stage in (language.accepted, exact.without_copies, simhash.without_similar):
        assert stage(bare.drop("text").withColumn("lang", bare.doc_id.cast("string"))).count() <= 2


def similar_roots(docs):
    sets = {d: set(simhash.shingles(t, 5).tolist()) for d, t in docs.items()}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
    return root


def test_pipeline_against_loops(spark):
    """Which documents are left, their pieces, and the mixed order in which they fill sequences."""
    rows = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    classify = language.classifier(language.fit(spark.read.parquet(f"{DATA}/documents.parquet")))
    found = {d: classify(r["text"]) for d, r in rows.items()}
    left = {d: rows[d]["text"] for d, (lang, margin) in found.items() if lang != "und" and margin >= language.LEAST_MARGIN}
    groups = defaultdict(list)
    for d, t in left.items():
        groups[re.sub("[\\x20\\x09-\\x0d]", "", t)].append((-len(t), d))
    left = {d: left[d] for _, d in map(min, groups.values())}
    roots = similar_roots(left)
    left = {d: t for d, t in left.items() if roots[d] == d}

    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(out["doc_id"]) == set(left)
    e = tokens.Encoder()
    for d, mine in out.groupby("doc_id"):
        ids = np.append(e.ids(left[d]), np.uint32(2)).astype("<u4")
        mine = mine.sort_values("piece")
        assert mine["length"].sum() == len(ids) and list(mine["piece"]) == list(range(-(-len(ids) // 1024)))
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine["start"], mine["length"], strict=True)] == list(mine["ids_crc32"])
    for _, mine in out.groupby("sequence_id"):
        mine = mine.sort_values("offset")
        assert list(mine["offset"]) == [0, *mine["length"].cumsum()[:-1]] and mine["length"].sum() <= 1024

    sources = defaultdict(list)
    for d in left:
        sources[rows[d]["source"] or ""].append((hashlib.md5(str(d).encode()).hexdigest(), d))
    blocks = {s: -(-len(x) // op4.BLOCK) for s, x in sources.items()}
    order, done = [], Counter()
    while any(done[s] < n for s, n in blocks.items()):  # a round: earliest deadline first
        quota = {s: min(op4.WEIGHTS.get(s, 1), n - done[s]) for s, n in sorted(blocks.items()) if n > done[s]}
        size, given = sum(quota.values()), Counter()
        for slot in range(size):
            s = min((-(-(given[s] + 1) * size // q), s) for s, q in quota.items() if given[s] < q and given[s] * size // q <= slot)[1]
            order += [d for _, d in sorted(sources[s])[done[s] * op4.BLOCK : (done[s] + 1) * op4.BLOCK]]
            given[s] += 1
            done[s] += 1
    place = {d: i for i, d in enumerate(order)}
    assert len(place) == len(left)
    out["place"] = out["doc_id"].map(place)
    first = out.groupby("sequence_id")["place"].min().sort_index()
    assert first.is_monotonic_increasing  # sequences come in the order that mixing gave
