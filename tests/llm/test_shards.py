"""Hilbert sharding against plain sorts and what defines the curve, and sources' divergence against plain counts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from fathom.llm import divergence, op12, op13, sharding

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("bits", "dims"), [(1, 2), (3, 2), (2, 3), (4, 3), (1, 1), (2, 4)])
def test_curve_visits_neighbours(spark, bits, dims):
    """Each cell once, and cells next to each other on the curve share a face: what makes it a Hilbert curve."""
    cells = list(product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame([(list(c),) for c in cells], "cell array<int>").selectExpr("cell", f"{sharding.hilbert('cell', bits, dims)} AS at")
    by_place = {r["at"]: r["cell"] for r in df.collect()}
    assert sorted(by_place) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(by_place[i], by_place[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))
    assert by_place[0] == [0] * dims
    # Runs that halve the curve are halves of the cube, on every level: places nest in aligned sub-cubes.
    for size in range(1, bits):
        blocks = {(at >> dims * size, tuple(c >> size for c in cell)) for at, cell in by_place.items()}
        assert len(blocks) == 1 << dims * (bits - size)


def places(rows, dims, bits, curve):
    """Rows in curve order, by plain sorts: buckets from counts of smaller codes."""
    codes = []
    for d in dims:
        values = [r[d] for r in rows]
        if d == "size":
            c = ["" if v is None else "0" if v <= 0 else f"{(v.bit_length() - 1) * 256 + (v << 8 >> (v.bit_length() - 1)) - 256 + 1:06d}" for v in values]
        else:
            some = [v.encode() for v in values if v is not None]
            low, high = min(some, default=b""), max(some, default=b"")
            shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            c = ["" if v is None else v.encode()[shared : shared + 2].hex().upper() for v in values]
        codes.append([sum(n for x, n in Counter(c).items() if x < mine) * 2**bits // len(c) for mine in c])
    order = [(curve[tuple(c[i] for c in codes)], hashlib.md5((r["text"] or "").encode()).hexdigest(), r["doc_id"] is not None, r["doc_id"] or 0) for i, r in enumerate(rows)]
    return sorted(zip(order, [(r["doc_id"], r["size"], zlib.crc32((r["text"] or "").encode())) for r in rows], strict=True))


def curve_of(spark, bits, dims):
    df = spark.createDataFrame([(list(c),) for c in product(range(1 << bits), repeat=dims)], "cell array<int>").selectExpr("cell", f"{sharding.hilbert('cell', bits, dims)} AS at")
    return {tuple(r["cell"]): r["at"] for r in df.collect()}


def check(spark, df, rows, shards):
    for r in rows:
        r["size"] = len((r["text"] or "").encode()) + 1
    want = places(rows, sharding.DIMS, sharding.BITS, curve_of(spark, sharding.BITS, 3))
    n, expected, seen = len(rows), [], Counter()
    for i, (_, row) in enumerate(want):
        shard = i * shards // n
        expected.append((*row, "rows", shard, seen[shard], None))
        seen[shard] += 1
    assert max(seen.values(), default=0) - min((seen[s] for s in range(min(shards, n))), default=0) <= 1
    got = [tuple(r[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")) for r in df.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_op13(spark):
    check(spark, op13.op13_hilbert_sharding(spark, DATA), pq.read_table(f"{DATA}/documents.parquet").to_pylist(), 8)


def test_odd_rows(spark, odd, none):
    check(spark, sharding.sharded(odd, shards=4), [r.asDict() for r in odd.select("doc_id", "text", "lang", "source").collect()], 4)
    assert sharding.sharded(none).count() == 0
    bare = spark.createDataFrame([(1, -5), (2, None), (3, 70_000), (4, 70_001)], "doc_id long, n long")
    assert sorted(r["shard"] for r in sharding.sharded(bare, dims=("n", "lang"), shards=3).collect()) == [0, 0, 1, 2]
    with pytest.raises(ValueError):
        sharding.sharded(bare, shards=0)


def test_files_prune_on_every_dimension(spark, tmp_path):
    """A condition on any one column leaves out most files, by their statistics."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('l', lpad(cast(hash(id, 1) & 31 as string), 2, '0')) AS lang", "concat('s', lpad(cast(hash(id, 2) & 31 as string), 2, '0')) AS source", "repeat('x', hash(id, 3) & 255) AS text")
    sharding.write_shards(df, str(tmp_path / "s"), files=8)
    assert spark.read.parquet(str(tmp_path / "s")).drop("shard").exceptAll(df.select("doc_id", "lang", "source", "text")).count() == 0
    files = [pq.ParquetFile(p).metadata for p in sorted((tmp_path / "s").rglob("*.parquet"))]
    assert len(files) >= 64 and sum(m.num_rows for m in files) == 20_000
    for column, value in (("lang", "l07"), ("source", "s21")):
        at = [m.row_group(0).column(i).path_in_schema for i in range(files[0].num_columns) for m in files[:1]].index(column)
        hit = sum(m.row_group(0).column(at).statistics.min <= value <= m.row_group(0).column(at).statistics.max for m in files)
        assert hit <= 0.4 * len(files)


def slow_divergence(rows, least=30):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text)]
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        p = {}
        for s in [*sources, None]:
            c = count[lang, s] if s is not None else sum((count[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for part, values in (("pair", [(sum(abs(p[source][t] - p[s][t]) for t in kept), s) for s in sources if s != source]), ("term", [(p[source][t] - p[None][t], t) for t in kept if count[lang, source][t] and p[source][t] > p[None][t]])):
            ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < 50]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_op12(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    assert got(op12.op12_source_divergence(spark, DATA)) == slow_divergence(rows)


def test_divergence_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "PAIRS", 4)
    monkeypatch.setattr(divergence, "LEAST_DOCS", 2)
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    assert got(divergence.divergence(odd)) == slow_divergence(rows, 2)
    assert divergence.divergence(none).count() == 0
    assert got(divergence.divergence(odd.select("doc_id"))) == []
    twice = odd.withColumn("source", odd.doc_id.cast("string")).drop("lang")
    assert got(divergence.divergence(twice)) == slow_divergence([(r["text"], None, r["source"]) for r in twice.collect()], 2)


def test_cells_of_large_counts():
    rows = np.array([[0, 0, 3], [1, 1, 5], [2**40, 2**40, 1], [2**40, 2**40, 2]])
    for many in (rows, rows % 1000):
        cells, n = divergence.counted_cells(many)
        assert sorted(zip(*cells.tolist(), n.tolist(), strict=True)) == sorted((*c, m) for c, m in Counter(map(tuple, many.T.tolist())).items())


def test_words_of_pieces(monkeypatch):
    text = "Ab éÀ\x00c1d " * 40 + "Äx"
    whole = [w for some in divergence.words(text.encode()) for w in some]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [w for some in divergence.words(text.encode()) for w in some] == whole
    assert whole[:4] == ["ab".encode(), "éÀ".encode(), b"c", b"d"]
