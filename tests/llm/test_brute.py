"""Operators against plain loops over the smallest tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from tokenizers import Tokenizer

from fathom.llm import language, lm, op2, op8, op10, tokens

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    return {r["doc_id"]: (r["text"] or "", r["lang"]) for r in rows}


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op2_token_by_token(spark, texts, whole):
    got = {}
    for r in op2.op2_token_counts(spark, DATA).collect():
        got[r["doc_id"], r["section"]] = (r["start"], r["end"], r["tokens"], r["crossing"])
    want = {}
    for doc_id, (text, _) in texts.items():
        lines, at = [], 0
        for line in text.split("\n"):
            end = min(at + len(line) + 1, len(text))
            if end > at or not lines and not text:
                lines.append([at, end, 0, 0])
            at = end
        for start, end in whole.encode(text, add_special_tokens=False).offsets:
            shared = [min(end, b) - max(start, a) for a, b, *_ in lines]
            best = shared.index(max(shared))
            lines[best][2] += 1
            lines[best][3] += sum(s > 0 for s in shared) > 1
        want |= {(doc_id, i): tuple(x) for i, x in enumerate(lines)}
    assert got == want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_both_libraries_give_the_same_ids(whole, folder):
    e = tokens.Encoder()
    for text in pq.read_table(f"/root/testdata/{folder}/documents.parquet", columns=["text"]).column("text").to_pylist():
        want = whole.encode(text or "", add_special_tokens=False)
        assert e.ids(text or "").tolist() == want.ids
        starts, ends = e.spans(text or "")
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


def slow_language(text, dictionaries):
    data = language.plain(text)
    sizes = []
    for lang, content in sorted(dictionaries.items()):
        short = len(data) < language.SHORT
        params = zstandard.ZstdCompressionParameters.from_level(language.SHORT_LEVEL if short else language.LEVEL, dict_size=len(content), source_size=language.BLOCK, write_content_size=0, **({"min_match": 3} if short else {}))
        total = 0
        for i in range(0, len(data), language.BLOCK):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(data[i : i + language.BLOCK]))
        sizes.append((total, lang))
    return min(sizes)[1]


def test_op8_by_a_compressor_for_each_text(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dictionaries = language.fit(docs.filter(~(language.fold("doc_id", 4) == 2)))
    got = {r["doc_id"]: r for r in op8.op8_language_id(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for doc_id, (text, _) in texts.items():
        assert got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert got[doc_id]["lang_pred"] == (slow_language(text, dictionaries) if any(map(str.isalpha, text)) else "und")


def test_op8_on_held_out_documents(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    truth = {r["doc_id"]: r["lang"] for r in rows}
    held = [r for r in op8.op8_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and truth[r["doc_id"]]]
    assert len(held) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_op10_base_of_all_documents(spark, texts):
    def words(text):
        return [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w] + [b""]

    held_out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d, (t, _) in texts.items() if not held_out[d] for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    rows = op10.op10_lm_scoring(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        mine = words(texts[r["doc_id"]][0])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out[r["doc_id"]], len(mine), sum(counts[w] > 0 for w in mine), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in mine), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.fixture(scope="module")
def model():
    v = lm.Vocabulary([b"", b"a", b"b", b"c"], np.array([5, 9, 7, 2]), 30, 9, np.ones((lm.TAILS, 2))).ready()
    m = lm.Model.start(v)
    m.flat += np.random.default_rng(3).normal(0, 0.2, len(m.flat)).astype(np.float32)
    return m


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def slow_score(m, symbols):
    """One document, one step at a time, in doubles."""
    p, n = {k: v.astype(np.float64) for k, v in m.p.items()}, lm.HIDDEN
    h, before, total = np.zeros(n), 0, 0.0
    for symbol in symbols:
        x, g = p["embed"][before] @ p["into"] + p["bias"], h @ p["around"]
        r, z = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = (1 - z) * new + z * h
        classes = h @ p["class_w"] + p["class_b"]
        of = symbol // lm.CLASS if symbol < lm.VOCABULARY else symbol - lm.VOCABULARY + lm.VOCABULARY // lm.CLASS
        total += classes[of] - np.log(np.exp(classes).sum())
        if symbol < lm.VOCABULARY:
            part = slice(of * lm.CLASS, (of + 1) * lm.CLASS)
            within = p["word_w"][part] @ h + p["word_b"][part]
            total += within[symbol % lm.CLASS] - np.log(np.exp(within).sum())
        before = symbol
    return total


def test_op10_scores_step_by_step(model):
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(0, lm.VOCABULARY + lm.TAILS, n), 0).astype(np.int16) for n in (0, 1, 5, 15, 16, 17, 70, 200)]
    assert np.allclose(lm.run(model, docs), [slow_score(model, d) for d in docs], rtol=1e-4)


def test_op10_gradient_by_differences(model):
    rng = np.random.default_rng(1)
    steps, lanes = 5, 6
    sym, target = (rng.integers(0, lm.VOCABULARY + lm.TAILS, (steps, lanes)) for _ in range(2))
    keep, learn = (rng.random((steps, lanes)) < 0.8).astype(np.float32), (rng.random((steps, lanes)) < 0.9).astype(np.float32)
    h = rng.normal(0, 0.3, (lanes, lm.HIDDEN)).astype(np.float32)
    grad = model.window(sym, target, keep, h, learn)[2]

    def loss(flat):
        logp = lm.Model(flat).window(sym, target, keep, h, None)[0]
        return -(logp * learn).sum() / learn.sum()

    names, at = {}, 0
    for name, shape in lm.Model.shapes.items():
        names[name] = np.arange(at, at + int(np.prod(shape)))
        at += int(np.prod(shape))
    for name, where in names.items():
        for i in where[np.argsort(-np.abs(grad[where]))[:4]]:
            up, down = model.flat.astype(np.float64), model.flat.astype(np.float64)
            up[i] += 1e-4
            down[i] -= 1e-4
            assert math.isclose(grad[i], (loss(up) - loss(down)) / 2e-4, rel_tol=0.03, abs_tol=2e-5), name


def test_op10_does_not_depend_on_files(spark, monkeypatch):
    monkeypatch.setattr(lm, "FOLD_TOKENS", 10_000)  # several folds of the smallest table
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    scores = [{r["doc_id"]: r["score"] for r in lm.score(df, df).collect()} for df in (docs.repartition(3), docs.orderBy("text").coalesce(1))]
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(v, scores[1][k], rel_tol=1e-5) for k, v in scores[0].items())
