import random
import time
import zlib

import numpy as np
import pytest

from fathom.llm import language, licenses, lm, op9, pii, tokens

from .conftest import ROWS


def test_pii_on_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in pii.report(pii.find_pii(odd)).collect()}
    assert rows[9]["spans"] == "email:5:14,ip:40:48,card:54:73,phone:18:35" and rows[9]["n_card"] == 1
    assert rows[4]["spans"] == rows[3]["spans"] == rows[7]["spans"] == ""
    assert pii.find_pii(none).count() == 0


@pytest.mark.parametrize("text, spans", [
    ("a@b.c_d@e.f", "email:0:5,email:5:11"), ("1.2.3.256 1.2.3.4.5", "ip:10:17"), ("é 001.002.003.004", "ip:2:17"), ("4111-1111-1111-1112", ""),
    ("iban DE89 3704 0044 0532 0130 00.", "iban:5:32"), ("DE89370400440532013001", ""), ("SSN 123-45-6789", "ssn:4:15"), ("no 123-45-6789", ""), ("x\x01y a@b.cd", "email:4:10"),
])
def test_pii_spans(spark, text, spans):
    assert pii.report(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()["spans"] == spans
    assert "base_sha256" in op9.SQL


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [r["spans"] for r in pii.find_pii(df).orderBy("doc_id").collect()]


def test_pii_of_long_runs(spark):
    assert list(map(len, spans_of(spark, ["a" * 300_000, "9" * 300_000, "+1" + "-" * 100_000, "1." * 50_000]))) == [0, 0, 0, 12_500]


def test_pii_takes_time_as_texts_do(spark):
    """50,000 spans in one text: all of them, their places right, in time that grows as the text does."""
    unit = "é 1.2.3.4 a@b.co call +1 (555) 123-4567 DE89370400440532013000 x "
    took = {}
    for n in (100, 6_250, 12_500):
        began = time.perf_counter()
        (found,) = spans_of(spark, [unit * n])
        took[n] = time.perf_counter() - began
        each = [("email", 10, 16), ("ip", 2, 9), ("phone", 22, 39)]
        want = [(k, i * len(unit) + s, i * len(unit) + e) for k, s, e in each for i in range(n)]
        assert [(x["kind"], x["s"], x["e"]) for x in found if x["base"]] == want
        assert len(found) == 4 * n - 0 and found[-1]["kind"] == "iban"
    assert took[12_500] < 2.6 * took[6_250] + 2 and took[12_500] < 60


def sentences(syllables, n, seed):
    r = random.Random(seed)
    return [" ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(8, 60))) for _ in range(n)]


def test_language_of_held_out_texts(spark, odd, none):
    kinds = {"xx": ["the", "ing", "and", "sh"], "yy": ["que", "eau", "ch", "ier"], "zz": ["ung", "der", "zu", "ein"]}
    train = [(t, k) for i, (k, s) in enumerate(kinds.items()) for t in sentences(s, 60, i)] + [(None, "xx"), ("abc", None)]
    dictionaries = language.fit(spark.createDataFrame(train, "text string, lang string"))
    assert sorted(dictionaries) == ["xx", "yy", "zz"]
    test = [(i, t, k) for n, (k, s) in enumerate(kinds.items()) for i, t in enumerate(sentences(s, 40, 50 + n))]
    found = language.identify(spark.createDataFrame(test, "doc_id long, text string, truth string"), dictionaries, keep=("truth",)).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in found) / len(found) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    rows = language.identify(odd, dictionaries).collect()
    assert len(rows) == len(ROWS) and {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert language.identify(none, dictionaries).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(none)).collect()} == {"und"}


def test_tokens_as_the_tokenizer_gives_them():
    e, r = tokens.Encoder(), random.Random(1)
    alphabet = "ab Cd1 2.\n\t'll éñß“…€漢🙂 <|endoftext|>"
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        want = e.whole.encode(text, add_special_tokens=False)
        assert e.ids(text).tolist() == want.ids
        starts, ends = e.spans(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


def test_tokens_by_section(odd, none, spark):
    rows = tokens.section_tokens(odd).collect()
    e = tokens.Encoder()
    for doc_id, text, *_ in ROWS:
        mine = [r for r in rows if r["doc_id"] == doc_id]
        assert sum(r["tokens"] for r in mine) == len(e.ids(text or "")) * (2 if doc_id == 8 else 1)
    assert tokens.section_tokens(none).count() == 0
    # "hello" is one token: three of its letters are the first field's, then two of four go to the earlier.
    fields = spark.createDataFrame([(1, "hel", "lo"), (2, "wo", "rd")], "doc_id long, a string, b string")
    got = {(r["doc_id"], r["section"]): (r["tokens"], r["crossing"]) for r in tokens.section_tokens(fields, fields=("a", "b")).collect()}
    whole = len(e.ids("hello"))
    assert got[1, 0][0] + got[1, 1][0] == whole and got[2, 0] == (1, 1) and got[2, 1] == (0, 0)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_is_a_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b)


def test_lengths_of_common_subsequences():
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(1, 40))] for _ in range(2))
        assert licenses.common_length(a, licenses.Template("t", b, 0.5).masks, len(b)) == longest_common(a, b)


@pytest.mark.parametrize("seed", range(6))
def test_scan_against_all_windows(seed):
    """What is found covers enough of the template, and no window is left that is an exact or nearly exact copy."""
    r = random.Random(seed)
    template = [r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou") for _ in range(30)]
    words, copies = [], 0
    for _ in range(12):
        words += [r.choice(template) if r.random() < 0.4 else "yy" for _ in range(r.randint(0, 90))]
        if r.random() < 0.6:
            copy = template.copy()
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(30)] = "zz"
            words, copies = words + copy, copies + 1
    scanner = licenses.Scanner({"t": " ".join(template)}, 0.85)
    t = scanner.templates[0]
    found = scanner.scan(" ".join(words))
    assert len(found) >= copies
    covered = [False] * len(words)
    for _, coverage, first, last in found:
        assert longest_common(words[first : last + 1], template) / 30 >= coverage >= 0.85 and last - first < t.span
        assert not any(covered[first : last + 1])
        covered[first : last + 1] = [True] * (last + 1 - first)
    for i in range(len(words) - 29):  # brute force: a free window of the template's length holds no copy
        assert any(covered[i : i + 30]) or longest_common(words[i : i + 30], template) < 28


def test_shuffled_words_of_licenses_stay_cheap():
    r, words = random.Random(5), licenses.words_of(licenses.TEMPLATES["MIT"])
    text = " ".join(r.choice(words) for _ in range(40_000))
    began = time.process_time()
    assert licenses.Scanner({"MIT": licenses.TEMPLATES["MIT"]}, 0.85).scan(text) == []
    assert time.process_time() - began < 10


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_where_it_stands(name):
    assert len(licenses.TEMPLATES) >= 30
    found = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST_COVERAGE).scan(f"some words before. {licenses.TEMPLATES[name]}\nand after " * 3)
    assert [x[1] for x in found if x[0] == name] == [1.0] * 3


def test_licenses(odd, none, spark):
    mit = licenses.TEMPLATES["MIT"]
    cut = " ".join(mit.split()[:40] + ["changed", "words"] + mit.split()[45:])
    docs = [(1, f"prose before. {mit} prose after"), (2, cut), (3, "Released under the MIT License. x Released under the MIT License."), (4, "the of and to " * 300), (5, "RELEASED!! UNDER!! THE!! MIT!! LICENSE!!")]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1]["license"] == "MIT" and rows[1]["coverage"] == 1 and docs[0][1][rows[1]["start"] :].startswith("Permission")
    assert rows[2]["license"] == "MIT" and 0.85 <= rows[2]["coverage"] < 1
    assert rows[3]["n_licenses"] == 2 and rows[5]["license"] == "MIT-notice" and rows[4]["n_licenses"] == 0
    assert licenses.scan_licenses(odd).filter("n_licenses > 0").count() == 0 and licenses.scan_licenses(none).count() == 0


def test_lm_base_and_model(spark, odd, none):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice((["the", "of", "sea"], ["der", "und", "meer"])[i % 2]) for _ in range(r.randint(5, 60)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lm.score(df, df.filter(~lm.held_out())).collect()
    held = [x for x in rows if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 1]
    assert held and sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    train = [t.split() for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    n, v = sum(map(len, train)) + len(train), 7
    one = next(x for x in rows if x["doc_id"] == docs[0][0])
    words = docs[0][1].split()
    counts = [sum(t.count(w) for t in train) for w in words] + [len(train)]
    assert one["train_tokens"] == n and one["n_known"] == one["n_tokens"] == len(words) + 1
    assert np.isclose(one["base_score"], sum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts))
    assert lm.score(odd, odd).count() == len(ROWS) and lm.score(none, odd).count() == 0
    assert np.allclose([x["base_score"] for x in lm.score(odd, none).collect()], 0)


def test_lm_is_a_distribution():
    v = lm.Vocabulary([b"", b"a", b"b"], np.array([2, 3, 4]), 9, 3, np.ones((lm.TAILS, 2))).ready()
    m = lm.Model.start(v)
    kinds = lm.VOCABULARY + lm.TAILS
    sym, target = np.zeros((1, kinds), np.int64), np.arange(kinds)[None]
    logp = m.window(sym, target, np.ones((1, kinds), np.float32), np.zeros((kinds, lm.HIDDEN), np.float32), None)[0]
    assert np.isclose(np.exp(logp).sum(), 1, atol=1e-4)
