"""Language identification by compression.

Each language has a zstandard raw-content dictionary of text in that language.  A
text is encoded with each; the language whose dictionary makes it smallest wins,
and the margin over the second tells how sure that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh

#: The bound of the labelled sample: rows for each language, characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 128, 4096
DICT_BYTES = 96 << 10
PARTS = 64
#: Texts are encoded in blocks, so that every part of a long text is held against
#: the dictionaries rather than against what came before it.
BLOCK = 4096
LEVEL = 6
#: Shorter texts are encoded with more effort and matches from three bytes on.
SHORT, SHORT_LEVEL = 256, 12
#: A smaller margin is a rejection.
LEAST_MARGIN = 0.002

_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower case, white space and ASCII that is no letter as single spaces."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from labelled(text, lang), null labels and texts left out.

    The sample is bounded by SAMPLE_ROWS and SAMPLE_CHARS for each language and is
    the same on every run: the rows whose text's hash is least.
    """
    rows = columns(labelled, text="string", lang="string").dropna()
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Hashes alone are ranked; texts come once each language's last of them is known.
    # Ranks within parts of a language come first, so that no task gathers it all.
    ranked = rows.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= SAMPLE_ROWS)
    last = {row["lang"]: row["last"] for row in ranked.groupBy("lang").agg(F.max("h").alias("last")).collect()}
    if not last:
        return {}
    bound = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])[F.col("lang")]
    sample = rows.filter(F.col("h") <= bound).select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct().collect()
    texts: dict[str, list[bytes]] = {}
    for row in sorted(sample):
        texts.setdefault(row["lang"], []).append(plain(row["text"]))
    return {lang: b" ".join(found)[:DICT_BYTES] for lang, found in texts.items()}


def classifier(dictionaries: dict[str, bytes]):
    """text -> (language or 'und', margin from 0 to 1)."""

    def encoder(lang: str, level: int, **more: int) -> tuple[str, zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(dictionaries[lang]), source_size=BLOCK, write_content_size=0, **more)
        held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return lang, zstandard.ZstdCompressor(dict_data=held, compression_params=params)

    usual = [encoder(lang, LEVEL) for lang in sorted(dictionaries)]
    close = [encoder(lang, SHORT_LEVEL, min_match=3) for lang in sorted(dictionaries)]

    def classify(text: str | None) -> tuple[str, float]:
        if not usual or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = plain(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(e.compress(b)) for b in blocks), lang) for lang, e in (close if len(data) < SHORT else usual))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]

    return classify


FOUND = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = (), names: tuple[str, ...] = FOUND) -> DataFrame:
    """docs(doc_id, text) with lang_pred, score and rejected, and the columns of keep.

    names: what the three are called, where keep has columns of those names.

    A null text, or one without a letter, is `und` with score 0 and is rejected; so
    is a text whose margin is below LEAST_MARGIN, though its best language is still
    named.  Without dictionaries all are `und`.  Ties go to the first name.  Whole
    texts are encoded; repeated rows and null ids are passed through.
    """
    if missing := [c for c in ("doc_id", "text") if c not in docs.columns]:
        docs = docs.withColumns({c: F.lit(None).cast("long" if c == "doc_id" else "string") for c in missing})
    docs = docs.select(*[docs[f"`{c}`"] for c in dict.fromkeys(("doc_id", "text", *keep))])
    kept = [c for c in docs.columns if c != "text" or c in keep]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(dictionaries)
        for b in batches:
            found = [classify(t.as_py()) for t in b.column("text")]
            out = {n: b.column(n) for n in kept}
            out |= {names[0]: pa.array([x for x, _ in found], pa.string()), names[1]: pa.array([y for _, y in found], pa.float64())}
            out[names[2]] = pa.array([x == "und" or y < LEAST_MARGIN for x, y in found], pa.bool_())
            yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(each, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that identify doesn't reject; labels are docs.lang."""
    names = tuple(fresh(docs, *FOUND))
    found = identify(docs, fit(docs), tuple(docs.columns), names)
    return found.filter(~found[names[2]]).select(*[found[f"`{c}`"] for c in docs.columns])


def fold(doc_id: Column | str, of: int) -> Column:
    """CRC-32 of the id as text, modulo `of`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(of))
