"""How the sources of a language differ in their words.

Words are counted once, in the tasks that read the texts.  For a pair of sources the
sum over all words of ``|p - q|`` needs no word: it follows from how many words have
which two counts.  Such a joint histogram is tallied from words that both sources
have; cells with a zero follow from each source's own histogram, less what is tallied
already, and the cell of two zeros from the number of words.  The difference is then
worked out once for each cell and multiplied by its tally.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, saved

#: A kept word is in so many documents of its language; counts are smoothed by SMOOTH; shares are of ONE.
LEAST_DOCS, SMOOTH, ONE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a text that are cut into words at a time, and counted words that a task holds.
PIECE, HELD = 1 << 20, 400_000
#: Pairs of counts that a task holds before it tallies them.
PAIRS = 1 << 20

# All that is neither an ASCII letter nor beyond ASCII parts words; capitals A-Z are lowered.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ENDS = frozenset(range(128)) - frozenset(range(65, 91)) - frozenset(range(97, 123))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, a piece at a time; no word is cut."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in _ENDS:
            end += 1
        yield text[at:end].translate(_BYTES).split()
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of docs(text, lang, source), written down; null counts as ''.

    A task adds up what it reads and hands on its sums whenever it holds HELD words.
    """
    rows = columns(docs, text="string", lang="string", source="string")
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, docs_) in held.items():
                n, keys = len(count), list(count)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(count.values(), pa.int64()), pa.array([docs_[k] for k in keys], pa.int64())], ["lang", "source", "term", "count", "docs"])

        for b in batches:
            langs, sources, texts = (b.column(c) for c in ("lang", "source", "text"))
            for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts, strict=True):
                count, docs_ = held[lang, source]
                known, mine = len(count), set()
                for some in words(text.as_py()):
                    count.update(some)
                    mine.update(some)
                docs_.update(mine)
                size += len(count) - known
                if size >= HELD:
                    yield from sums()
                    held.clear()
                    size = 0
        yield from sums()

    found = rows.mapInArrow(each, "lang string, source string, term string, count long, docs long")
    # Sums of a task hold each word once, so adding them up again before the shuffle would only cost.
    found = found.repartition("lang", "term")
    return saved(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "words")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE x (count + SMOOTH) / (total + SMOOTH x kept)), in whole numbers of any size that occurs."""
    up = (count.cast("decimal(20,0)") + F.lit(SMOOTH).cast("decimal(2,0)")) * F.lit(ONE).cast("decimal(10,0)")
    down = total.cast("decimal(24,0)") + kept.cast("decimal(20,0)") * F.lit(SMOOTH).cast("decimal(2,0)")
    return F.when(kept > 0, F.call_function("div", up, down) + 1)


def counted_cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of rows of whole numbers from 0 on, and how often each occurs."""
    spans = [int(r.max(initial=0)) + 1 for r in rows]
    if math.prod(spans) < 1 << 62:
        key = np.zeros(rows.shape[1], np.int64)
        for r, span in zip(rows, spans, strict=True):
            key = key * span + r
        key, n = np.unique(key, return_counts=True)
        cells = []
        for span in reversed(spans):
            key, last = np.divmod(key, span)
            cells.append(last)
        return np.stack(cells[::-1]), n
    return np.unique(rows, axis=1, return_counts=True)


def _tallied(terms: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, n): for sources a < b, by number, how many words occur x > 0 times in a and y > 0 times in b.

    terms: (lang, ids, counts), a row a word, ids in order.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        size = 0

        def tally() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                cells, n = counted_cells(np.concatenate(parts, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(c, pa.int64()) for c in cells), pa.array(n, pa.int64())], ["lang", "a", "b", "x", "y", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            ids, counts = (batch.column(c) for c in ("ids", "counts"))
            sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            flat_ids, flat_counts = (c.flatten().to_numpy() for c in (ids, counts))
            starts = np.cumsum(sizes) - sizes
            for m in np.unique(sizes[sizes > 1]).tolist():
                i, j = np.triu_indices(m, 1)
                rows = max(1, PAIRS // len(i))
                for lang in dict.fromkeys(langs[sizes == m]):
                    mine = np.flatnonzero((sizes == m) & (langs == lang))
                    for a in range(0, len(mine), rows):
                        at = starts[mine[a : a + rows], None] + np.arange(m)
                        those, many = flat_ids[at], flat_counts[at]
                        held[lang].append(np.stack([x.ravel() for x in (those[:, i], those[:, j], many[:, i], many[:, j])]))
                        size += held[lang][-1].shape[1]
                        if size >= PAIRS:
                            yield from tally()
                            held.clear()
                            size = 0
        yield from tally()

    found = terms.mapInArrow(each, "lang string, a long, b long, x long, y long, n long")
    return found.groupBy("lang", "a", "b", "x", "y").agg(F.sum("n").alias("n"))


def divergence(docs: DataFrame) -> DataFrame:
    """How each source of a language differs from the others, and in which words from the language.

    docs: (text, lang, source).  Result: lang, source, part, item, value, rank.  Part
    ``pair``: item is another source of the language, value the sum over all kept words
    of the difference of shares.  Part ``term``: item is a kept word that the source
    has and that has a larger share there than in the language, value how much larger,
    the TOP of them.  Ranks are from 1, by value, then item.

    Null text, lang and source are ''.  Each row is a document, repeated ones too.  A
    source whose documents have no word counts none.  A language without kept words
    has pairs of value 0.  Texts may be of any length; an empty table gives no rows.
    """
    counted = word_counts(docs)
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).filter(F.col("docs") >= LEAST_DOCS)
    kept = saved(kept.select("lang", "term", "all"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    seen = saved(counted.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "seen")
    totals = seen.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("distinct"))
    every = columns(docs, lang="string", source="string").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = {c: 0 for c in ("total", "distinct", "v", "lang_total")}
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("id")
    groups = saved(groups.na.fill(zero).select("*", numbered), "groups")
    return _pairs(seen, groups).unionByName(_terms(seen, groups))


def _pairs(seen: DataFrame, groups: DataFrame) -> DataFrame:
    ids = groups.select("lang", "source", "id")
    had = seen.join(ids, ["lang", "source"]).select("lang", "term", "id", "count")
    terms = had.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("id", "count"))).alias("s"))
    joint = saved(_tallied(terms.select("lang", F.col("s.id").alias("ids"), F.col("s.count").alias("counts"))), "joint")
    own = saved(had.groupBy("lang", "id", "count").agg(F.count("*").alias("n")), "own")

    # Cells of a zero: a source's own histogram against each other source, less the words that are in `joint`.
    a, b = (ids.select("lang", F.col("id").alias(x)) for x in "ab")
    nothing = F.lit(0).cast("long")
    mine = own.select("lang", F.col("id").alias("a"), F.col("count").alias("x"), "n").join(b, "lang").filter("a < b").select("lang", "a", "b", "x", nothing.alias("y"), "n")
    theirs = own.select("lang", F.col("id").alias("b"), F.col("count").alias("y"), "n").join(a, "lang").filter("a < b").select("lang", "a", "b", nothing.alias("x"), "y", "n")
    left, right = (groups.select("lang", F.col("id").alias(x), F.col("total").alias(f"total_{x}"), F.col("distinct").alias(f"distinct_{x}"), F.col("source").alias(f"source_{x}"), *extra) for x, extra in (("a", ["v"]), ("b", [])))
    pairs = saved(left.join(right, "lang").filter("a < b"), "pairs")
    neither = pairs.select("lang", "a", "b", nothing.alias("x"), nothing.alias("y"), (F.col("v") - F.col("distinct_a") - F.col("distinct_b")).alias("n"))
    minus = F.explode(F.array(F.struct("x", "y", "n"), F.struct("x", nothing.alias("y"), (-F.col("n")).alias("n")), F.struct(nothing.alias("x"), "y", (-F.col("n")).alias("n")), F.struct(nothing.alias("x"), nothing.alias("y"), "n")))
    tallied = joint.select("lang", "a", "b", minus.alias("c")).select("lang", "a", "b", "c.x", "c.y", "c.n")
    cells = tallied.unionByName(mine).unionByName(theirs).unionByName(neither).groupBy("lang", "a", "b", "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0")

    each = cells.join(pairs.select("lang", "a", "b", "v", "total_a", "total_b"), ["lang", "a", "b"])
    differ = F.abs(share(F.col("x"), F.col("total_a"), F.col("v")) - share(F.col("y"), F.col("total_b"), F.col("v")))
    values = each.groupBy("lang", "a", "b").agg(F.sum(differ * F.col("n")).alias("value"))
    found = pairs.join(values, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", nothing))
    both = found.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("e"), "value").select("lang", "e.source", "e.item", "value")
    return _ranked(both, "pair")


def _terms(seen: DataFrame, groups: DataFrame) -> DataFrame:
    rows = seen.join(groups.drop("id", "distinct"), ["lang", "source"])
    p, q = share(F.col("count"), F.col("total"), F.col("v")), share(F.col("all"), F.col("lang_total"), F.col("v"))
    rows = rows.withColumn("p", p).withColumn("q", q).filter("p > q")
    return _ranked(rows.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term", TOP)


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return out if most is None else out.filter(F.col("rank") <= most)
