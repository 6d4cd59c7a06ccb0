"""Conjunctive full-text search, ranked by how near the terms stand to each other.

Postings have positions.  A document matches if it has all terms; its covers, the
shortest stretches that have all of them, give its rank (cover density, Clarke and
others, 2000): each cover of n terms in m words counts n / m.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Counted, spread, words_of


#: Postings that a task sends on at once.
HELD = 20_000


def positions(df: DataFrame, key: str, text: str, analyzer: str = "rule") -> DataFrame:
    """(term, doc_id, positions) of df(key, text): where a document has a term, counted by all of its words from 0."""
    count = Counted(analyzer)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A text at a time, sent on in batches of some size.
            rows: list[tuple[str, str, list[int]]] = []
            for n, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True), 1):
                found: dict[str, list[int]] = {}
                for i, word in enumerate(words_of(text.as_py())):
                    if term := count.of(word):
                        found.setdefault(term, []).append(i)
                rows += [(t, doc_id, at) for t, at in found.items()]
                if len(rows) >= HELD or n == b.num_rows:
                    columns = zip(*rows, strict=True) if rows else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.list_(pa.int32())), strict=True)], ["term", "doc_id", "positions"])
                    rows = []

    named = spread(df).select(F.col(key).cast("string").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return named.mapInArrow(each, "term string, doc_id string, positions array<int>")


def match_all(postings: DataFrame, query: str, k: int | None = None, analyzer: str = "rule", digits: int | None = None) -> DataFrame:
    """(doc_id, score) of the documents that have all terms of the query, by cover density; the k best, ties by id.

    A query without terms finds nothing.
    """
    asked = sorted(Counted(analyzer)(query))
    if not asked:
        return postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    # A row a term of the query and document; documents without all of them go before positions are spread.
    mine = postings.filter(F.col("term").isin(asked)).groupBy("doc_id").agg(F.collect_list(F.struct("term", "positions")).alias("p")).filter(F.size("p") == len(asked))
    each = mine.select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.term", "p.positions")
    events = each.select("doc_id", "term", F.explode("positions").alias("at"))
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == t, F.col("at"))).over(so_far) for t in asked]
    begun = reduce(lambda a, b: a & b, [x.isNotNull() for x in last])
    starts = events.select("doc_id", "at", F.when(begun, F.least(*last) if len(last) > 1 else last[0]).alias("start")).filter("start is not null")
    covers = starts.groupBy("doc_id", "start").agg(F.min("at").alias("end"))
    score = F.sum(F.lit(float(len(asked))) / (F.col("end") - F.col("start") + 1))
    out = covers.groupBy("doc_id").agg((score if digits is None else F.round(score, digits)).alias("score")).orderBy(F.desc("score"), "doc_id")
    return out if k is None else out.limit(k)
