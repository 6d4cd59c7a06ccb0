"""Retrieval quality: recall and overlap of ranked sets."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sets(found: DataFrame, truth: DataFrame) -> DataFrame:
    a = found.groupBy("query_id").agg(F.collect_set("key").alias("f"))
    b = truth.groupBy("query_id").agg(F.collect_set("key").alias("t"))
    none = F.array().cast(a.schema["f"].dataType)
    return a.join(b, "query_id", "full_outer").select(F.coalesce("f", none).alias("f"), F.coalesce("t", none).alias("t"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): mean share of each query's true keys that were found, to three digits.

    found, truth: (query_id, key), at most k rows a query.
    """
    share = F.size(F.array_intersect("f", "t")) / F.greatest(F.size("t"), F.lit(1))
    return _sets(found, truth).agg(F.round(F.coalesce(F.avg(share), F.lit(0.0)), 3).alias("recall"))


def jaccard(found: DataFrame, other: DataFrame) -> DataFrame:
    """(overlap): mean of shared over all keys of each query, to three digits; two empty sets agree."""
    union = F.size(F.array_union("f", "t"))
    share = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("f", "t")) / union)
    return _sets(found, other).agg(F.round(F.coalesce(F.avg(share), F.lit(0.0)), 3).alias("overlap"))


#: A way to search: from queries (query_id and what is asked) to (query_id, key), k rows a query at most.
Search = Callable[[DataFrame], DataFrame]


def compare(queries: DataFrame, searches: dict[str, Search], truth: str) -> list[dict[str, object]]:
    """Each search over the same queries: seconds, queries a second, recall and overlap against the one named truth.

    A search is run once, as one job or more; what it finds is held for the comparison.
    """
    n, found, out = queries.count(), {}, []
    for name, search in searches.items():
        began = time.perf_counter()
        found[name] = search(queries).select("query_id", "key").persist()
        found[name].count()
        out.append({"engine": name, "queries": n, "seconds": round(time.perf_counter() - began, 3)})
    for row in out:
        mine, true = found[row["engine"]], found[truth]
        row["per_second"] = round(n / max(row["seconds"], 1e-3), 3)
        row["recall"], row["overlap"] = recall(mine, true).first()[0], jaccard(mine, true).first()[0]
    for df in found.values():
        df.unpersist()
    return out
