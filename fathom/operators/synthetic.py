"""Synthetic tables and result files for measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the vocabulary and of a document, dimensions and density of vectors.
VOCABULARY, WORDS, DIMENSIONS, DENSITY = 500, 20, 256, 0.1
#: Columns of a result file, in order.
RESULT_COLUMNS = ("modality", "engine", "size", "build_s", "avg_query_ms", "disk_reads", "disk_writes", "throughput_qps", "recall_at_k", "overlap_at_k", "rss_mb", "pg_index_mb")


def _uniform(seed: int, *of: Column) -> Column:
    """A number from 0 to 1 that depends on its arguments alone, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / float(1 << 30)


def documents(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, text): words by a Zipf law, word i as often as 1 / (i + 1) says."""
    total, bounds = sum(1 / (i + 1) for i in range(VOCABULARY)), [0.0]
    for i in range(VOCABULARY):
        bounds.append(bounds[-1] + 1 / (i + 1) / total)
    ends = F.array(*[F.lit(b) for b in bounds[1:-1]])

    def word(i: Column) -> Column:
        u = _uniform(seed, F.col("id"), i)
        return F.concat(F.lit("word"), F.lpad(F.size(F.filter(ends, lambda e: e <= u)).cast("string"), 3, "0"))

    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word), " ").alias("text"))


def vectors(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(vec_id, vec): sparse and of unit length; one without any positive part stays zero."""

    def part(i: Column) -> Column:
        return F.when(_uniform(seed, F.col("id"), i) < DENSITY, _uniform(seed + 1, F.col("id"), i)).otherwise(0.0)

    raw = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), part).alias("raw"))
    raw = raw.withColumn("length", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x)))
    return raw.select(F.col("id").alias("vec_id"), F.transform("raw", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(x)).alias("vec"))


def queries(docs: DataFrame, n: int, seed: int = 42, words: int = 2, longest_first: int = 4) -> DataFrame:
    """(query): n documents drawn by a hash, and of each so many of its words of four letters or more (any, if it has none)."""
    drawn = docs.withColumn("u", F.xxhash64(F.lit(seed), "doc_id")).orderBy("u", "doc_id").limit(n)
    split = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    long = F.filter(split, lambda w: F.length(w) >= longest_first)
    picked = F.slice(F.array_sort(F.transform(F.when(F.size(long) > 0, long).otherwise(split), lambda w, i: F.struct(F.xxhash64(F.lit(seed), F.col("doc_id"), i).alias("u"), w.alias("w")))), 1, words)
    return drawn.select(F.array_join(F.transform(picked, lambda x: x["w"]), " ").alias("query"))


def resampled(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """rows, and as many drawn from them with replacement as make n, with `nth`, from 0; all of them if n is less.

    rows need a column key; draws are equi-joins on its rank, so no row is sent to all tasks.
    """
    from ..sources.loaders import numbered

    ranked = numbered(rows, "key").withColumn("nth", F.col("id") - 1).drop("id")
    have = ranked.count()
    if not have:
        raise ValueError("no rows to draw from")
    extra = rows.sparkSession.range(have, max(n, have)).select(F.col("id").alias("_nth"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(have)).alias("nth"))
    return ranked.unionByName(extra.join(ranked, "nth").drop("nth").withColumnRenamed("_nth", "nth"))


def write_results(spark: SparkSession, rows: list[dict], folder: str) -> None:
    """Measurements as one CSV file, RESULT_COLUMNS in order, missing values empty."""
    data = [tuple(None if r.get(c) is None else str(r[c]) for c in RESULT_COLUMNS) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in RESULT_COLUMNS))
    df.coalesce(1).write.mode("overwrite").csv(folder, header=True)
