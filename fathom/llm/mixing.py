"""Mixing sources to target weights by Pfair scheduling.

A round has a slot for each unit of weight.  In it block j of a source of weight w
is released at slot floor((j - 1) * D / w) and due by ceil(j * D / w), where D is the
round's slots; earliest deadline first then fills every slot, meets all deadlines
(Baruah and others, 1996), and keeps each source within less than one block of its
share at every point.  Rounds repeat, so one schedule serves all rounds in which the
same sources still have blocks, and documents find their place by arithmetic.

Only DataFrame and SQL functions: the schedule is an `aggregate` over the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, whole_rows

#: Rows of the schedules, which are broadcast: (2 x sources + 1) x weights in a round.
MOST_SCHEDULED = 1_000_000
#: Documents of a source that are ranked by one task, about.
BUCKET_ROWS = 20_000


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The plan of all rounds, from sources(source, w, n): weights and document counts.

    Rows: source, w, first and after (the rounds that they hold for), j (the block's
    place among its source's in the round), slot0 (its place in the first of these
    rounds), d (slots of a round) and missing (documents that partly filled blocks
    before it lack).
    """
    last = "cast(floor((ceil(n / {b}) - 1) / w) as long)".format(b=block)
    each = sources.select("source", "w", "n", F.expr(f"cast(ceil(n / {block}) as long)").alias("blocks"), F.expr(last).alias("last"))
    whole = each.agg(F.sort_array(F.collect_list(F.struct("source", "w", "n", "blocks", "last"))).alias("s"))
    cuts = whole.select("s", F.expr("array_sort(array_distinct(concat(array(0L), transform(s, x -> x.last), transform(s, x -> x.last + 1))))").alias("cuts"))
    spans = cuts.select("s", F.posexplode("cuts").alias("i", "first"), "cuts").filter("i + 1 < size(cuts)").select("s", "first", F.expr("cuts[i + 1]").alias("after"))
    # What each source still gives in a round: its weight, or what is left of it.
    spans = spans.withColumn("q", F.expr("transform(s, x -> cast(least(x.w, greatest(0L, x.blocks - first * x.w)) as int))"))
    spans = spans.withColumn("D", F.expr("aggregate(q, 0L, (a, x) -> a + x)"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("start", F.coalesce(F.sum(F.expr("(after - first) * D")).over(before), F.lit(0)))
    picked = spans.withColumn("picks", F.expr(_edf())).select("s", "first", "after", "q", "D", "start", F.posexplode("picks").alias("slot", "p"))
    rows = picked.select(F.expr("s[p.i].source").alias("source"), F.expr("s[p.i].w").alias("w"), "first", "after", F.expr("p.j").alias("j"), (F.col("start") + F.col("slot")).alias("slot0"), F.col("D").alias("d"), F.expr(f"if(first = s[p.i].last and p.j = q[p.i] - 1, s[p.i].blocks * {block} - s[p.i].n, 0L)").alias("lacks"))
    earlier = Window.orderBy("slot0").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("missing", F.coalesce(F.sum("lacks").over(earlier), F.lit(0))).drop("lacks")


def _edf() -> str:
    """Earliest deadline first over one round: an array of (source's index i, block j), by slot."""
    ready = "x -> x.j < q[x.i] and floor(x.j * D / greatest(q[x.i], 1)) <= t"
    jobs = "transform(a.done, (c, i) -> named_struct('due', cast(ceil((c + 1) * D / greatest(q[i], 1)) as long), 'i', i, 'j', c))"
    pick = f"array_min(filter({jobs}, {ready}))"
    # The pick is made once, as the last of `out`; the counts follow from it.
    out = f"concat(a.out, transform(array({pick}), p -> named_struct('i', p.i, 'j', p.j)))"
    step = f"transform(array({out}), o -> named_struct('done', transform(a.done, (c, i) -> c + if(i = o[size(o) - 1].i, 1, 0)), 'out', o))[0]"
    zero = "named_struct('done', transform(q, x -> 0), 'out', cast(array() as array<struct<i:int,j:int>>))"
    return f"aggregate(sequence(0L, D - 1), {zero}, (a, t) -> {step}, a -> a.out)"


def mixed(docs: DataFrame, weights: dict[str, int], default: int = 1, block: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """A place for each row of docs(doc_id, source), so that prefixes meet the weights.

    weights: whole numbers from 1 on; default: of sources not named.  Result: doc_id,
    source, block (within its source, from 0), position (from 0, gapless) and the
    columns of keep.  As a source runs out, the others share its slots by their
    weights.  Within a source the order is by MD5 of the id's text, then the id.

    A null source, or no such column, counts as the source ''.  Null ids come first.  Repeated rows take
    a place each.  An empty table gives no rows.  Nothing is dropped or repeated.
    """
    if default < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    w = F.lit(default)
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("source")], w)
    doc_id, source = (docs[c] if c in docs.columns else F.lit(None) for c in ("doc_id", "source"))
    base = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), *[docs[c].alias(f"_{i}") for i, c in enumerate(keep)])
    base = base.withColumn("md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    counts = saved(base.groupBy("source").agg(F.count("*").alias("n")).withColumn("w", w), "sources")
    k, round_, total = counts.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if (2 * k + 1) * round_ > MOST_SCHEDULED:
        raise ValueError(f"{k} sources of weight {round_} together need too long a schedule: use smaller weights or fewer sources")
    plan = saved(schedule(counts, block), "schedule")

    digits = 1
    while total > BUCKET_ROWS * 16**digits:
        digits += 1
    base = base.withColumn("bucket", F.substring("md5", 1, digits))
    cells = base.groupBy("source", "bucket").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("md5", "doc_id")
    ranked = base.withColumn("rank", F.row_number().over(within) - 1).join(saved(cells, "cells"), ["source", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).withColumn("block", F.floor(F.col("rank") / block))

    p = F.broadcast(plan.withColumnRenamed("source", "_source").withColumnRenamed("j", "_j"))
    turned = ranked.withColumn("w", w)
    turned = turned.withColumn("round", F.floor(F.col("block") / F.col("w"))).withColumn("j", (F.col("block") % F.col("w")).cast("int")).drop("w")
    found = turned.join(p, (F.col("source") == F.col("_source")) & (F.col("j") == F.col("_j")) & (F.col("round") >= F.col("first")) & (F.col("round") < F.col("after")))
    place: Column = (F.col("slot0") + (F.col("round") - F.col("first")) * F.col("d")) * block + F.col("rank") % block - F.col("missing")
    return found.select("doc_id", "source", "block", place.cast("long").alias("position"), *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)])


def in_mixed_order(docs: DataFrame, weights: dict[str, int], default: int = 1, block: int = 16) -> DataFrame:
    """The rows of docs, all and unchanged, in the order of `mixed`.

    Positions have no gaps, so ranges of them are dealt by arithmetic, without a
    sample; written as files, the order is that of their names and rows.
    """
    kinds = {"doc_id": "long", "source": "string"}
    held = docs.select(*[(docs[c] if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], whole_rows(docs).alias("row"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = -(-docs.count() // parts) or 1
    placed = mixed(held, weights, default, block, keep=("row",))
    dealt = placed.repartitionById(parts, F.floor(F.col("position") / each).cast("int")).sortWithinPartitions("position")
    return dealt.select("row.*")
