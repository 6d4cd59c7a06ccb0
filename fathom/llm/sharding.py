"""Shards as runs of a Hilbert curve over several metadata columns.

Each column is cut into 2^bits buckets of about as many rows, in its own order; the
buckets are coordinates of a cell, and the cell's place on the Hilbert curve orders
the rows.  Cells next to each other on the curve differ in one coordinate by one, so a
run of the curve, a shard or a file in it, covers a narrow range of every column, and
minimum and maximum statistics skip files for a condition on any of them.

Only DataFrame and SQL functions.  Rows are dealt by ranges of the order and counted
in their partitions; a row's place is the count of the partitions before its own and
its number there, so nothing is ranked by one task, and no cell is too large.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, whole_rows

#: Buckets of a dimension are 2^BITS; a string is known by so many bytes after what all values begin with.
BITS, CODE_BYTES = 4, 2
#: Numbers keep so many bits after their first, so a dimension has 65,536 codes at most, of either kind.
FINE = 8
SHARDS, DIMS = 8, ("lang", "source", "size")


def number_code(x: Column) -> Column:
    """A whole number from 0 on as text that sorts like it: its length in bits, then the FINE bits after the first."""
    length = F.length(F.bin(x)) - 1
    top = F.when(length >= FINE, F.call_function("shiftright", x, length - FINE)).otherwise(F.call_function("shiftleft", x, FINE - length))
    return F.when(x > 0, F.lpad((length * (1 << FINE) + top - (1 << FINE) + 1).cast("string"), 6, "0")).otherwise("0")


def string_code(x: Column, shared: int) -> Column:
    """The CODE_BYTES bytes after the first `shared` as hexadecimal digits, which sort like bytes."""
    return F.substring(F.hex(x.cast("binary")), 2 * shared + 1, 2 * CODE_BYTES)


def hilbert(cells: str, bits: int, dims: int) -> str:
    """SQL for the place on the curve of the array of coordinates `cells`, after Skilling (2004)."""
    steps = ", ".join(f"named_struct('q', {1 << k}, 'i', {i})" for k in range(bits - 1, 0, -1) for i in range(dims))
    turned = "transform(x, (v, k) -> if(k = 0, v ^ (s.q - 1), v))"
    swapped = "transform(x, (v, k) -> if(k = 0 or k = s.i, v ^ ((x[0] ^ x[s.i]) & (s.q - 1)), v))"
    undone = f"aggregate(array({steps}), transform({cells}, v -> cast(v as int)), (x, s) -> if((x[s.i] & s.q) <> 0, {turned}, {swapped}))" if bits > 1 else f"transform({cells}, v -> cast(v as int))"
    gray = f"transform(array({undone}), x -> transform(x, (v, k) -> aggregate(slice(x, 1, k + 1), 0, (a, b) -> a ^ b)))[0]"
    flips = f"aggregate(sequence(1, {bits - 1}), 0, (t, k) -> if((x[{dims - 1}] & shiftleft(1, k)) <> 0, t ^ (shiftleft(1, k) - 1), t))" if bits > 1 else "0"
    straight = f"transform(array({gray}), x -> transform(x, v -> v ^ {flips}))[0]"
    places = ", ".join(f"named_struct('k', {k}, 'i', {i})" for k in range(bits - 1, -1, -1) for i in range(dims))
    return f"transform(array({straight}), x -> aggregate(array({places}), 0L, (a, p) -> a * 2 + (shiftright(x[p.i], p.k) & 1)))[0]"


def sharded(docs: DataFrame, dims: tuple[str, ...] = DIMS, shards: int = SHARDS, bits: int = BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A shard for each row of docs(doc_id, text and the dims), of which counts differ by one at most.

    dims: columns of docs, strings or whole numbers from 0 on, and ``size``, the bytes
    of the text and one.  Result: doc_id, size, text_crc32, law (``rows``), shard, slot
    (from 0 in each shard), grown_shard (null: another number of shards cuts other
    runs), curve (place on the curve), cell (the buckets), and the columns of keep.

    Within a cell rows are ordered by the text's MD5, so equal texts stand together,
    then by doc_id, nulls first.  A null text has no bytes; a null, a missing column
    and a negative number come before all others.  Repeated rows have a place each,
    an empty table gives no rows; texts may be of any length.
    """
    if shards < 1 or not 1 <= bits * len(dims) <= 62:
        raise ValueError("shards from 1 on, and at most 62 bits for all dimensions")
    own = [d for d in dims if d != "size"]
    kinds = {d: "string" if d not in docs.columns or docs.schema[d].dataType.simpleString() == "string" else "long" for d in own}
    named = [(docs[d] if d in docs.columns else F.lit(None)).cast(k).alias(f"d_{d}") for d, k in kinds.items()]
    doc_id, text = ((docs[c] if c in docs.columns else F.lit(None)).cast(k) for c, k in zip(("doc_id", "text"), ("long", "string"), strict=True))
    whole = F.coalesce(text, F.lit("")).cast("binary")
    held = docs.select(doc_id.alias("doc_id"), (F.octet_length(whole) + F.lit(1).cast("long")).alias("size"), F.crc32(whole).alias("text_crc32"), F.md5(whole).alias("md5"), *named, *[docs[c].alias(f"k_{c}") for c in keep])
    held = saved(held, "facts")

    strings = [d for d in own if kinds[d] == "string"]
    ends = held.agg(F.count("*").alias("n"), *[f(f"d_{d}").alias(f"{n}_{d}") for d in strings for n, f in (("low", F.min), ("high", F.max))]).first()
    codes = []
    for d in dims:
        if d in strings:
            both = [(ends[f"{n}_{d}"] or "").encode() for n in ("low", "high")]
            codes.append(string_code(F.col(f"d_{d}"), len(os.path.commonprefix(both))))
        else:
            codes.append(number_code(F.col("size" if d == "size" else f"d_{d}")))
    coded = held.withColumn("codes", F.array(*[F.coalesce(c, F.lit("")) for c in codes]))
    buckets = saved(_buckets(coded.select(F.posexplode("codes").alias("dim", "code")), bits), "quantiles")
    for i in range(len(dims)):
        one = F.broadcast(buckets.filter(F.col("dim") == i).select(F.col("code").alias(f"c_{i}"), F.col("bucket").alias(f"b_{i}")))
        coded = coded.join(one, F.col("codes")[i] == F.col(f"c_{i}"))
    placed = coded.withColumn("cell", F.array(*[f"b_{i}" for i in range(len(dims))])).withColumn("curve", F.expr(hilbert("cell", bits, len(dims))))
    order = ["curve", "md5", "doc_id"]
    dealt = placed.select("doc_id", "size", "text_crc32", "md5", "curve", "cell", *[f"k_{c}" for c in keep]).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("seq", F.monotonically_increasing_id()), "curve")

    # A row a partition of the shuffle.
    each = dealt.groupBy(F.shiftright("seq", 33).alias("part")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("part", F.shiftright("seq", 33)).join(F.broadcast(saved(each.select("part", before.alias("before")), "offsets")), "part")
    n = F.lit(ends["n"] or 1).cast("long")
    place = F.col("before") + F.col("seq").bitwiseAND((1 << 33) - 1)
    shard = F.call_function("div", place * shards, n)
    start = F.call_function("div", shard * n + (shards - 1), F.lit(shards).cast("long"))
    out = numbered.withColumn("_place", place).withColumn("_shard", shard).withColumn("slot", F.col("_place") - start)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "cell", *[F.col(f"k_{c}").alias(c) for c in keep])


def _buckets(codes: DataFrame, bits: int) -> DataFrame:
    """(dim, code, bucket): buckets of about as many rows, a code in one; at most 65,536 codes a dimension."""
    counts = codes.groupBy("dim", "code").agg(F.count("*").alias("n"))
    of = Window.partitionBy("dim")
    before = F.coalesce(F.sum("n").over(of.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(20,0)")
    return counts.select("dim", "code", F.call_function("div", before * (1 << bits), F.sum("n").over(of)).cast("int").alias("bucket"))


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = DIMS, shards: int = SHARDS, bits: int = BITS, files: int = 1) -> None:
    """The rows of docs, all and whole, in folders shard=0, …; each in `files` files or a few more, runs of the curve."""
    row = whole_rows(docs)
    placed = sharded(docs.select("*", row.alias("__row")), dims, shards, bits, keep=("__row",))
    runs = placed.select("shard", "slot", "__row").repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    runs.select("__row.*", F.col("shard")).write.partitionBy("shard").parquet(path)
