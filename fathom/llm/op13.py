"""Query op13: all documents in eight shards along a Hilbert curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .op11 import _crc_table
from .sharding import BITS, CODE_BYTES, DIMS, FINE, SHARDS, sharded


def op13_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def _curve() -> list[int]:
    """The place of each cell on the curve, by cells in order: places are turned into cells (Skilling, 2004)."""
    n, out = len(DIMS), [0] * (1 << BITS * len(DIMS))
    for place in range(len(out)):
        x = [0] * n
        for k in range(BITS * n):
            x[k % n] |= (place >> (BITS * n - 1 - k) & 1) << (BITS - 1 - k // n)
        last = x[-1] >> 1
        for i in range(n - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= last
        for q in (1 << k for k in range(1, BITS)):
            for i in range(n - 1, -1, -1):
                low = q - 1 if x[i] & q else (x[0] ^ x[i]) & (q - 1)
                x[0] ^= low
                x[i] ^= 0 if x[i] & q else low
        cell = 0
        for v in x:
            cell = cell << BITS | v
        out[cell] = place
    return out


_SHARED = "(SELECT max(i) FROM range(0, 1 + least(length(low_{0}), length(high_{0})) // 2) r(i) WHERE left(low_{0}, 2 * i) = left(high_{0}, 2 * i))"
_STRING = f"coalesce(substr(hex(encode({{0}})), 2 * p_{{0}} + 1, {2 * CODE_BYTES}), '')"
_NUMBER = f"lpad(CAST(e * {1 << FINE} + CASE WHEN e >= {FINE} THEN size >> (e - {FINE}) ELSE size << ({FINE} - e) END - {(1 << FINE) - 1} AS VARCHAR), 6, '0')"
_BUCKET = f"(rank() OVER (ORDER BY {{}}) - 1) * {1 << BITS} // count(*) OVER ()"

SQL = f"""
WITH d AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS md5, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents),
m AS (SELECT hex(encode(min(lang))) AS low_lang, hex(encode(max(lang))) AS high_lang, hex(encode(min(source))) AS low_source, hex(encode(max(source))) AS high_source FROM d),
s AS (SELECT {_SHARED.format('lang')} AS p_lang, {_SHARED.format('source')} AS p_source FROM m),
c AS (SELECT *, {_STRING.format('lang')} AS a, {_STRING.format('source')} AS b, length(bin(size)) - 1 AS e FROM d, s),
q AS (SELECT *, {_BUCKET.format('a')} AS x, {_BUCKET.format('b')} AS y, {_BUCKET.format(_NUMBER)} AS z FROM c),
o AS (SELECT *, list_extract(CAST({_curve()} AS BIGINT[]), ((x << {BITS} | y) << {BITS} | z) + 1) AS curve FROM q),
p AS (SELECT *, row_number() OVER (ORDER BY curve, md5, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM o),
t AS (SELECT *, place * {SHARDS} // n AS shard FROM p)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
    lambda c, b: xor(c >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(c, b) & 255) + 1))), 4294967295::BIGINT) AS text_crc32,
  'rows' AS law, CAST(shard AS INTEGER) AS shard, place - (shard * n + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS DOUBLE) AS grown_shard, curve FROM t
"""
