"""Query op11: all conversations, damaged by a rule and repaired."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns
from .repair import DELETE, INSERT, LEFT_TRUNCATED, REROLE, repair

MODULUS = 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without their endings, repeated or given to the user, by a checksum of id and turn.

    Nulls are read as one space; a null turn stays null for the order.
    """
    base = columns(conversations, conv_id="long", turn="long", role="string", text="string")
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in base.columns)
    rows = base.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat_ws(":", conv_id, turn).cast("binary")) % MODULUS).alias("rule"))
    rows = rows.filter("rule <> 0").withColumn("times", F.when(F.col("rule") == 3, 2).otherwise(1))
    role = F.when(F.col("rule") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def repaired(conversations: DataFrame) -> DataFrame:
    found = repair(damaged(conversations)).withColumn("conv_id", F.col("conv_id").cast("long"))
    numbers = [c for c in found.columns if c not in ("conv_id", "audit", "repaired_sha256")]
    # A conversation of which nothing is left has its row as well.
    ids = columns(conversations, conv_id="long").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in numbers], F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
    some = found.select(F.col("conv_id").alias("_id")).withColumn("_some", F.lit(True))
    return found.unionByName(ids.distinct().join(some, F.col("conv_id").eqNullSafe(F.col("_id")), "left_anti"))


def _crc_table() -> list[int]:
    """CRC-32 of each byte: eight steps of the reflected polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ 0xEDB88320 * (c & 1) for c in table]
    return table


_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(k)), lambda i: ascii(substr(k, i + 1, 1))::BIGINT)), lambda c, b: xor(c >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(c, b) & 255) + 1))), 4294967295::BIGINT)"


def _way(cost: str, letter: str, line: str | None, after: str) -> str:
    """A cheapest rest of a conversation with one edit before it, as a struct that compares by cost, then letters."""
    lines = f"{after}.t" if line is None else f"list_prepend({line}, {after}.t)"
    return f"{{'c': {cost} + {after}.c, 's': '{letter}' || {after}.s, 't': {lines}}}"


def _row(q: int, role: str, to: int, keeps: str) -> str:
    """The cheapest way past a row in state q (from 1): deleted, rerole to role, or kept if its initial is one of keeps."""
    left = f"CASE WHEN fault = 1 THEN {LEFT_TRUNCATED} ELSE 0 END"
    ways = [_way(str(DELETE), "D", None, f"best[{q}]"), f"CASE WHEN fault < 2 THEN {_way(f'{REROLE} + {left}', 'R', f"'{role}:' || text", f'best[{to}]')} END"]
    ways += [f"CASE WHEN fault < 2 AND ini = '{k}' THEN {_way(left, 'K', "role || ':' || text", f'best[{2 if k == "s" else to}]')} END" for k in keeps]
    return f"list_min([{', '.join(ways)}])"


_INSERTED = [_way(str(INSERT), "I", f"'{role}:'", "{}").replace("{}", after) for role, after in (("user", "x[3]"), ("assistant", "x[4]"), ("user", "v[3]"), ("assistant", "v[4]"))]

SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC} % {MODULUS} AS rule FROM c),
d AS (SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role, CASE rule WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE rule WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier, count(*) OVER (PARTITION BY conv_id) AS many,
  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
    WHEN regexp_matches(text, '[.!?][ 	-
]*$') THEN 0 ELSE 1 END AS fault FROM n),
w AS (
  SELECT DISTINCT conv_id, many + 1 AS i, [{{'c': 0, 's': '', 't': []::VARCHAR[]}}, {{'c': {2 * INSERT}, 's': 'II', 't': ['user:', 'assistant:']}},
    {{'c': {INSERT}, 's': 'I', 't': ['assistant:']}}, {{'c': 0, 's': '', 't': []::VARCHAR[]}}] AS best FROM f
  UNION ALL
  SELECT conv_id, i, [list_min([x[1], {_INSERTED[0]}]), list_min([x[2], {_INSERTED[0]}]), x[3], x[4]] FROM (
    SELECT conv_id, i, [v[1], v[2], list_min([v[3], {_INSERTED[3]}]), list_min([v[4], {_INSERTED[2]}])] AS x FROM (
      SELECT f.conv_id, f.i, [{_row(1, "user", 3, "su")}, {_row(2, "user", 3, "u")}, {_row(3, "assistant", 4, "a")}, {_row(4, "user", 3, "u")}] AS v
      FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1))),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
  count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (i > 1 AND earlier || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best[1].c, 0) AS BIGINT) AS cost, coalesce(best[1].s, '') AS audit, sha256(coalesce(array_to_string(best[1].t, chr(10)), '')) AS repaired_sha256
FROM o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 1
"""
