"""Physical layouts that stand for index structures, and what of them a predicate has to read.

A sorted layout lets the minima and maxima of files and row groups skip.  A hashed and
a spatial layout keep rows in leaves, folders of files: a leaf is known by the first
bits of its rows' codes (a hash of the key; the Z-order of a point's cell), and a leaf
with too many rows is cut by one bit more, it alone.  Every part of a table has leaves
of its own, so an append cuts nothing that is there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..plans.planner import GIVEN, INDEX_KINDS
from .storage import ROW, Storage

#: Bits of a code, so leaves of a part at most, and rows of a leaf from which on it is cut.
CODE_BITS, LEAF_ROWS = 16, 200_000
LEAF = "_leaf"


def ordered(df: DataFrame, column: str) -> DataFrame:
    """Range-partitioned and sorted: min/max statistics skip files and row groups."""
    return df.repartitionByRange(column, ROW).sortWithinPartitions(column, ROW)


# Leaves
def leaves(df: DataFrame, code: Column, order: Sequence[str]) -> DataFrame:
    """df with its leaf, to be written by leaf: 'b' and the first bits of the code, of 0 to 2^CODE_BITS - 1.

    Rows without a code are in a leaf of their own.  The counts of codes, 2^CODE_BITS at
    most, say where to cut; a code with more rows than a leaf's stays one leaf, of
    several files.
    """
    coded = df.withColumn("_code", code.cast("int"))
    counts = {r["_code"]: r["count"] for r in coded.groupBy("_code").count().collect() if r["_code"] is not None}
    named = df.sparkSession.createDataFrame(_cut(counts), f"_code int, {LEAF} string")
    out = coded.join(F.broadcast(named), "_code", "left").drop("_code").withColumn(LEAF, F.coalesce(LEAF, F.lit("none")))
    return out.hint("rebalance", F.col(LEAF)).sortWithinPartitions(LEAF, *order)


def _cut(counts: dict[int, int]) -> list[tuple[int, str]]:
    """The leaf of each code."""
    out, todo = [], [("", sorted(counts))]
    while todo:
        bits, codes = todo.pop()
        if len(codes) < 2 or len(bits) == CODE_BITS or sum(counts[c] for c in codes) <= LEAF_ROWS:
            out += [(c, f"b{bits}") for c in codes]
            continue
        shift = CODE_BITS - len(bits) - 1
        for b in "01":
            half = [c for c in codes if c >> shift & 1 == int(b)]
            todo += [(bits + b, half)] if half else []
    return out


def hash_code(key: Column) -> Column:
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(1 << CODE_BITS)))


def hashed(df: DataFrame, column: str) -> DataFrame:
    """Rows of a key in one leaf, sorted."""
    return leaves(df, hash_code(F.col(column)), [column, ROW])


def of_key(value: Column) -> Column:
    """The leaf that may hold a key; a condition on folders, so the others aren't listed, let alone read."""
    bits = F.lpad(F.bin(hash_code(value)), CODE_BITS, "0")
    return F.startswith(F.concat(F.lit("b"), bits), F.col(LEAF))


def spatial(df: DataFrame, column: str) -> DataFrame:
    """Coordinates as columns _x0, _x1, … and points near each other in one leaf."""
    axes = df.agg(F.max(F.size(column))).first()[0]
    axes = 2 if axes is None or axes < 1 else axes
    out = df.select("*", *[F.get(F.col(column), F.lit(i)).alias(f"_x{i}") for i in range(axes)])
    lo_hi = out.agg(*[f(f"_x{i}").alias(f"{n}{i}") for i in range(axes) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    bits = max(1, CODE_BITS // axes)
    cells = []
    for i in range(min(axes, CODE_BITS)):
        lo, hi = lo_hi[f"lo{i}"], lo_hi[f"hi{i}"]
        width = ((hi - lo) if lo is not None else 0) or 1.0
        cells.append(F.floor((F.col(f"_x{i}") - (lo or 0.0)) / width * ((1 << bits) - 1)).cast("long"))
    z = F.lit(0).cast("long")
    for bit in range(bits):
        for i, cell in enumerate(cells):
            z = z + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(1), bit * len(cells) + i)
    # Codes fill their bits from the top, so that leaves are cut where the points are.
    return leaves(out, z * (1 << max(0, CODE_BITS - bits * len(cells))), [f"_x{i}" for i in range(axes)])


def axes_of(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("_x") and c[2:].isdigit()), key=lambda c: int(c[2:]))


def directory(held: DataFrame) -> DataFrame:
    """(leaf, n, lo and hi by axis): the boxes of a spatial layout's leaves, a row a leaf."""
    ends = [f(a).alias(f"{n}{a[2:]}") for a in axes_of(held) for n, f in (("lo", F.min), ("hi", F.max))]
    return held.filter(F.col(LEAF) != "none").groupBy(LEAF).agg(F.count("*").alias("n"), *ends)


@dataclass
class Points:
    """A spatial layout: parts and their directories."""

    storage: Storage
    table: str
    parts: list[DataFrame]
    directories: list[DataFrame]

    def _read(self, wanted: dict[int, list[str]]) -> DataFrame:
        parts = [p.filter(F.col(LEAF).isin(wanted[i])) for i, p in enumerate(self.parts) if i in wanted] or [self.parts[0].limit(0)]
        return self.storage.alive(self.table, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))

    def _leaves(self, where: Callable[[DataFrame], Column]) -> dict[int, list[str]]:
        """The leaves of boxes that meet a condition, by part."""
        out: dict[int, list[str]] = {}
        found = reduce(DataFrame.unionByName, [d.filter(where(d)).select(F.lit(i).alias("part"), LEAF) for i, d in enumerate(self.directories)])
        for r in found.collect():
            out.setdefault(r["part"], []).append(r[LEAF])
        return out

    def within(self, low: Sequence[float], high: Sequence[float]) -> DataFrame:
        """Rows of the leaves whose boxes meet a box."""

        def where(d: DataFrame) -> Column:
            meets = [(F.col(f"hi{i}") >= float(a)) & (F.col(f"lo{i}") <= float(b)) for i, (a, b) in enumerate(zip(low, high, strict=True)) if f"lo{i}" in d.columns]
            return reduce(lambda x, y: x & y, meets, F.lit(len(meets) == len(low)))

        return self._read(self._leaves(where))

    def near(self, point: Sequence[float], k: int) -> DataFrame:
        """Rows among which are the k nearest to a point: of the leaves whose boxes are near enough.

        Boxes by their farthest corner, until they have k rows, bound the k-th distance;
        leaves whose nearest corner is within it are read.  Where deleted rows leave
        fewer than k in it, the bound is widened until it has them.
        """

        def corner(d: DataFrame, far: bool) -> Column:
            each = []
            for i, x in enumerate(point):
                lo, hi = (F.col(f"{n}{i}") if f"{n}{i}" in d.columns else F.lit(None).cast("double") for n in ("lo", "hi"))
                off = F.greatest(F.abs(lo - x), F.abs(hi - x)) if far else F.greatest(lo - x, x - hi, F.lit(0.0))
                each.append(off * off)
            return F.sqrt(reduce(lambda a, b: a + b, each))

        ends = reduce(DataFrame.unionByName, [d.select(corner(d, True).alias("far"), "n") for d in self.directories]).filter("far is not null")
        seen, bound = 0, math.inf
        for r in ends.orderBy("far").limit(max(k, 1)).collect():  # a row a leaf, of one row at least
            seen += r["n"]
            if seen >= k:
                bound = r["far"]
                break
        while True:
            # A little more than the bound: distances of points are added up in another order.
            df = self._read(self._leaves(lambda d, b=bound: corner(d, False) <= b * (1 + 1e-9)))
            if bound == math.inf or not self.storage.get(self.table).marks:
                return df
            off = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"_x{i}") - x) * (F.col(f"_x{i}") - x) for i, x in enumerate(point)]))
            if df.filter(off <= bound).limit(k).count() >= k:
                return df
            bound = 2 * bound if 0 < bound < 1e300 else math.inf


def points(storage: Storage, name: str, column: str) -> Points | None:
    """The spatial layout of an indexed column; None where there is none, or no rows."""
    if storage.get(name).indexes.get(column, {}).get("kind") != "rtree" or not storage.get(name).parts:
        return None
    what = f"{column}-rtree"
    parts = storage.each_part(name, what, lambda rows: spatial(rows, column), by=LEAF)
    boxes = [storage._built(f"{p.path}-{what}-boxes", lambda d=d: directory(d).coalesce(1)) for p, d in zip(storage.get(name).parts, parts, strict=True)]
    return Points(storage, name, parts, boxes)


# Vectors
def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row a key, the last inserted, with the vector's length."""
    last = F.max_by(F.col(column), F.col(ROW)).alias("vec")
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(last).withColumn("norm", norm(F.col("vec")))


@dataclass(frozen=True)
class Kind:
    """An index kind: how a part's rows are laid out for a column, by which column folders are cut, and which of them an equality needs."""

    build: Callable[[DataFrame, str], DataFrame]
    by: str | None = None
    of_key: Callable[[Column], Column] | None = None


#: Kinds for equality and ranges; `register` adds others.
KINDS = {"bplus": Kind(ordered), "isam": Kind(ordered), "hash": Kind(hashed, LEAF, of_key), "rtree": Kind(spatial, LEAF)}


def register(name: str, kind: Kind, serves: Sequence[str] = ("equality", "range")) -> None:
    """Makes an index kind known: CREATE INDEX … USING name then lays tables out by it.

    serves: the predicates that it may answer.  Answers never depend on a layout, only
    on what it leaves out for an equality, if it says so.
    """
    if name in INDEX_KINDS or not name.isidentifier() or name != name.lower():
        raise ValueError(f"{name} can't be the name of a new index kind")
    KINDS[name], GIVEN[name] = kind, tuple(serves)


def layout(storage: Storage, name: str, column: str, predicate: Any = None) -> DataFrame:
    """The table in the layout of the column's index, or as it is stored.

    predicate: an equality (with `value`), for which only folders that may hold it are read.
    """
    table = storage.get(name)
    kind = KINDS.get(table.indexes.get(column, {}).get("kind"))
    if kind is None or not table.parts:
        return storage.read(name)
    what = f"{column}-{table.indexes[column]['kind']}"
    value = getattr(predicate, "value", None)
    each = storage.each_part(name, what, lambda rows: kind.build(rows, column), by=kind.by)
    if kind.of_key and value is not None and not isinstance(value, (list, tuple)):
        each = [p.filter(kind.of_key(F.lit(value).cast(p.schema[column].dataType))) for p in each]
    return storage.alive(name, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each))
