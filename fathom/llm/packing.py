"""Packing documents into sequences by a configuration linear program.

Only the histogram of lengths matters for how to fill sequences.  The program has a
variable for each configuration (the lengths in one sequence) and a demand for each
length.  Multiplicative weights solve it: lengths that are covered too little weigh
more, a knapsack dynamic program finds the configuration of most weight, and so on.
Whole parts of the solution are used, what they leave is packed best fit decreasing
on the histogram.  The plan has as many rows as configurations and lengths, whatever
the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, filed, salt, saved
from .tokens import Encoder

CAPACITY = 1024
END_ID = 2
#: Pieces of one length in a bucket that are ranked by one task.
BUCKET_ROWS = 50_000
#: Multiplicative weights end where the cover is within this share of the bound, or
#: after so many cells of knapsacks (250 rounds where all lengths to 1023 occur, more
#: where a round costs less); their step; and how much less than the best a
#: configuration may be worth: a quarter of the gap that is left, within these limits.
GAP, CELLS, STEP, SLACK = 0.015, 250 << 20, 0.3, (0.002, 0.05)
MOST_ROUNDS = 3000
#: The share of short pieces that is kept for what rounding leaves; how often the
#: program is solved, and the share of pieces that it must place to be solved again.
HELD_BACK, PASSES, LEAST_PLACED = 0.5, 3, 0.3

#: A document has fewer pieces than this; places are so far apart that one task ranks
#: the pieces of so many documents, at most.
MOST_PIECES = 1 << 22
ORDER_SPAN = BUCKET_ROWS * MOST_PIECES

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Plan = list[tuple[dict[int, int], int]]  # configurations: copies of each length, and how often


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of docs(doc_id, text, …): its ids and end_id, cut where longer than capacity.

    The first piece takes what is over, so that all later ones are full.  Further
    columns are kept with each piece.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = ", ".join([PIECES, *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in more]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for b in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(b.column("text")):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                out += [(row, i, x, y - x, zlib.crc32(ids[x:y].tobytes())) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            at, piece, start, length, crc = np.array(out, np.int64).reshape(-1, 5).T
            kept = [b.column(c).take(pa.array(at)) for c in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays([kept[0], pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), *kept[1:]], ["doc_id", "piece", "start", "length", "ids_crc32", *more])

    return docs.mapInArrow(each, schema)


def knapsack(value: np.ndarray, asked: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most value that fits into each room up to capacity, and a length that is taken there (0: none)."""
    at = np.flatnonzero(asked)
    gain, several = value[at], np.searchsorted(at, np.arange(capacity + 1), "right")
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if several[room]:
            total = best[room - at[: several[room]]] + gain[: several[room]]
            i = int(total.argmax())
            if total[i] >= best[room]:
                best[room], taken[room] = total[i], at[i]
    return best, taken


def configurations(taken: np.ndarray, first: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A row for each length of first: it and the best that fits beside it, ascending, 0 padded.

    Copies of a length beyond its demand are left out.
    """
    rows, room = [first], capacity - first
    while room.any():
        rows.append(taken[room])
        room = room - np.where(room > 0, np.maximum(taken[room], 1), 0)
    held = np.sort(np.stack(rows, axis=1), axis=1)
    nth = np.zeros(held.shape, np.int64)  # of equal lengths
    for i in range(1, held.shape[1]):
        nth[:, i] = np.where(held[:, i] == held[:, i - 1], nth[:, i - 1] + 1, 0)
    return np.sort(np.where(nth < demand[held], held, 0), axis=1)


def solve(demand: np.ndarray, capacity: int, whole: np.ndarray | None = None) -> tuple[dict[bytes, float], float]:
    """A fractional cover of demand (by length) by multiplicative weights.

    Lengths begin with the weight of their tokens.  A round prices all configurations
    by one knapsack, takes for each length the best one with it, as long as that is
    worth nearly as much (SLACK) as the best of all, and covers the lengths by those
    together, in proportion to demand; the more a length is covered, the less it
    weighs from there on.

    Result: how often to use each configuration (its lengths, ascending, as int16);
    and a bound that no packing of `whole` (the same lengths; demand, if left out)
    beats: its value over that of the best configuration, at the best values seen.
    """
    asked, bound = demand > 0, 0.0
    at, many = np.flatnonzero(asked), demand[asked].astype(float)
    whole = demand if whole is None else whole
    used: dict[bytes, float] = {}
    total, own = 0.0, 0.0
    covered, weight, value = np.zeros(len(demand)), many * at, np.zeros(len(demand))
    gap = np.inf
    for _ in range(min(MOST_ROUNDS, CELLS // (capacity * len(at))) if len(at) else 0):
        if gap <= GAP:
            break
        value[at] = weight / many
        value /= value.max()
        best, taken = knapsack(value, asked, capacity)
        bound = max(bound, float(value @ whole) / best[capacity])
        near = value[at] + best[capacity - at] >= (1 - min(max(gap / 4, SLACK[0]), SLACK[1])) * best[capacity]
        first = at[near]
        held = configurations(taken, first, demand, capacity)
        times = demand[first] / (held == first[:, None]).sum(1)
        more = np.bincount(held.ravel(), np.repeat(times, held.shape[1]), len(demand))
        more[at] /= many
        more[0], times = 0, times / more[at].max()
        more /= more[at].max()
        covered += more
        weight *= np.exp(-STEP * more[at])
        weight = np.maximum(weight / weight.max(), 1e-200)
        for row, n in zip(held.astype(np.int16), times, strict=True):
            key = row[row > 0].tobytes()
            used[key] = used.get(key, 0) + n
        total += times.sum()
        own = max(own, float(value[at] @ many) / best[capacity])
        gap = total / max(covered[at].min(), 1e-9) / own - 1
    # Lengths that the rounds leave all but uncovered are for best fit: scale by the mean then.
    scale = covered[at].min() if len(at) and covered[at].min() >= 0.5 * covered[at].mean() else covered[at].mean() if len(at) else 1
    return {k: n / scale for k, n in used.items()}, bound


def rounded(used: dict[bytes, float], left: np.ndarray) -> Plan:
    """Whole numbers of the configurations, taken from left.

    Configurations of one longest length are rounded together: each gets the whole
    numbers that the sum up to it passes, so that their sum is kept and long and
    short lengths go in the program's proportions.  Of these only the fullest are
    taken; those that a small demand has cut are not.
    """
    out = []
    rows = [(np.frombuffer(key, np.int16).astype(np.int64), n) for key, n in used.items()]
    total, longest, fullest = 0.0, -1, 0
    for row, n in sorted(rows, key=lambda x: (-x[0][-1], -x[0].sum(), -x[1])):
        if row[-1] != longest:
            total, longest, fullest = 0.0, row[-1], row.sum()
        if row.sum() < fullest:
            continue
        times, total = int(total + n + 1e-9) - int(total + 1e-9), total + n
        lengths, copies = np.unique(row, return_counts=True)
        times = min(times, int((left[lengths] // copies).min()))
        if times > 0:
            out.append((dict(zip(lengths.tolist(), copies.tolist(), strict=True)), times))
            left[lengths] -= times * copies
    return out


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing, with all sequences of one filling at a time."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for n in range(len(left) - 1, 0, -1):
        count = int(left[n])
        while count:
            space = min((s for s, x in room.items() if s >= n and x), default=0)
            filling, times = room[space].pop() if space else ({}, -(-count // (capacity // n)))
            space = space or capacity
            copies = min(space // n, count)
            whole = min(times, count // copies)
            if times > whole:
                rest = room.setdefault(space, [])
                rest.append((filling, times - whole)) if filling else None
            room.setdefault(space - n * copies, []).append((filling | {n: filling.get(n, 0) + copies}, whole))
            count -= whole * copies
    return [x for many in room.values() for x in many]


def plan(demand: np.ndarray, capacity: int) -> tuple[Plan, int, float]:
    """Configurations that hold exactly demand[n] pieces of each length n.

    Also how many pieces are in configurations of the program, and its bound on the
    number of sequences.  A share of the shortest pieces (HELD_BACK, of those below an
    eighth of the capacity) is held back: what rounding leaves is then easy to fill,
    and goes best fit decreasing.  The program is solved again for what rounding
    leaves, as long as that is worth it.
    """
    held = np.where(np.arange(len(demand)) < capacity // 8, (demand * HELD_BACK).astype(np.int64), 0)
    left, out, bound = demand - held, [], 0.0
    for _ in range(PASSES):
        used, least = solve(left, capacity, demand)
        bound, before = bound or least, int(left.sum())
        out += rounded(used, left)
        if before - left.sum() < LEAST_PLACED * before:
            break
    by_program = int(demand.sum() - held.sum() - left.sum())
    return out + best_fit(left + held, capacity), by_program, bound


def slots(found: Plan) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, copies, first sequence, first offset), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for filling, times in found:
        offset = 0
        for n, copies in sorted(filling.items(), reverse=True):
            rows.setdefault(n, []).append((rank.get(n, 0), copies, sequence, offset))
            rank[n] = rank.get(n, 0) + copies * times
            offset += n * copies
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most capacity tokens.

    Result, for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and
    offset.  Full pieces are a sequence each.  A null text counts as empty and has
    its end id alone; repeated rows are packed each; null ids are passed through; an
    empty table gives no rows.

    in_order: docs are read from files, in whose order pieces take their places: of
    pieces of one length earlier ones go to earlier sequences, and sequence_id grows
    with the first place among a sequence's pieces.
    """
    found = saved(pieces(filed(docs) if in_order else columns(docs, doc_id="long", text="string"), tokenizer, capacity), "pieces")
    if in_order:
        found = saved(_in_file_order(found), "ordered")
    short = found.filter(F.col("length") < capacity)
    if in_order:
        short, order = short.withColumn("bucket", F.floor(F.col("place") / ORDER_SPAN)), ["place"]
    else:
        buckets = -(-short.count() // BUCKET_ROWS) or 1
        short, order = short.withColumn("bucket", salt("doc_id", "piece", "ids_crc32", of=buckets)), ["doc_id", "piece", "start", "ids_crc32"]
    cells = saved(short.groupBy("length", "bucket").agg(F.count("*").alias("n")), "cells")
    demand = np.zeros(capacity, np.int64)
    for row in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length: capacity at most
        demand[row["length"]] = row["n"]
    table = slots(plan(demand, capacity)[0])

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = short.withColumn("rank", F.row_number().over(within) - 1).join(cells, ["length", "bucket"])
    ranked = ranked.select(*found.columns, (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = table[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join([PIECES, "place long, sequence_id long, offset long" if in_order else "sequence_id long, offset long"])
    out = ranked.mapInArrow(placed, kinds)
    full = found.filter(F.col("length") == capacity)
    if not in_order:
        return out.unionByName(full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    out = out.withColumn("sequence_id", F.min("place").over(Window.partitionBy("sequence_id")))
    return out.unionByName(full.select("*", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))).drop("place")


def _in_file_order(found: DataFrame) -> DataFrame:
    """Pieces with `place` instead of file and row: distinct, and growing with file, row and piece."""
    rows = found.filter("piece = 0").groupBy("file").agg((F.max("row") + 1).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    first = rows.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    place = (F.col("first") + F.col("row")) * MOST_PIECES + F.col("piece")
    return found.join(first, "file").withColumn("place", place).drop("file", "row", "first")
