"""Least-cost repair of the turns of conversations.

A conversation's roles must read ``(s?(ua)+)?`` by initials.  Rows and the states of
that pattern make a graph: node (i, q) stands before row i in state q, and arcs keep,
delete or rerole row i, or insert a turn before it.  Least costs forward from the
start and backward from the end tell which arcs are tight, that is on some cheapest
path; a walk that holds the set of nodes reachable by the letters so far then takes
the least letter of all tight arcs at each step.

Conversations are cut into blocks of at most BLOCK rows, so that none is held by one
task: a block's least costs from state to state are a matrix, the matrices of a
conversation give each block the costs before and after it, and the walk of each
block is known for every set that it may start from before it is known which it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, join_unique, saved

#: Rows of one conversation that are held at a time.
BLOCK = 4096
#: States: nothing yet, after the system's, a user's, an assistant's turn; where a conversation may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS, FAR = 4, (0, 3), 1 << 60
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
INITIALS = "sua?"
LEGAL = ("su", "ua", "au")
#: Faults: none, truncated, blank, duplicate; the last two must go.
FAULTS = ("", "truncated", "blank", "duplicate")
#: White space of ASCII, and what ends a sentence.
WHITE, ENDINGS = " \t\n\x0b\f\r", ".!?"

Arc = tuple[str, int, int, int, str]  # letter, from, to, cost, the role's initial
INSERTS: list[Arc] = [("I", q, to, INSERT, r) for (q, r), to in NEXT.items() if r in ROLES]


def _arcs(initial: str, fault: int) -> list[Arc]:
    """What may be done with a row, and the states that it leads from and to."""
    out: list[Arc] = [("D", q, q, DELETE, "") for q in range(STATES)]
    if fault < 2:
        more = LEFT_TRUNCATED * fault
        out += [("K", q, to, KEEP + more, r) for (q, r), to in NEXT.items() if r == initial]
        out += [("R", q, to, REROLE + more, r) for (q, r), to in NEXT.items() if r in ROLES and r != initial]
    return out


#: By kind of row: 4 x the initial's place + fault.
ARCS = [_arcs(i, f) for i in INITIALS for f in range(4)]


def _inserted(cost: list[int], back: bool = False) -> list[int]:
    """Least costs once turns may be inserted: forward from cost, or backward to it."""
    cost = list(cost)
    for _ in range(STATES):
        for _, q, to, c, _ in INSERTS:
            a, b = (to, q) if back else (q, to)
            cost[b] = min(cost[b], cost[a] + c)
    return cost


def _past(cost: list[int], kind: int, back: bool = False) -> list[int]:
    """Least costs past a row of a kind."""
    out = [FAR] * STATES
    for _, q, to, c, _ in ARCS[kind]:
        a, b = (to, q) if back else (q, to)
        out[b] = min(out[b], cost[a] + c)
    return out


START = _inserted([0] + [FAR] * (STATES - 1))
END = _inserted([0 if q in ENDS else FAR for q in range(STATES)], back=True)


def matrix(kinds: list[int]) -> list[list[int]]:
    """Least costs of a block: from each state before it, and its inserted turns, to each state after its last row."""
    out = []
    for q in range(STATES):
        cost = [0 if p == q else FAR for p in range(STATES)]
        for k in kinds:
            cost = _past(_inserted(cost), k)
        out.append([min(c, FAR) for c in cost])
    return out


class Tight:
    """The tight arcs of a block: costs before it and after it are given."""

    def __init__(self, kinds: list[int], before: list[int], after: list[int]):
        self.kinds, self.ahead, self.behind = kinds, [before], [after]
        for k in kinds:
            self.ahead.append(_inserted(_past(self.ahead[-1], k)))
        for k in reversed(kinds):
            self.behind.append(_inserted(_past(self.behind[-1], k, back=True), back=True))
        self.behind.reverse()
        self.total = min(a + b for a, b in zip(self.ahead[0], self.behind[0], strict=True))

    def step(self, i: int, states: frozenset[int]) -> tuple[str, str, frozenset[int]] | None:
        """The least letter of the tight arcs out of the nodes (i, states): letter, role's initial, next states."""
        best: dict[str, tuple[str, set[int]]] = {}
        here, inserts = self.ahead[i], [(a, i) for a in INSERTS]
        for (letter, q, to, c, role), j in [*inserts, *((a, i + 1) for a in (ARCS[self.kinds[i]] if i < len(self.kinds) else []))]:
            if q in states and here[q] + c + self.behind[j][to] == self.total:
                best.setdefault(letter, (role, set()))[1].add(to)
        if not best:
            return None
        letter = min(best)
        return letter, best[letter][0], frozenset(best[letter][1])

    def walk(self, states: frozenset[int], last: bool) -> Iterator[tuple[str, str, str, str]]:
        """For each row: turns inserted before it, its letter, its role's initial, turns inserted after it at the very end."""
        for i in range(len(self.kinds)):
            inserted = ""
            while True:
                letter, role, states = self.step(i, states)
                if letter != "I":
                    break
                inserted += role
            tail = ""
            if last and i + 1 == len(self.kinds):
                while not states & set(ENDS):
                    _, more, states = self.step(i + 1, states)
                    tail += more
            yield inserted, letter, role, tail

    def leads(self) -> list[int]:
        """The set of states, as bits, in which the walk from each set before the block leaves it."""
        now = {m: frozenset(q for q in range(STATES) if m >> q & 1) for m in range(1, 1 << STATES)}
        for i in range(len(self.kinds)):
            known: dict[frozenset[int], frozenset[int]] = {}
            for states in set(now.values()):
                letter, at = "I", states
                while letter == "I" and at:
                    found = self.step(i, at)
                    letter, at = (found[0], found[2]) if found else ("", frozenset())
                known[states] = at
            now = {m: known[s] for m, s in now.items()}
        return [0, *(sum(1 << q for q in now[m]) for m in range(1, 1 << STATES))]


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Neighbouring rows of equal keys, as they stream by."""
    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, lambda r: tuple(r[k] for k in keys))


def _mapped(df: DataFrame, by: list[str], order: list[str], each: Callable[[tuple, Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """each(keys, rows) over the rows of equal keys, by order; rows are not held, groups need no task of their own."""
    names = [f.split()[0] for f in schema.split(", ")]
    rows = df.repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for key, group in _runs(batches, by):
            held += [dict(zip(names, r, strict=True)) for r in each(key, group)]
            if len(held) >= BLOCK:
                yield pa.RecordBatch.from_pylist(held, arrow_schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


def key_of(conv_id: Column) -> Column:
    """A key that tells a null conversation from all others."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in their order, written down: (conv, seq, kind), and (conv, seq, turn, role, text) and more; seq orders all.

    Order: turn, nulls first, then role, then the text's first 64 characters, then its
    digest.  Ranges of that order are dealt, so a conversation of any length spreads;
    equal rows are told apart by where they were read.
    """
    base = columns(conversations, conv_id="string", turn="long", role="string", text="string")
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    base = base.select(key_of(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("read"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)), F.sha2("role", 256), F.left("text", F.lit(64)), F.sha2("text", 256), F.col("read")]
    rows = base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    bare = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumn("fault", F.when(bare == "", 2).when(F.right(bare, F.lit(1)).isin(*ENDINGS), 0).otherwise(1))
    # Lengths before the parts, so that no two pairs of role and text give the same key.
    key = F.sha2(F.concat_ws(":", F.length("conv"), F.length("role"), F.concat("conv", "role", "text")), 256)
    rows = saved(rows.select("conv", "seq", "turn", "role", "text", "fault", key.alias("key")), "turns")
    first = saved(rows.groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("copies")), "firsts")
    known = join_unique(rows.select("seq", "conv", "key", "fault", F.left("role", F.lit(1)).alias("initial")), first, "key", "copies", ["first"])
    fault = F.when((F.col("fault") < 2) & (F.col("seq") > F.col("first")), 3).otherwise(F.col("fault"))
    place = F.instr(F.lit(INITIALS[:-1]), F.col("initial"))
    initial = F.when((F.col("initial") == "") | (place == 0), len(INITIALS) - 1).otherwise(place - 1)
    return saved(known.select("conv", "seq", (initial * 4 + fault).cast("int").alias("kind")), "kinds"), rows


def _blocks(kinds: DataFrame) -> DataFrame:
    """What blocks of conversations that have several need: (conv, block, before, after, states, initial, last)."""
    each = kinds.groupBy("conv", "block").count()
    several = each.groupBy("conv").agg(F.count("*").alias("blocks")).filter("blocks > 1").drop("blocks")
    wide = saved(each.join(several, "conv", "left_semi").select("conv", "block"), "wide")
    rows = kinds.join(wide, ["conv", "block"], "left_semi")

    def costs(key: tuple, group: Iterator[dict]) -> Iterator[tuple]:
        mine = [r["kind"] for r in group]
        yield *key, [c for row in matrix(mine) for c in row], mine[-1] // 4

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        all_costs = [[list(m[q * STATES : q * STATES + STATES]) for q in range(STATES)] for m in pdf["costs"]]
        before, after = [START], [END]
        for m in all_costs[:-1]:
            before.append(_inserted([min(FAR, *(before[-1][q] + m[q][to] for q in range(STATES))) for to in range(STATES)]))
        for m in reversed(all_costs[1:]):
            after.append([min(FAR, *(m[q][to] + after[-1][to] for to in range(STATES))) for q in range(STATES)])
        n = len(pdf)
        return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "before": before, "after": after[::-1], "initial": [-1, *pdf["initial"][:-1]], "last": [False] * (n - 1) + [True]})

    def leads(key: tuple, group: Iterator[dict]) -> Iterator[tuple]:
        head = next(group)
        yield *key, head["before"], head["after"], head["initial"], head["last"], Tight([r["kind"] for r in group], head["before"], head["after"]).leads()

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, states = pdf.sort_values("block"), [1]
        for lead in pdf["leads"][:-1]:
            states.append(int(lead[states[-1]]))
        return pdf.drop(columns="leads").assign(states=states)

    # One row a block and conversation from here to `entered`: a BLOCK-th of the rows at most, and those of the seams.
    known = _mapped(rows, ["conv", "block"], ["seq"], costs, "conv string, block long, costs array<long>, initial int")
    facts = "conv string, block long, before array<long>, after array<long>, initial int, last boolean"
    heads = saved(known.groupBy("conv").applyInPandas(ends, facts), "ends")
    led = _mapped(_headed(rows, heads), ["conv", "block"], ["seq"], leads, f"{facts}, leads array<int>")
    return saved(led.groupBy("conv").applyInPandas(entered, f"{facts}, states int"), "entered")


def _headed(kinds: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with what is known of their block as a first row."""
    return kinds.unionByName(heads.withColumn("seq", F.lit(-1).cast("long")), allowMissingColumns=True)


def edits(kinds: DataFrame) -> DataFrame:
    """The cheapest edits of turns(): conv, seq, fault, inserted and tail (initials of turns before it and after the last), edit, to, cost, illegal."""
    kinds = kinds.withColumn("block", F.floor(F.col("seq") / BLOCK))
    heads = _blocks(kinds)

    def each(key: tuple, group: Iterator[dict]) -> Iterator[tuple]:
        rows = list(group)
        head = rows.pop(0) if rows[0]["seq"] < 0 else {"before": START, "after": END, "initial": -1, "last": True, "states": 1}
        mine = [r["kind"] for r in rows]
        tight = Tight(mine, head["before"], head["after"])
        states = frozenset(q for q in range(STATES) if head["states"] >> q & 1)
        earlier = head["initial"]
        for r, (inserted, letter, to, tail) in zip(rows, tight.walk(states, head["last"]), strict=True):
            initial, fault = divmod(r["kind"], 4)
            illegal = earlier >= 0 and INITIALS[earlier] + INITIALS[initial] not in LEGAL
            cost = {"K": KEEP, "R": REROLE, "D": DELETE}[letter] + LEFT_TRUNCATED * (fault == 1 and letter != "D") + INSERT * (len(inserted) + len(tail))
            yield key[0], r["seq"], fault, inserted, letter, ROLES.get(to) if letter == "R" else None, tail, cost, int(illegal)
            earlier = initial

    return _mapped(_headed(kinds, heads), ["conv", "block"], ["seq"], each, "conv string, seq long, fault int, inserted string, edit string, to string, tail string, cost long, illegal int")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The conversations after repair: conv_id (as text), seq, place, role, text and edit of each turn, deleted ones left out.

    place: 0 or more for inserted turns before the row, then the row, then those after it.
    """
    kinds, rows = turns(conversations)
    found = edits(kinds).join(rows.select("seq", "role", "text"), "seq")
    role = F.transform(F.split(F.concat("inserted", F.lit("="), "tail"), ""), lambda c: F.when(c == "u", "user").when(c == "a", "assistant").when(c == "=", F.coalesce("to", "role")))
    each = found.withColumn("roles", F.filter(role, lambda r: r.isNotNull())).select("*", F.posexplode("roles").alias("place", "new"))
    own = F.col("place") == F.length("inserted")
    out = each.select(_conv_id(), "seq", "place", F.col("new").alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"), F.when(own, F.col("edit")).otherwise("I").alias("edit"))
    return out.filter("edit <> 'D'")


def _conv_id() -> Column:
    return F.expr("if(conv = '', null, substring(conv, 2)) as conv_id")


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id (as text), gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    conversations: (conv_id, turn, role, text).  The faults of a row, first of all: blank
    (no character but ASCII white space), duplicate (role and text stood earlier in the
    conversation), truncated (the last such character ends no sentence).  Blank and
    duplicate rows are deleted; edits cost KEEP, REROLE, DELETE and INSERT, an undeleted
    truncated row LEFT_TRUNCATED more.  audit: initials of the cheapest edits, of equally
    cheap ones the least by ASCII; repaired_sha256: of ``role:text`` by lines.

    A null role or text is one space; a null conv_id is a conversation of its own; a
    null turn comes first and counts in no gap.  A role of no characters or with another
    initial must be reroled or deleted.  Equal rows after the first are duplicates.
    Texts may be of any length; an empty table gives no rows.

    A digest is made from the first byte to the last, so one conversation's turns stream
    through one task, which holds none of them; all else spreads over blocks.
    """
    kinds, rows = turns(conversations)

    def each(key: tuple, group: Iterator[dict]) -> Iterator[tuple]:
        sha, audit, counts, illegal, cost = hashlib.sha256(), [], [0] * len(FAULTS), 0, 0
        low = high = seen = None
        distinct, begun = 0, False

        def put(line: str) -> None:
            nonlocal begun
            sha.update((f"\n{line}" if begun else line).encode("utf-8", "surrogatepass"))
            begun = True

        for r in group:
            if r["text"] is None:
                edit = r
                continue
            if (t := r["turn"]) is not None:
                low, high, distinct, seen = t if low is None else low, t, distinct + (t != seen), t
            counts[edit["fault"]] += 1
            illegal, cost = illegal + edit["illegal"], cost + edit["cost"]
            audit.append("I" * len(edit["inserted"]) + edit["edit"] + "I" * len(edit["tail"]))
            for c in edit["inserted"]:
                put(f"{ROLES[c]}:")
            if edit["edit"] != "D":
                put(f"{edit['to'] or r['role']}:{r['text']}")
            for c in edit["tail"]:
                put(f"{ROLES[c]}:")
        gaps = 0 if low is None else high - low + 1 - distinct
        yield *key, gaps, *(counts[FAULTS.index(f)] for f in ("blank", "duplicate", "truncated")), illegal, cost, "".join(audit), sha.hexdigest()

    texts = rows.select("conv", "seq", "turn", "role", "text")
    both = edits(kinds).unionByName(texts, allowMissingColumns=True).withColumn("has_text", F.col("text").isNotNull())
    numbers = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    found = _mapped(both, ["conv"], ["seq", "has_text"], each, f"conv string, {numbers}, audit string, repaired_sha256 string")
    return found.select(_conv_id(), *found.columns[1:])
