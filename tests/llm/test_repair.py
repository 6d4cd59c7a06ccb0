"""Conversation repair against a plain search over suffixes and over all edits."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import pyarrow.parquet as pq
import pytest

from fathom.llm import op11, repair

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def slow_damage(rows):
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        rule, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if rule == 1 else "".join(c for c in text if c not in ".!?") if rule == 2 else text
        yield from [(conv, turn, "user" if rule == 4 else role, text)] * {0: 0, 3: 2}.get(rule, 1)


def faults(rows):
    seen = set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        yield "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def cheapest(rows, found):
    """(cost, letters, lines): least over all suffixes, from the last row back; q: the initial of the turn before."""
    far = (10**9, "", [])
    after = {q: (0, "", []) if q in ("", "a") else far for q in ("", "s", "u", "a")}

    def inserted(best):
        for _ in range(3):
            for q, r in product(best, "ua"):
                if (to := STEPS.get((q, r))) and (cost := best[to][0] + 5) < 10**9:
                    best[q] = min(best[q], (cost, "I" + best[to][1], [f"{NAMES[r]}:", *best[to][2]]), key=lambda x: x[:2])
        return best

    after = inserted(after)
    for (_, role, text), fault in list(zip(rows, found, strict=True))[::-1]:
        now = {}
        for q in after:
            ways = [(after[q][0] + 2, "D" + after[q][1], after[q][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if to := STEPS.get((q, role[:1])):
                    ways.append((after[to][0] + more, "K" + after[to][1], [f"{role}:{text}", *after[to][2]]))
                for r in "ua":
                    if to := STEPS.get((q, r)):
                        ways.append((after[to][0] + 1 + more, "R" + after[to][1], [f"{NAMES[r]}:{text}", *after[to][2]]))
            now[q] = min(ways, key=lambda x: x[:2])
        after = inserted(now)
    return after[""]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    found = list(faults(rows))
    known = {t for t, _, _ in rows if t is not None}
    cost, audit, lines = cheapest(rows, found)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") or not (a[1] and b[1]) for a, b in zip(rows, rows[1:]))
    return max(known, default=0) - min(known, default=1) + 1 - len(known), *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def slow(rows):
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    groups = defaultdict(list)
    for conv, *row in slow_damage(rows):
        groups[conv].append(row)
    return out | {c: expected(g) for c, g in groups.items()}


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{DATA}/conversations.parquet").to_pylist()]
    assert got(op11.op11_conversation_repair(spark, DATA)) == slow(rows)


def made(n, seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "well", "", " \n", "Why?", "so. ", None, "x" * 70 + "1.", "x" * 70 + "2."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]
    return [(r.choice([None, *range(12)]), r.choice([None, *range(40)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 4096])
def test_made_conversations(spark, monkeypatch, block):
    """Nulls, ties, repeated rows, blank texts, other roles; whole, and cut into blocks of two rows."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = made(400, block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS seq", "'z' AS kind", "'z' AS conv")
    assert got(op11.repaired(df)) == slow(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 64)
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["same.", f"t{t}.", f"cut {t}"])) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(op11.repaired(df)) == slow(rows)
    kinds, _ = repair.turns(df)
    assert kinds.count() == 3000 and repair.edits(kinds).count() == 3000


def test_least_letters_over_all_edits():
    """Tight arcs and the walk against every string of edits."""
    r = random.Random(3)
    for _ in range(300):
        rows = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b.", "cut", ""])) for i in range(r.randint(1, 4))]
        found = list(faults(rows))
        kinds = [repair.INITIALS.find(row[1][0]) % 4 * 4 + repair.FAULTS.index(f) for row, f in zip(rows, found, strict=True)]
        tight = repair.Tight(kinds, repair.START, repair.END)
        audit = "".join("I" * len(a) + b + "I" * len(d) for a, b, _, d in tight.walk(frozenset([0]), True))
        best = []
        for letters in product("DKR", repeat=len(rows)):
            for ins in product(range(3), repeat=len(rows) + 1):
                todo = "".join("I" * n + x for n, x in zip(ins, [*letters, ""], strict=True))
                states, at = {("", 0)}, 0
                for c in todo:
                    if c == "I":
                        states = {(STEPS[q, x], k + 5) for q, k in states for x in "ua" if (q, x) in STEPS}
                        continue
                    role, fault = rows[at][1][0], found[at]
                    at += 1
                    more = 5 * (fault == "truncated")
                    if c == "D":
                        states = {(q, k + 2) for q, k in states}
                    elif fault in ("blank", "duplicate"):
                        states = set()
                    else:
                        states = {(STEPS[q, x], k + more + (c == "R")) for q, k in states for x in (role if c == "K" else "ua") if (q, x) in STEPS}
                best += [(k, todo) for q, k in states if q in ("", "a")]
        assert (tight.total, audit) == min(best)


def test_turns_after_repair(spark, none):
    df = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "cut"), (1, 2, "assistant", "Hi."), (2, 0, "system", "Be kind."), (2, 1, "user", "Q?")], "conv_id long, turn long, role string, text string")
    out = [(r["conv_id"], r["role"], r["text"], r["edit"]) for r in repair.repaired_turns(df).orderBy("conv_id", "seq", "place").collect()]
    assert out == [("1", "user", "Hello.", "K"), ("1", "assistant", "Hi.", "K"), ("2", "user", "Be kind.", "R"), ("2", "assistant", "Q?", "R")]
    assert op11.repaired(none.selectExpr("doc_id AS conv_id", "lang AS role", "text", "doc_id AS turn")).count() == 0
