"""Personal data: patterns propose, checksums confirm, context words adjust.

Only DataFrame and SQL functions.  A pattern marks its matches in the text, the
marked text is split, and the lengths of the pieces give the places: one pass of
Java's regex for each kind, without a shuffle.  Loops of the patterns are possessive
and starts are guarded, so that long runs of one class of characters stay linear.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

MARK = "\\u0001"
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
#: Characters before and after a span in which its context words are looked for.
CONTEXT = 48
#: Words that name a secret which is assigned after them.
SECRET_WORDS = "token|secret|password|passwd|api[_-]?key|access[_-]?key"
#: A pattern alone, a checksum that holds and a context word are worth so much.
WORTH = {"pattern": 0.35, "checksum": 0.45, "context": 0.3}
#: Spans of kinds beside the base ones are taken from this score on.
LEAST_SCORE = 0.6


class Kind(NamedTuple):
    name: str
    needs: str  # a text without this cheap sign has no match
    pattern: str  # group 1: before the span, group 2: the span
    holds: str  # over x.m, the match, and x.s, x.e, its place: what a match must meet
    checksum: bool
    words: str  # context words
    base: bool  # kept whatever its score


def luhn(digits: str) -> str:
    """Doubling every second digit from the right, the digit sum is a multiple of ten."""
    at = f"cast(substring({digits}, -i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 0, {at} * 2 - if({at} > 4, 9, 0), {at})) % 10 = 0"


def mod97(code: str) -> str:
    """The first four characters moved to the end, letters as 10 to 35, the number is 1 modulo 97."""
    turned = f"concat(substring({code}, 5), substring({code}, 1, 4))"
    value = "if(c between '0' and '9', cast(c as int), ascii(c) - 55)"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (a, c) -> (a * if({value} > 9, 100, 10) + {value}) % 97) = 1"


#: Pieces that are folded at a time, at least; characters of a block of the text.
FOLDED, BLOCK = 16, 64


def _char(at: str) -> str:
    """SQL for the character at a place, or an empty text after the end."""
    return f"substring(coalesce(get(blocks, ({at}) div {BLOCK}), ''), ({at}) % {BLOCK} + 1, 1)"


KINDS = (
    Kind("email", "instr(t, '@') > 0", r"()((?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++)", "true", False, "mail|contact|write", True),
    Kind("ip", "true", r"()((?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++)", r"forall(split(x.m, '\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)", False, "ip|host|address|server", True),
    Kind("card", "true", r"()([0-9](?:[ -]?[0-9])++)", f"length({DIGITS}) between 13 and 19 and {luhn(DIGITS)}", True, "card|credit|visa|pay", True),
    Kind("phone", "instr(t, '+') > 0", r"()(\\+[0-9][ ().0-9-]+[0-9])", f"length({DIGITS}) between 9 and 15", False, "phone|call|tel|mobile", True),
    Kind("iban", "true", r"(^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)", f"not ({_char('x.e')} rlike '[A-Za-z0-9]') and length(replace(x.m, ' ', '')) between 15 and 34 and {mod97("replace(x.m, ' ', '')")}", True, "iban|account|bank", False),
    Kind("ssn", "instr(t, '-') > 0", r"(^|[^A-Za-z0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})", f"not ({_char('x.e')} rlike '[A-Za-z0-9-]')", False, "ssn|social security", False),
    Kind("secret", f"lower(t) rlike '{SECRET_WORDS}'", rf'((?:^|[^A-Za-z0-9_])(?i:{SECRET_WORDS}) ?[=:] ?"?)([A-Za-z0-9_./+-]{{20,}})', "true", False, SECRET_WORDS, False),
)


SPAN = "struct<s:int,e:int,m:string>"


def _pieces(kind: Kind) -> str:
    """SQL for t in pieces: those at odd places are the kind's matches."""
    return f"if({kind.needs}, split(regexp_replace(t, '{kind.pattern}', '$1{MARK}$2{MARK}'), '{MARK}', -1), array(t))"


def _places(p: str) -> str:
    """SQL for the matches among pieces p, with their places: SPANs.

    A fold that appends to an array copies it each time.  So pieces are folded in blocks
    of about the cube root of their number: sums of blocks, where each starts, and each
    by itself.
    """
    of = f"greatest({FOLDED}, cast(cbrt(size({p})) as int))"
    block = f"slice({p}, k * b + 1, b)"
    sums = f"transform(sequence(0, (size({p}) - 1) div b), k -> aggregate({block}, 0, (a, x) -> a + length(x)))"
    starts = f"aggregate({sums}, named_struct('pos', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('pos', a.pos + x, 'out', concat(a.out, array(a.pos))), a -> a.out)"
    empty = f"cast(array() as array<{SPAN}>)"
    step = "named_struct('pos', a.pos + length(x), 'i', a.i + 1, 'out', if(a.i % 2 = 1, concat(a.out, array(named_struct('s', a.pos, 'e', a.pos + length(x), 'm', x))), a.out))"
    each = f"aggregate({block}, named_struct('pos', start, 'i', k * b, 'out', {empty}), (a, x) -> {step}, a -> a.out)"
    return f"if(size({p}) < 2, {empty}, flatten(transform(array({of}), b -> flatten(transform({starts}, (start, k) -> {each})))))"


def _between(start: str, n: str) -> str:
    """SQL for n characters of the text, CONTEXT at most, from blocks: long texts aren't walked from their start."""
    first = f"(({start}) div {BLOCK})"
    some = ", ".join(f"coalesce(get(blocks, {first} + {i}), '')" for i in range(CONTEXT // BLOCK + 2))
    return f"substring(concat({some}), ({start}) % {BLOCK} + 1, {n})"


def _spans(kind: Kind) -> str:
    """SQL for the kind's spans, from its places p_<kind> and the text's blocks."""
    found = f"filter(p_{kind.name}, x -> {kind.holds})"
    known = WORTH["pattern"] + WORTH["checksum"] * kind.checksum
    before, after = _between(f"greatest(x.s - {CONTEXT}, 0)", f"least(x.s, {CONTEXT})"), _between("x.e", f"{CONTEXT}")
    near = f"lower(concat({before}, ' ', {after})) rlike '{kind.words}'"
    score = f"cast(least(1D, {known}D + if({near}, {WORTH['context']}D, 0D)) as double)"
    out = f"transform({found}, x -> named_struct('kind', '{kind.name}', 's', x.s, 'e', x.e, 'score', {score}, 'base', {str(kind.base).lower()}))"
    return out if kind.base else f"filter({out}, x -> x.score >= {LEAST_SCORE}D)"


def _overlaps(spans: str) -> str:
    """SQL for whether x overlaps one of a kind's spans, which are in order and apart: the first that ends after x starts, by halving."""
    middle = "shiftright(a.lo + a.hi, 1)"
    step = f"if(a.lo < a.hi, if(get({spans}, {middle}).e <= x.s, named_struct('lo', {middle} + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {middle})), a)"
    first = f"aggregate(sequence(0, cast(ceil(log2(size({spans}) + 2)) as int)), named_struct('lo', 0, 'hi', size({spans})), (a, i) -> {step}, a -> a.lo)"
    return f"coalesce(get({spans}, {first}).s < x.e, false)"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs(doc_id, text).

    spans: structs of kind, s, e, score and base, by kind (email, ip, card, phone,
    iban, ssn, secret), then place.  The first four are the base kinds; a span of the others
    is taken if pattern, checksum and context give LEAST_SCORE, and where it overlaps
    no base span.  A null or empty text has no spans; repeated rows and null ids are
    passed through; an empty table gives no rows.  A long text takes time as its length
    does, and little more than its spans do.
    """
    # The marking character itself is no part of any kind: another of its sort stands in.
    clean = columns(docs, doc_id="long", text="string").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\x01", "\x02").alias("t"))
    cut = clean.select("doc_id", "t", *[F.expr(_pieces(k)).alias(f"c_{k.name}") for k in KINDS])
    none = " and ".join(f"size(c_{k.name}) < 2" for k in KINDS)
    blocks = F.expr(f"if({none}, cast(array() as array<string>), regexp_extract_all(t, '(?s).{{1,{BLOCK}}}', 0))").alias("blocks")
    placed = cut.select("doc_id", blocks, *[F.expr(_places(f"c_{k.name}")).alias(f"p_{k.name}") for k in KINDS])
    found = placed.select("doc_id", *[F.expr(_spans(k)).alias(f"s_{k.name}") for k in KINDS])
    bases = [f"s_{k.name}" for k in KINDS if k.base]
    apart = " or ".join(_overlaps(s) for s in bases)
    more = f"filter(concat({', '.join(f's_{k.name}' for k in KINDS if not k.base)}), x -> not ({apart}))"
    return found.select("doc_id", F.expr(f"concat({', '.join(bases)}, {more})").alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_pii's spans: the base kinds' counts, all spans' number, spans and scores."""
    listed = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k.name}')) as long)").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(F.expr(listed.format("filter(spans, x -> x.base)")), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.expr("array_join(transform(spans, x -> cast(x.score as decimal(3,2))), ',')").alias("scores"))
