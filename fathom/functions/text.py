"""Text analysis as SQL expressions: chunks, tokens, stop words and stems.

The expressions are written so that Spark and other SQL engines read them alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English stop words.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")

#: Suffixes in the order in which they are tried, and what replaces each;
#: None: nothing does, and a doubled consonant at the new end loses one letter.
SUFFIXES = (
    ("ization", ""), ("ational", ""), ("fulness", ""), ("ousness", ""), ("iveness", ""),
    ("ingly", ""), ("edly", ""), ("ments", ""), ("ment", ""), ("ness", ""), ("able", ""), ("ible", ""),
    ("ing", None), ("ers", None), ("ies", "y"), ("ied", "y"), ("ed", None), ("ly", None),
)

MIN_TOKEN = 2
_WORD = re.compile("[a-z0-9]+")
WINDOW = 100


def stem_sql(t: str) -> str:
    """The rule stemmer over the SQL expression t, from SUFFIXES.

    Suffixes are tried by the word's last letter, so that few are; among those of one
    letter their order stands.
    """
    by_last: dict[str, list[str]] = {}
    for suffix, instead in SUFFIXES:
        n = len(suffix)
        base = f"left({t}, length({t}) - {n})"
        if instead is None:
            last, before = f"left(right({t}, {n + 1}), 1)", f"left(right({t}, {n + 2}), 1)"
            out = f"CASE WHEN {last} = {before} AND {last} NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({t}, length({t}) - {n + 1}) ELSE {base} END"
        else:
            out = f"concat({base}, '{instead}')" if instead else base
        by_last.setdefault(suffix[-1], []).append(f"WHEN {t} LIKE '%{suffix}' AND length({t}) > {n + 2} THEN {out}")
    by_last["s"].append(f"WHEN NOT {t} LIKE '%ss' AND length({t}) > 3 THEN left({t}, length({t}) - 1)")
    return "CASE " + " ".join(f"WHEN {t} LIKE '%{c}' THEN CASE {' '.join(whens)} ELSE {t} END" for c, whens in by_last.items()) + f" ELSE {t} END"


def stem_rule(t: str) -> str:
    """The rule stemmer over one word; stem_sql says the same in SQL."""
    for suffix, instead in SUFFIXES:
        if t.endswith(suffix) and len(t) > len(suffix) + 2:
            base = t[: -len(suffix)]
            if instead is not None:
                return base + instead
            return base[:-1] if base[-1] == base[-2] and base[-1] not in "aeiou" else base
    return t[:-1] if t.endswith("s") and not t.endswith("ss") and len(t) > 3 else t


def stop_sql(t: str) -> str:
    return f"{t} IN ({', '.join(f"'{w}'" for w in STOPWORDS)})"


def with_chunks(df: DataFrame, text: str, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns of keep and `chunks`, an array: paragraphs, or a lone one's windows of words.

    A lone paragraph of up to `window` words stays as it is; text without a paragraph
    is one chunk, untouched.  Each step is a column of its own, so that nothing is
    computed twice; windows are cut by one pass of a pattern.
    """
    trimmed = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\n\x0b\f\r"))), lambda p: p != "")
    steps = df.select(*keep, F.col(text).alias("_text"), trimmed.alias("_ps"))
    cut = F.regexp_extract_all(F.col("_ps")[0], F.lit(rf"(?:\S++\s++){{0,{window - 1}}}\S++"), 0)
    steps = steps.select(*keep, "_text", "_ps", F.when(F.size("_ps") == 1, cut).alias("_ws"))
    windows = F.transform("_ws", lambda w: F.regexp_replace(w, r"\s+", " "))
    chunks = F.when(F.size("_ps") == 0, F.array("_text")).when((F.size("_ps") > 1) | (F.size("_ws") <= 1), F.col("_ps")).otherwise(windows)
    return steps.select(*keep, chunks.alias("chunks"))


_SPACE = " \t\n\x0b\f\r"
_PARAGRAPHS, _GAPS = re.compile(rf"\n[{_SPACE}]*\n"), re.compile(f"[{_SPACE}]+")


def cut(text: str, window: int = WINDOW) -> list[str]:
    """The chunks of one text; with_chunks says the same in SQL."""
    found = [p for p in (x.strip(_SPACE) for x in _PARAGRAPHS.split(text)) if p]
    if len(found) != 1:
        return found or [text]
    words = _GAPS.split(found[0])
    return found if len(words) <= window else [" ".join(words[i : i + window]) for i in range(0, len(words), window)]


def tokens_of(text: Column) -> Column:
    """Runs of a-z and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read as fewer partitions: one small file, say.

    Spark deals the rows by size, so that a task's share doesn't grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.hint("rebalance", 4 * cores) if df.rdd.getNumPartitions() < cores else df


#: Parts for each partition that a table is read as, or for each core, where its terms are kept.
PARTS = 4


def spread_to_keep(df: DataFrame) -> DataFrame:
    """df over PARTS times the partitions that it is read as, and over all cores, for terms that are kept.

    One task reads a kept partition whole, and kept terms take about four times the bytes
    of the files that their texts come from.  Spark bounds what it reads as one partition,
    so a part's share doesn't grow with the table.
    """
    return df.repartition(PARTS * max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


@dataclass(frozen=True)
class Words:
    """A stemmer by its name, and stop words of one's own: a longer list, or another language's."""

    stemmer: str = "rule"
    stopwords: frozenset[str] = frozenset(STOPWORDS)


#: A stemmer by its name, one with stop words, or any function from the column of tokens to that of terms.
Analyzer = str | Words | Callable[[Column], Column]


def name_of(analyzer: Analyzer) -> str:
    """A name for derived tables, another one for other stop words."""
    if isinstance(analyzer, Words):
        return f"{analyzer.stemmer}-{zlib.crc32(' '.join(sorted(analyzer.stopwords)).encode()):08x}"
    return analyzer if isinstance(analyzer, str) else analyzer.__name__


def _words(analyzer: Analyzer) -> Words:
    return Words(analyzer) if isinstance(analyzer, str) else analyzer if isinstance(analyzer, Words) else Words()


def stemmer(analyzer: str) -> Callable[[str], str]:
    """The stemmer of that name, over one word."""
    if analyzer == "rule":
        return stem_rule
    if analyzer == "porter2":
        from .porter2 import stem

        return stem
    raise ValueError(f"unknown analyzer: {analyzer}")


def words_of(text: str) -> list[str]:
    """tokens_of, over one text."""
    return _WORD.findall(text.lower())


class Counted:
    """Counts of terms in texts; a word is stemmed once, as long as few enough are known."""

    KNOWN = 200_000

    def __init__(self, analyzer: str | Words):
        self.stem, self.stopwords, self.known = stemmer(_words(analyzer).stemmer), _words(analyzer).stopwords, {}

    def term(self, word: str) -> str:
        found = "" if len(word) < MIN_TOKEN or word in self.stopwords else self.stem(word)
        return "" if found in self.stopwords else found

    def of(self, word: str) -> str:
        """The word's term, or an empty text for what is none."""
        if (term := self.known.get(word)) is None:
            if len(self.known) > self.KNOWN:
                self.known.clear()
            term = self.known[word] = self.term(word)
        return term

    def __call__(self, text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for word, n in Counter(words_of(text)).items():
            if term := self.of(word):
                out[term] = out.get(term, 0) + n
        return out


def terms(df: DataFrame, text: str, keep: list[str], analyzer: Analyzer = "rule") -> DataFrame:
    """One row for each term of a text, stemmed and without stop words: the columns of keep, and term."""
    words = df.select(*keep, F.explode(tokens_of(F.col(text))).alias("token"))
    stopwords = sorted(_words(analyzer).stopwords)
    words = words.filter((F.length("token") >= MIN_TOKEN) & ~F.col("token").isin(*stopwords))
    if callable(analyzer):
        stemmed = words.withColumn("term", analyzer(F.col("token")))
    elif _words(analyzer).stemmer == "rule":
        stemmed = words.withColumn("term", F.expr(stem_sql("token")))
    elif _words(analyzer).stemmer == "porter2":
        from .porter2 import stem_column

        stemmed = words.withColumn("term", stem_column(F.col("token")))
    else:
        raise ValueError(f"unknown analyzer: {analyzer}")
    return stemmed.filter(~F.col("term").isin("", *stopwords)).select(*keep, "term")


def flattened(text: Column) -> Column:
    """White space runs as one space, backslashes as spaces, double quotes as single ones."""
    return F.trim(F.regexp_replace(F.translate(text, '\\"', " '"), r"\s+", " "))
