import pytest

#: Nulls, empty and blank texts, a very long one, ties and a repeated row.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and then rests a while", "en", "a"),
    (2, "the quick  brown fox jumps over the lazy dog and then rests a while ", "en", "a"),
    (3, "", None, "b"), (4, None, "en", None), (5, " \t\n", "en", "b"), (6, "word", "en", "b"),
    (7, "x " * 60_000, "en", "a"), (None, "no id here at all", "en", "a"), (8, "same row", "de", "c"), (8, "same row", "de", "c"),
    (9, "mail a.b@c.org or +1 (555) 123-4567 and 10.0.0.1 with 4111 1111 1111 1111", "en", "a"),
]


#: Names that operators give to columns of their own.
CLASHES = (
    "print", "digest", "n", "key", "uid", "rank", "bucket", "position", "score", "lang_pred", "rejected", "_row", "row", "_id", "_sha", "id", "sha", "kept", "times", "_gone",
    "node", "root", "first", "file", "place", "part", "h", "r", "block", "round", "j", "md5", "w", "_source", "_j", "_0", "_meta", "_metadata", "piece", "length", "sequence_id", "t", "spans", "base",
)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with further columns whose names clash with those of results."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in CLASHES])


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
