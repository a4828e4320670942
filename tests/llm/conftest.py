import pytest

#: Nulls, an empty and a blank text, ties, repeated rows and ids, and a text far longer than the others.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (2, "another text under a repeated id"),
    (3, ""),
    (4, None),
    (None, "a text without an id"),
    (5, " \t\n "),
    (6, "word " * 60_000 + "end"),
    (7, "Ünïcödé 𝒳 text with odd blanks #*$%&|<>"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with odd rows and extra columns whose names the operators also use inside."""
    rows = [(i, t, "en", None if i == 3 else "s", len(t or ""), "x", 1.5, [1]) for i, t in ODD]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, "
        "_findings string, score double, _row array<int>"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


def write_tables(folder, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
