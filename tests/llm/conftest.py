import pytest

#: Columns that operators use inside, as extra columns of the input.
CLASHES = ["fp", "node", "component_id", "score", "ids", "spans", "key", "version", "gone", "words", "lines", "_gone", "_id", "n_words"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s0"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "s0"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "s0"),
        (3, None, None, None),
        (4, "", "en", "s1"),
        (5, " \n\t ", None, "s1"),
        (None, "a row without an id", "de", "s1"),
        (6, "word " * 60_000, "fr", "s0"),
        (7, "é" * 5000 + "\x00  \x85 x", "es", "s2"),
        (8, "one", "en", "s2"),
        (9, "Licensed under the Apache License, Version 2.0.", "en", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({"n_chars": F.length("text").cast("long")} | {c: F.lit("clash") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
