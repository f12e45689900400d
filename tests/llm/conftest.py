import pytest

LONG = "lorem ipsum dolor " * 30_000
#: doc_id, text, lang, source, n_chars and a column whose name clashes with those that operators add.
ODD = [
    (1, "alpha beta gamma delta epsilon", "en", "a", 1, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, "x"),
    (4, " \t\n ", "de", "", 4, "x"),
    (5, "alpha  beta\tgamma\ndelta epsilon", None, "b", 1, "y"),
    (6, "ALPHA beta gamma delta epsilon", "en", "a", 1, "x"),
    (6, "ALPHA beta gamma delta epsilon", "en", "a", 1, "x"),
    (7, LONG, "en", "b", len(LONG), "x"),
    (None, "no id here", "en", "a", 9, "x"),
    (9, "日本語 ñandú 😀 straße İstanbul", "ja", "c", 5, "x"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
