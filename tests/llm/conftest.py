import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with columns the operators might clash with."""

    def make(rows, **more):
        columns = ["doc_id", "text", "lang", "source", "n_words", "id", "print", "words", "ids"]
        full = [
            (i, t, more.get("lang", "en"), f"s{k % 3}" if more.get("source") is None else more["source"], 7, "x", 1, "w", 2)
            for k, (i, t) in enumerate(rows)
        ]
        schema = "doc_id long, text string, lang string, source string, n_words int, id string, print int, words string, ids int"
        df = spark.createDataFrame(full, schema)
        assert df.columns == columns
        return df

    return make


#: Nulls, empty texts, white space, repeated rows, ids with two texts, a long text.
ODD = [
    (None, "a b c"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two three"),
    (4, "one two three"),
    (4, "another text"),
    (5, "wörd " * 30_000),
]


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture
def many_parts(spark):
    """Shuffles keep all their partitions, however small."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)
