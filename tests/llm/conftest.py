import pytest

#: Columns of documents and two whose names operators also use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, fp string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Makes documents of (doc_id, text) pairs."""

    def make(rows, parts=2):
        full = [(i, t, "en", None, None if t is None else len(t), 1, "x") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd(corpus):
    """Nulls, empty and long texts, repeated rows, odd characters."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return corpus([(1, None), (None, "a null id has a text of its own"), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "solo"), (4, "solo"), (5, long), (6, "Ünïcode ß 中文 😀 <|endoftext|> x"), (7, "\n\n\n"), (None, None)])
