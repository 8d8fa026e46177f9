import pytest
from pyspark.sql import Row

LONG = "the quick brown fox jumps over the lazy dog and runs away " * 2_000


def words(n, salt=0):
    """Prose of ``n`` different words."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join("".join(letters[(i * 7 + salt * 3 + j * (i % 5 + 1)) % 26] for j in range(3 + i % 6)) + str(i) * (i % 9 == 0) for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, a repeated row, and columns named like inner ones."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (6, words(60)), (6, words(60)), (7, words(60)), (None, words(60)), (None, None), (8, "Ünï © ▁ 😀 \x00 \x1f   x")]
    rows = [Row(doc_id=i, text=t, lang=None, source="s", n_chars=None if t is None else len(t), n="clash", bucket=1, m=None, rep="r", base="b", terms=2, _once=1) for i, t in texts]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, bucket int, m string, rep string, base string, terms int, _once int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
