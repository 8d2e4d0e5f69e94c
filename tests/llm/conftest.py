import pytest

from repoloom.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, kind int"


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame of (doc_id, text) pairs with extra columns whose names clash."""

    def make(rows, parts=5):
        full = [(i, t, None, None, None, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


def sample(spark, name="documents", scale="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{scale}/{name}.parquet")


ODD = [
    (9000, None),
    (9001, ""),
    (9002, " \n\t "),
    (9003, "one two"),
    (9003, "one two"),
    (9004, "One  TWO"),
    (9005, "é🙂ß日本語"),
    (9006, "word " * 6000),
    (9007, "x" * 40000),
    (9008, "a\u0000b c"),
    (None, "a row without an id"),
    (None, None),
]
