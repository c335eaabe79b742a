import pytest


@pytest.fixture
def make(spark):
    """A documents-like table with two columns whose names clash with those that operators use inside."""

    def table(texts, ids=None, parts=3):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, k, "x", k * 1.5) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, n long, k1 string, unit double").repartition(parts)

    return table


@pytest.fixture(scope="session")
def words():
    """Random words: ``words(seed, n)``."""
    import random

    def some(seed, n):
        r = random.Random(seed)
        return [r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("klmnrst") + r.choice("aeiouy") + r.choice(["", "s", "nd", "ter"]) for _ in range(n)]

    return some
