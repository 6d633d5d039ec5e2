import pytest

from parcelspark.functions.shipping import ship

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    return ship(spark)


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 9973}" for i in range(n))


#: Null and empty texts, white space only, one word, a very long text, exact and near copies, repeated rows, null keys.
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b ", "en", None, 5),
    (4, "word", None, "b", 4),
    (5, words(20_000, 5), "de", "b", 1),
    (6, words(300, 6), "en", "a", 1),
    (7, words(300, 6), "en", "c", 1),
    (8, words(300, 6) + " tail", "en", "a", 1),
    (9, words(120, 9) + "\nsame line here\nsame line here\nÄÖ ß 漢字 🙂 <b> $$", "en", "a", 1),
    (9, words(120, 9) + "\nsame line here\nsame line here\nÄÖ ß 漢字 🙂 <b> $$", "en", "a", 1),
    (None, "no key at all", "en", "a", 1),
    (11, "one two three four", "en", "a", 1),
    (12, "ONE two three\tfour", "en", "a", 1),
    (13, "a b c " * 40, "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd_docs(shipped):
    return shipped.createDataFrame(ROWS, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(shipped):
    return shipped.createDataFrame([], DOCUMENTS)


#: Extra columns whose names clash with those that operators use inside.
CLASHES = ("key", "size", "cell", "shard", "hash", "n", "score", "a", "b", "rep", "value", "src", "start", "block", "curve", "label", "host", "words")


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    from pyspark.sql import functions as F

    return odd_docs.select("*", *(F.lit("x").alias(c) for c in CLASHES))
