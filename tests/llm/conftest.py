import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def word(i):
    return "".join(chr(97 + (i * 7 + k * k * 5 + i // (3 + k)) % 26) for k in range(3 + i % 5)) + str(i % 11)


def prose(start, n, sep=" "):
    return sep.join(word(start + k) for k in range(n))


P60 = prose(5000, 60)
HARD = [
    (10, prose(0, 120), "en", "a"), (11, prose(0, 120), "en", "a"), (11, prose(0, 120), "en", "a"), (12, prose(0, 118) + " X Y", "en", "b"),
    (13, prose(0, 60) + " " + prose(900, 60), "de", "b"), (3, None, None, None), (4, "", "en", None), (5, " \t\n\x0b\f\r ", None, "a"),
    (6, "one", "en", "a"), (7, "ONE", "en", "a"), (8, "a b c d", "en", "a"), (9, "A  b\nc\td", "de", "a"), (20, P60 + "\n" + prose(100, 30), "en", "a"),
    (21, prose(200, 30) + "\n" + P60, "fr", "a"), (22, P60, "fr", "c"), (None, P60 + " tail", "fr", "c"), (None, None, None, None), (23, "é à ü " * 40, "fr", "c"),
    (24, "x " * 3000, "en", "hot"), (25, "x " * 3000 + "y", "en", "hot"), (26, "!!! 123 ---", "en", "c"), (27, "a  b\n\n  c <|endoftext|> ▁ 😀", "en", "c"), (-1, prose(1, 119), "en", "c"),
    (28, prose(7000, 4000), "en", "long"), (30, "x#y $$ %%\nl1 a\nl1 a\n\nl1 a ", "en", "c"),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in HARD], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(hard):
    """Further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    out = hard
    for c in ("n", "key", "rep", "k", "h", "pack", "component", "uid", "bucket", "_q_n_words", "words", "o", "cls", "length", "block", "shard"):
        out = out.withColumn(c, F.lit("z"))
    return out
