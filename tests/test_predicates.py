import pytest
from pyspark.sql import functions as F

from jsonweave.functions.predicates import FilterError, attributes, parse_filter, register_operator, to_column

ROWS = [(1, "abc", True, None), (7, "xyz", None, 7), (None, None, False, 3)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "a bigint, s string, b boolean, c bigint")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("@.a > 0", [0, 1]), ("@.a >= 7 || @.c == 3", [1, 2]), ("@.a == null", [2]), ("@.a != 5", [0, 1, 2]),
        ("~(@.a > 5)", [0, 2]), ("~@.b && @.a != null", [1]), ("@.b", [0]), ("@.s in ['abc', \"q\"]", [0]),
        ("@.s stringContains b", [0]), ("@.s StringStartsWith \"x\"", [1]), ("@.s stringEndsWith 'z'", [1]),
        ("@.a == @.c", [1]), ("@.nothing == null && @.c < 5", [2]), ("(@.a < 3 || @.a > 6) && @.s != 'abc'", [1]),
        ("@.a == 1 || @.a == 7 && @.c == 0", [0]), ("@.s == 'a && b'", []), ("@.a > -1.5e0", [0, 1]),
    ],
)
def test_rows(df, text, want):
    columns = set(df.columns)
    c = to_column(parse_filter(text), lambda n: F.col(n[0]) if n[0] in columns else F.lit(None))
    got = df.select(c.alias("x")).collect()
    assert all(r["x"] is not None for r in got)
    assert [i for i, r in enumerate(got) if r["x"]] == want


def test_attributes_and_errors():
    assert attributes(parse_filter("@.a > 1 && ~(@.b == @.a)")) == [("a",), ("b",)]
    assert attributes(parse_filter("@['x.y'] == 1 || @.p[\"q's\"].r")) == [("x.y",), ("p", "q's", "r")]
    for bad in ("@.a >", "(@.a", "@.a == 1 )"):
        with pytest.raises(FilterError):
            parse_filter(bad)


def test_new_operator(df):
    register_operator("divides", lambda a, b, v: F.coalesce(b % a == 0, F.lit(False)))
    c = to_column(parse_filter("@.a divides 14"), lambda n: F.col(n[0]))
    assert [r[0] for r in df.select(c).collect()] == [True, True, False]


MIXED = [(5, "5", True, 5.0), (7, "abc", False, 7.5), (None, None, None, None), (9, "10", True, -1.0)]
KINDS = {"i": "bigint", "s": "string", "b": "boolean", "d": "double"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("@.s < 6", [0]), ("@.s == 5", [0]), ("@.s != 5", [1, 2, 3]), ("@.i == 'abc'", []), ("@.i != 'abc'", [0, 1, 2, 3]), ("@.i == '7'", [1]),
        ("@.i in ['x', 'y']", []), ("@.i in ['5', 9]", [0, 3]), ("@.s in [5, 'abc']", [0, 1]), ("@.s", []), ("@.s == true", []), ("@.b == 'true'", [0, 3]),
        ("@.b == 1", []), ("@.b != 1", [0, 1, 2, 3]), ("@.b > 0", []), ("@.i == true", []), ("@.i < 'abc'", []), ("@.s < 'b'", [1]), ("@.s > '6'", [3]),
        ("@.d == '7.5'", [1]), ("@.s == @.i", [0, 2]), ("@.i == @.s", [0, 2]), ("@.i < @.s", [3]), ("@.s > @.i", [3]), ("@.b == @.s", [2]), ("@.d in [7.5, 'q']", [1]), ("@.i <= 7.5", [0, 1]),
    ],
)
def test_sides_of_different_types(spark, text, want):
    from pyspark.sql import types as T

    df = spark.createDataFrame(MIXED, ", ".join(f"{k} {v}" for k, v in KINDS.items()))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    c = to_column(parse_filter(text), lambda n: F.col(n[0]), lambda n: kinds[n[0]])
    got = df.select(c.alias("x")).collect()
    assert all(isinstance(r["x"], bool) for r in got)
    assert [i for i, r in enumerate(got) if r["x"]] == want
    assert isinstance(kinds["i"], T.LongType)


def test_whole_numbers_are_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("9007199254740992",), ("7.5",)], "s string")
    c = to_column(parse_filter("@.s == 9007199254740993 || @.s == 7"), lambda n: F.col(n[0]), lambda n: df.schema["s"].dataType)
    assert [r[0] for r in df.select(c).collect()] == [True, False, False]
