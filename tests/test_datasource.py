import gzip
import json

import pytest

from jsonweave.sources.datasource import register
from jsonweave.sources.reader import read_json_path

ROWS = [{"i": i, "v": v, "a.b": i % 3, "geometry": {"type": "Point", "coordinates": [i, i]}, "in": [{"x": i}, {"x": i + 1, "y": "t"}], "o": {"p": {"q": i}}} for i, v in enumerate([5, "5", "abc", True, None, 7.5, -1, "x", 12])]
PATHS = [
    "$.r[*].i", "$.r[(@.v < 6)].i", "$.r[(@.v == 5 || @.v == 'abc')].i", "$.r[(@.v)].i", "$.r[(@.v != null && ~(@.v in ['abc', 12]))].i", "$.r[(@['a.b'] > 1)].i", "$.r[*].in[(@.x > 3)].x", "$.r[*].in[0].x",
    "$.r[*]..q", "$.r[(@.geometry geometryWithin 'POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))')].i", "$.r[(@.geometry geometryType point)].o.p.q", "$.r[(@.v stringContains 'b')].i", "$.r[*].o(@.p != null).p.q",
]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    register(spark)
    path = tmp_path_factory.mktemp("source")
    (path / "a.json").write_text(json.dumps({"h": {"r": 1}, "r": ROWS[:6]}, indent=1))
    (path / "deep").mkdir()
    with gzip.open(path / "deep" / "b.json.gz", "wt") as f:
        json.dump({"r": ROWS[6:]}, f)
    return str(path)


@pytest.mark.parametrize("path", PATHS)
def test_format_gives_the_rows_of_the_engine(spark, source, path):
    got = spark.read.format("jsonpath").option("jsonPath", path).option("recursive", "true").load(source)
    want = read_json_path(spark, source, path, recursive=True)
    assert sorted(str(list(r)) for r in got.collect()) == sorted(str(list(r)) for r in want.collect())


def test_several_paths_schemas_and_globs(spark, source):
    read = spark.read.format("jsonpath").option("recursive", "true")
    got = read.option("jsonPath", "$.r[(@.i > 2)].i;$.r[*].o.p.q").load(source).collect()
    assert sorted((r["i"], r["o"]["p"]["q"]) for r in got) == [(i, i) for i in range(3, 9)]
    got = read.option("jsonPath", "$.r[*]").option("pathGlobFilter", "*.gz").schema("i bigint, v string, none double").load(source).collect()
    assert sorted(tuple(r) for r in got) == [(6, "-1", None), (7, "x", None), (8, "12", None)]
    assert spark.read.format("jsonpath").option("jsonPath", "$.r[*]").load(source).count() == 6


def test_sql_reaches_the_source(spark, source):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW jp USING jsonpath OPTIONS (path '{source}', jsonPath '$.r[*]', recursive 'true')")
    assert spark.sql("SELECT sum(i) FROM jp WHERE i > 4").head()[0] == 26
