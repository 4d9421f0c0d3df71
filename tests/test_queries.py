import math

import duckdb
import pytest

from jsonweave import cli, queries

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, db, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(_key(r[c]) for c in columns) for r in df.collect())
    rel = db.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(_key(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_command_line(spark, sf):
    source = queries.fixture(spark, sf, "orders_doc")
    assert cli.run(spark, "count", source, "$.orders[*]", "speculation", "o_custkey < 0")[1] == 0
    df, n = cli.run(spark, "count", source, "$.orders[*]", "fullPass", "")
    assert n == df.count() > 0
    assert cli.run(spark, "noop", source, "$.orders[*].o_orderkey")[1] is None


def test_scans_prune_columns(spark, sf):
    df = queries._read(spark, sf, "orders_doc", "$.orders[(@.o_totalprice > 1)]").select("o_orderkey")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderpriority" not in plan  # from_json reads what is asked for
