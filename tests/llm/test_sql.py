"""The queries that SQL can express against their SQL, over whole small tables."""

import duckdb
import pytest

from jsonweave.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracles()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.execute(sql.oracles()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in rel.fetchall())
