"""The engine's queries over fixtures made from the tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import geojson_to_wkt, wkt_to_geojson
from .operators.column_path import jsonpath
from .operators.key_statistics import key_statistics
from .operators.spatial_join import spatial_join
from .operators.time_join import as_of_join, interval_join
from .sources.fixtures import fixture
from .sources.reader import count_records, read_json_path
from .sources.shared import shared_dir, short
from .streaming.lines import stream_json_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
COLUMNS = ORDER.split(", ")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _read(spark, sf, source, path, **options) -> DataFrame:
    return read_json_path(spark, fixture(spark, sf, source), path, **options)


def _orders_filter(name: str, condition: str, where: str, columns=COLUMNS) -> None:
    sql = f"SELECT {', '.join(columns)} FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice > 150000 END AS big FROM orders) WHERE {where}"
    QUERIES[name] = lambda spark, sf: _read(spark, sf, "orders_doc", f"$.orders[({condition})]").select(*columns)
    SQL[name] = sql


_orders_filter("path_array_rows", "*", "true")
_orders_filter("path_filter_gt", "@.o_totalprice > 100000", "o_totalprice > 100000")
_orders_filter("path_filter_and_or", '(@.o_totalprice > 100000 && @.o_orderstatus == "F") || @.o_custkey < 10', "(o_totalprice > 100000 AND o_orderstatus = 'F') OR o_custkey < 10")
_orders_filter("path_filter_not", '~(@.o_orderstatus == "F") && ~(@.o_custkey > 50)', "NOT o_orderstatus = 'F' AND NOT o_custkey > 50")
_orders_filter("path_filter_eq_string", "@.o_orderstatus == 'O'", "o_orderstatus = 'O'")
_orders_filter("path_filter_eq_bare_word", "@.o_orderstatus == O", "o_orderstatus = 'O'")
_orders_filter("path_filter_ne_missing", "@.nothing != 5 && @.o_custkey != 7", "o_custkey <> 7")
_orders_filter("path_filter_le_ge_lt", "@.o_totalprice <= 200000.5 && @.o_totalprice >= 50000 && @.o_custkey < 100", "o_totalprice <= 200000.5 AND o_totalprice >= 50000 AND o_custkey < 100")
_orders_filter("path_filter_in", '@.o_orderstatus in ["F", "P"]', "o_orderstatus IN ('F', 'P')")
_orders_filter("path_filter_contains", '@.o_orderpriority stringContains "E"', "contains(o_orderpriority, 'E')")
_orders_filter("path_filter_starts", "@.o_orderpriority StringStartsWith \"1\"", "starts_with(o_orderpriority, '1')")
_orders_filter("path_filter_ends", '@.o_orderpriority stringEndsWith "W"', "ends_with(o_orderpriority, 'W')")
_orders_filter("path_filter_null", "@.big == null", "big IS NULL")
_orders_filter("path_filter_exists", "@.big != null", "big IS NOT NULL")
_orders_filter("path_filter_boolean", "@.big", "coalesce(big, false)")
_orders_filter("path_filter_attr_attr", "@.o_orderkey < @.o_custkey", "o_orderkey < o_custkey")
_orders_filter("path_filter_double_brackets", "(@.o_custkey == 5)", "o_custkey = 5")


@_query("path_nested_scalar", "SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", "$.orders[*].lineitems[*].l_partkey")


@_query("path_nested_array_filter", "SELECT l_partkey, l_quantity, l_linenumber::BIGINT AS l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND o_totalprice > 50000")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", "$.orders[?(@.o_totalprice > 50000)].lineitems[(@.l_quantity > 45)]").select("l_partkey", "l_quantity", "l_linenumber")


@_query("path_array_value", "SELECT count(*)::BIGINT AS n, sum(l_partkey)::BIGINT AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    got = _read(spark, sf, "orders_doc", "$.orders[*].lineitems")
    return got.select(F.size("lineitems").cast("bigint").alias("n"), F.aggregate("lineitems", F.lit(0).cast("bigint"), lambda a, x: a + x["l_partkey"]).alias("s"))


@_query("multi_path", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    got = _read(spark, sf, "orders_doc", "$.orders[*].o_orderkey; $.orders[*].customer.c_name")
    return got.select("o_orderkey", F.col("customer.c_name").alias("c_name"))


@_query("multi_path_filtered", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND o_custkey < 100")
def _(spark, sf):
    got = _read(spark, sf, "orders_doc", '$.orders[(@.o_totalprice > 100000)].o_orderkey;$.orders[(@.o_custkey < 100)].customer(@.c_mktsegment == "BUILDING").c_name')
    return got.select("o_orderkey", F.col("customer.c_name").alias("c_name"))


@_query("object_filter_rows", "SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", '$.orders[*].customer((@.c_mktsegment == "BUILDING")).c_name')


@_query("descendant_scalar", "SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", "$.orders[*]..c_name")


@_query("descendant_array", "SELECT o_orderkey, count(*)::BIGINT AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    got = _read(spark, sf, "orders_doc", "$.orders[*].o_orderkey;$.orders[*]..l_quantity").where(F.size("l_quantity") > 0)
    return got.select("o_orderkey", F.size("l_quantity").cast("bigint").alias("n"), F.aggregate("l_quantity", F.lit(0.0), lambda a, x: a + x).alias("q"))


@_query("descendant_unknown_keys", "SELECT 'S' || p_partkey AS code, p_name AS short, (CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 10 + 1 > 5)::INT + (p_partkey % 10 + 2 > 5)::INT + (p_partkey % 10 + 3 > 5)::INT ELSE (p_partkey % 10 + 1 > 5)::INT END)::BIGINT AS n FROM part")
def _(spark, sf):
    got = _read(spark, sf, "catalogue", "[*].code;[*].title.short;[*].trials..trial(@.grade > 5)", schema_builder="fullPass")
    return got.select("code", F.col("title.short").alias("short"), F.size("trials").cast("bigint").alias("n"))


_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


@_query("root_array", _CUSTOMERS + " WHERE c_custkey % 3 = 0")
def _(spark, sf):
    return read_json_path(spark, fixture(spark, sf, "customers_dir") + "/part=0", "$[*]").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@_query("directory_recursive", _CUSTOMERS)
def _(spark, sf):
    return _read(spark, sf, "customers_dir", "$.[*]", recursive=True, path_glob_filter="*.txt").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@_query("directory_glob", _CUSTOMERS + " WHERE c_custkey % 3 IN (0, 1)")
def _(spark, sf):
    return read_json_path(spark, fixture(spark, sf, "customers_dir") + "/part=[01]/*.txt", "[*]").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@_query("json_lines", f"SELECT {ORDER} FROM orders")
def _(spark, sf):
    return _read(spark, sf, "orders_jsonl", "$").select(*COLUMNS)


@_query("whole_document", f"SELECT {ORDER} FROM orders WHERE o_custkey < 20")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", "$.orders[(@.o_custkey < 20)]", partitioning="whole").select(*COLUMNS)


@_query("scalar_of_document", "SELECT false AS partial")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", "$.partial")


@_query("column_path", "SELECT event_id, k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k > 10")
def _(spark, sf):
    return jsonpath(spark.read.parquet(f"{sf}/events.parquet"), "props", "$.k", "struct<k:bigint>", ["event_id"]).where("k > 10")


def _small_blocks(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    own.conf.set("spark.sql.files.openCostInBytes", "65536")
    return own


_DOCS = "SELECT doc_id, lang, sha256(text) AS digest FROM documents"


def _digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


@_query("split_exact", _DOCS)
def _(spark, sf):
    return _digests(read_json_path(_small_blocks(spark), fixture(spark, sf, "docs_doc"), "$.docs[*]"))


@_query("split_speculative", _DOCS)
def _(spark, sf):
    return _digests(read_json_path(_small_blocks(spark), fixture(spark, sf, "docs_doc"), "$.docs[*]", partitioning="speculation"))


_TYPES = {"a": "double", "b": "double", "c": "string", "d": "struct<e:bigint>", "f": "array<bigint>", "g": "string", "geometry": "string", "h": "string", "j": "bigint", "k": "boolean", "l": "array<struct<m:bigint,o:string>>", "n": "array<array<double>>"}
_TYPE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _TYPES.items()) + ") AS t(name, type)"


def _types(spark, sf, builder: str) -> DataFrame:
    got = _read(spark, sf, "types_doc", "$.rows[*]", schema_builder=builder)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in got.schema.fields], "name string, type string")


QUERIES["infer_start"], SQL["infer_start"] = lambda spark, sf: _types(spark, sf, "start"), _TYPE_SQL
QUERIES["infer_full"], SQL["infer_full"] = lambda spark, sf: _types(spark, sf, "fullPass"), _TYPE_SQL


@_query("coerced_values", f"SELECT * FROM (VALUES (1.0::DOUBLE, 'x', 1::BIGINT, 2::BIGINT), (2.5, '4', NULL, NULL)) AS t(a, c, e, f)")
def _(spark, sf):
    return _read(spark, sf, "types_doc", "$.rows[*]").select("a", "c", "d.e", F.when(F.size("f") >= 0, F.size("f").cast("bigint")).alias("f"))


@_query("user_schema", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", "$.orders[*]", schema="struct<o_orderkey:bigint,o_totalprice:double>")


@_query("extra_fields", "SELECT o_orderkey, o_orderstatus AS status FROM orders")
def _(spark, sf):
    got = _read(spark, sf, "orders_doc", "$.orders[*]", schema="struct<o_orderkey:bigint,o_totalprice:double>", extra_fields=True)
    return got.select("o_orderkey", F.get_json_object("extra_fields", "$.o_orderstatus").alias("status"))


@_query("keep_index", "SELECT count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids, true AS gapless, true AS in_order FROM documents")
def _(spark, sf):
    """Indexes count from 1 without gaps in each block, in the order of the records."""
    got = read_json_path(_small_blocks(spark), fixture(spark, sf, "docs_doc"), "$.docs[*]", keep_index=True)
    own = F.col("partition_row_index")
    blocks = got.groupBy("partition_id").agg(
        F.count("*").alias("n"), F.sum("doc_id").alias("ids"), ((F.min(own) == 1) & (F.max(own) == F.count("*")) & (F.count_distinct(own) == F.count("*"))).alias("gapless"),
        F.array_sort(F.collect_list(F.struct(own, "doc_id")))["doc_id"].alias("found"),
    )
    return blocks.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.bool_and("gapless").alias("gapless"), F.bool_and(F.col("found") == F.array_sort("found")).alias("in_order"))


_PLACE = "SELECT c_custkey AS number, c_custkey % 20 AS x, c_custkey % 15 AS y, c_custkey % 4 AS kind FROM customer"


def _in_box(x0, x1, y0, y1) -> str:
    """Places of the sites (points, lines to the right, unit squares) within a box."""
    point = f"kind IN (1, 3) AND x > {x0} AND x < {x1} AND y > {y0} AND y < {y1}"
    line = f"kind = 0 AND x >= {x0} AND x + 1 <= {x1} AND y > {y0} AND y < {y1}"
    square = f"kind = 2 AND x >= {x0} AND x + 1 <= {x1} AND y >= {y0} AND y + 1 <= {y1}"
    return f"(({point}) OR ({line}) OR ({square}))"


_BOX = _in_box(2, 12, 3, 10)
_HOLE = "((kind IN (1, 3) AND x >= 5 AND x <= 8 AND y >= 5 AND y <= 8) OR (kind = 0 AND x < 8 AND x + 1 > 5 AND y >= 5 AND y <= 8) OR (kind = 2 AND x < 8 AND x + 1 > 5 AND y < 8 AND y + 1 > 5))"
_AREAS = "MULTIPOLYGON (((2 3, 12 3, 12 10, 2 10, 2 3), (5 5, 8 5, 8 8, 5 8, 5 5)), ((15 0, 18 0, 18 14, 15 14, 15 0)))"


@_query("geo_within", f"SELECT number FROM ({_PLACE}) WHERE {_BOX}")
def _(spark, sf):
    got = _read(spark, sf, "sites_doc", '$.survey.sites[(@.geometry geometryWithin "POLYGON ((2 3, 12 3, 12 10, 2 10, 2 3))")]')
    return got.select("info.number")


@_query("geo_within_polygons", f"SELECT number FROM ({_PLACE}) WHERE ({_BOX} AND NOT {_HOLE}) OR {_in_box(15, 18, 0, 14)}")
def _(spark, sf):
    """Points, lines and squares within two polygons, one with a hole."""
    return _read(spark, sf, "sites_doc", f'$.survey.sites[(@.geometry geometryWithin "{_AREAS}")].info.number')


@_query("geo_type", "SELECT c_custkey AS number FROM customer WHERE c_custkey % 4 = 0")
def _(spark, sf):
    return _read(spark, sf, "sites_doc", "$.survey.sites[(@.geometry geometryType linestring)].info.number")


@_query("geo_text", "SELECT c_custkey AS number, 'POINT (' || (c_custkey % 20) || ' ' || (c_custkey % 15) || ')' AS wkt FROM customer WHERE c_custkey % 2 = 1")
def _(spark, sf):
    """GeoJSON written as WKT, and that read again."""
    got = _read(spark, sf, "sites_doc", "$.survey.sites[(@.geometry geometryType point)]").select("info.number", geojson_to_wkt(F.col("geometry")).alias("wkt"))
    return got.select("number", geojson_to_wkt(wkt_to_geojson(F.col("wkt"))).alias("wkt"))


@_query("join_two_sources", f"SELECT number, state, p_name AS short FROM (SELECT *, CASE WHEN number % 3 = 0 THEN 'planned' ELSE 'built' END AS state FROM ({_PLACE})) JOIN part ON p_partkey = number % 50 WHERE {_BOX} AND state = 'built'")
def _(spark, sf):
    """Sites in an area, each with the good that it stocks."""
    sites = _read(spark, sf, "sites_doc", '$.survey.sites[(@.geometry geometryWithin "POLYGON ((2 3, 12 3, 12 10, 2 10, 2 3))")].info(@.state == "built")')
    goods = _read(spark, sf, "catalogue", "[*].code;[*].title.short")
    return sites.join(goods, F.col("stock") == F.col("code")).select("number", "state", "title.short")


@_query("join_spatial", f"SELECT number, 'west' AS area FROM ({_PLACE}) WHERE {_BOX} UNION ALL SELECT number, 'east' FROM ({_PLACE}) WHERE {_in_box(10, 18, 0, 14)}")
def _(spark, sf):
    """Sites with the areas that they are within; the two areas overlap."""
    areas = spark.createDataFrame([("west", "POLYGON ((2 3, 12 3, 12 10, 2 10, 2 3))"), ("east", "POLYGON ((10 0, 18 0, 18 14, 10 14, 10 0))"), ("none", None)], "area string, wkt string")
    sites = _read(spark, sf, "sites_doc", "$.survey.sites[*].info.number;$.survey.sites[*].geometry").select("info.number", "geometry")
    return spatial_join(sites, "geometry", areas, "wkt").select("number", "area")


@_query("path_filter_mixed_types", "SELECT o_orderkey AS n FROM orders WHERE (o_orderkey % 5 IN (0, 1) AND o_orderkey < 90) OR (o_orderkey % 5 = 2 AND o_orderkey = 7) OR (o_orderkey % 5 = 3 AND o_orderkey % 2 = 0)")
def _(spark, sf):
    """One attribute that is a number, a text that reads as one, another text, a boolean or an object."""
    return _read(spark, sf, "mixed_doc", "$['all.items'][(@.v < 90 || @.v in ['x7', 3] || @.v == true)].n")


@_query("path_dotted_key", 'SELECT o_orderkey AS n, (o_orderkey % 7)::BIGINT AS "a.b" FROM orders WHERE o_orderkey % 7 > 4 AND -o_orderkey < -10')
def _(spark, sf):
    return _read(spark, sf, "mixed_doc", "$['all.items'][(@['a.b'] > 4 && @.a.b < -10)]").select("n", "`a.b`")


_INFERRED = "SELECT * FROM (VALUES ('a', 'struct<b:bigint>'), ('a.b', 'bigint'), ('n', 'bigint'), ('v', 'struct<deep:bigint>'), {}) AS t(name, type)"


def _inferred(spark, sf, builder: str) -> DataFrame:
    got = _read(spark, sf, "mixed_doc", "$['all.items'][*]", schema_builder=builder)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in got.schema.fields], "name string, type string")


@_query("infer_start_of_table", _INFERRED.format("('wide', 'bigint')"))
def _(spark, sf):
    """Columns of the first 1000 records; what comes later isn't among them."""
    return _inferred(spark, sf, "start")


@_query("infer_whole_table", _INFERRED.format("('wide', 'string'), ('late', 'boolean')"))
def _(spark, sf):
    """Columns of all records, with a key and a wider type that first come after record 1000."""
    return _inferred(spark, sf, "fullPass")


@_query("index_step", "SELECT min(l_linenumber)::BIGINT AS l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def _(spark, sf):
    return _read(spark, sf, "orders_doc", "$.orders[*].lineitems[0].l_linenumber")


@_query("wildcard_step", "SELECT o_orderkey, 2::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    got = _read(spark, sf, "orders_doc", "$.orders[*].o_orderkey;$.orders[*].customer.*").where("customer is not null")
    return got.select("o_orderkey", F.size("customer").cast("bigint").alias("n"))


def _view(spark, sf) -> SparkSession:
    _read(spark, sf, "orders_doc", "$.orders[*]").createOrReplaceTempView("json_orders")
    return spark


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf: _view(spark, sf).sql(text)
    SQL[name] = oracle or text.replace("json_orders", "orders")


_sql("sql_filter", f"SELECT {ORDER} FROM json_orders WHERE o_totalprice > 150000 AND o_orderpriority LIKE '1%'")
_sql("agg_over_source", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS most, min(o_custkey) AS least FROM json_orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM json_orders GROUP BY o_orderstatus HAVING count(*) > 10")
_sql("window_over_source", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM json_orders", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::BIGINT AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
_sql("topk", "SELECT o_orderkey, o_totalprice FROM json_orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("set_operations", "(SELECT o_custkey FROM json_orders WHERE o_totalprice > 100000 INTERSECT SELECT o_custkey FROM json_orders WHERE o_orderstatus = 'F') EXCEPT SELECT o_custkey FROM json_orders WHERE o_orderstatus = 'P'")
_sql("union_all", "SELECT o_orderkey FROM json_orders WHERE o_custkey < 50 UNION ALL SELECT o_orderkey FROM json_orders WHERE o_custkey < 20")


def _with_table(name: str, table: str, text: str) -> None:
    def f(spark, sf):
        spark.read.parquet(f"{sf}/{table}.parquet").createOrReplaceTempView(f"own_{table}")
        return _view(spark, sf).sql(text)

    QUERIES[name], SQL[name] = f, text.replace("json_orders", "orders").replace(f"own_{table}", table)


_with_table("join_semi", "customer", "SELECT o_orderkey FROM json_orders WHERE EXISTS (SELECT 1 FROM own_customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
_with_table("join_anti", "customer", "SELECT c_custkey FROM own_customer WHERE NOT EXISTS (SELECT 1 FROM json_orders WHERE c_custkey = o_custkey AND o_totalprice > 200000)")
_with_table("join_left", "customer", "SELECT c_custkey, o_orderkey FROM own_customer LEFT JOIN json_orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_with_table("join_right", "customer", "SELECT c_custkey, o_orderkey FROM json_orders RIGHT JOIN own_customer ON c_custkey = o_custkey AND o_totalprice > 250000")
_with_table("join_theta", "nation", "SELECT n_nationkey, count(*) AS n FROM json_orders JOIN own_nation ON o_custkey < n_nationkey GROUP BY n_nationkey")
_with_table("join_cross", "region", "SELECT r_regionkey, o_orderkey FROM (SELECT o_orderkey FROM json_orders WHERE o_custkey < 5) CROSS JOIN own_region")
_sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM json_orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, sum(o_custkey) AS s FROM json_orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("agg_statistics", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS dev, percentile(o_totalprice, 0.5) AS median FROM json_orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS dev, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY o_orderstatus")
_sql("functions_date", "SELECT year(to_timestamp(o_orderdate)) AS y, quarter(to_timestamp(o_orderdate)) AS q, count(*) AS n, max(date_diff(to_date(to_timestamp(o_orderdate)), DATE'1992-01-01')) AS days FROM json_orders GROUP BY 1, 2", "SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, count(*) AS n, max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::INT AS days FROM orders GROUP BY 1, 2")
_sql("functions_math", "SELECT o_orderkey, floor(o_totalprice / 1000) AS f, abs(o_custkey - 70) AS a, o_orderkey % 7 AS m, round(sqrt(o_totalprice), 3) AS r FROM json_orders", "SELECT o_orderkey, floor(o_totalprice / 1000)::BIGINT AS f, abs(o_custkey - 70) AS a, o_orderkey % 7 AS m, round(sqrt(o_totalprice), 3) AS r FROM orders")
_sql("functions_text", "SELECT o_orderkey, upper(substr(o_orderpriority, 3)) AS u, length(o_orderpriority) AS l, replace(o_orderstatus, 'F', 'done') AS s, lpad(o_orderkey, 8, '0') AS p FROM json_orders", "SELECT o_orderkey, upper(substr(o_orderpriority, 3)) AS u, length(o_orderpriority)::INT AS l, replace(o_orderstatus, 'F', 'done') AS s, lpad(o_orderkey::VARCHAR, 8, '0') AS p FROM orders")


@_query("functions_map", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN NULL ELSE 'c_mktsegment,c_name' END AS keys, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    """An object of any keys as a map."""
    got = _read(spark, sf, "orders_doc", "$.orders[*]", schema="struct<o_orderkey:bigint,customer:map<string,string>>")
    return got.select("o_orderkey", F.array_join(F.array_sort(F.map_keys("customer")), ",").alias("keys"), F.try_element_at("customer", F.lit("c_mktsegment")).alias("segment"))


@_query("describe", "SELECT 'count' AS summary, count(*)::DOUBLE AS o_custkey, count(*)::DOUBLE AS o_totalprice FROM orders UNION ALL SELECT 'min', min(o_custkey), min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_custkey), max(o_totalprice) FROM orders")
def _(spark, sf):
    got = _read(spark, sf, "orders_doc", "$.orders[*]").describe("o_custkey", "o_totalprice")
    return got.where("summary in ('count', 'min', 'max')").select("summary", *(F.col(c).cast("double").alias(c) for c in ("o_custkey", "o_totalprice")))


def _events(spark, sf, kind: str) -> DataFrame:
    got = _read(spark, sf, "events_jsonl", "$", partitioning="speculation").where(F.col("event_type") == kind)
    return got.select("event_id", "user_id", F.to_timestamp("ts").alias("ts"))


@_query("join_as_of", "SELECT p.event_id, v.event_id AS right_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(spark, sf):
    """Each purchase with its user's last view before, over compressed JSON Lines."""
    return as_of_join(_events(spark, sf, "purchase"), _events(spark, sf, "view"), ["user_id"], "ts", "ts").select("event_id", "right_event_id")


@_query("join_as_of_within", "SELECT p.event_id, CASE WHEN v.ts >= p.ts - INTERVAL 2 DAY THEN v.event_id END AS right_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(spark, sf):
    return as_of_join(_events(spark, sf, "purchase"), _events(spark, sf, "view"), ["user_id"], "ts", "ts", "2 days").select("event_id", "right_event_id")


@_query("join_interval", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_totalprice >= c_acctbal * 20 AND o_totalprice < c_acctbal * 20 + 50")
def _(spark, sf):
    spans = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_acctbal") * 20).alias("lo"), (F.col("c_acctbal") * 20 + 50).alias("hi"))
    return interval_join(_read(spark, sf, "orders_doc", "$.orders[*]"), spans, "o_totalprice", "lo", "hi", 50).select("o_orderkey", "c_custkey")


@_query("compressed_json_lines", "SELECT event_id, user_id, event_type FROM events WHERE user_id < 5")
def _(spark, sf):
    return _read(spark, sf, "events_jsonl", "$").where("user_id < 5").select("event_id", "user_id", "event_type")

_with_table("join_full", "customer", "SELECT c_custkey, o_orderkey FROM own_customer FULL JOIN json_orders ON c_custkey = o_custkey AND o_totalprice > 200000")


@_query("count_only", "SELECT count(*)::BIGINT AS n FROM orders")
def _(spark, sf):
    n = count_records(spark, fixture(spark, sf, "orders_doc"), "$.orders[*]")
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"))


@_query("scaled_source", "SELECT count(*) * 4 AS n, (sum(round(o_totalprice)::BIGINT) * 4)::BIGINT AS s, (max(o_orderkey) + 1) * 4 - 1 AS last FROM orders")
def _(spark, sf):
    """The same records four times over under new keys in sequence."""
    got = _read(spark, sf, "scaled_doc", "$.orders[*]", partitioning="speculation")
    return got.agg(F.count_distinct("o_orderkey").alias("n"), F.sum(F.round("o_totalprice").cast("bigint")).alias("s"), F.max("o_orderkey").alias("last"))


@_query("parquet_sink", f"SELECT {ORDER} FROM orders WHERE o_totalprice > 200000")
def _(spark, sf):
    out = f"{shared_dir(spark)}/sink-{short(sf)}"
    _read(spark, sf, "orders_doc", "$.orders[(@.o_totalprice > 200000)]").select(*COLUMNS).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@_query("key_statistics", "SELECT 'c_name' AS key, 1::BIGINT AS level, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'o_orderkey', 0, count(*) FROM orders")
def _(spark, sf):
    """The rows of ``key_statistics_all`` that its SQL has."""
    return key_statistics(spark, fixture(spark, sf, "orders_doc"), "$.orders[*]").where("key in ('c_name', 'o_orderkey')")


_RECORD = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
_ITEM = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_KEYS = [
    *(f"SELECT '{c}' AS key, 0::BIGINT AS level, count({c})::BIGINT AS n FROM orders" for c in _RECORD),
    "SELECT 'big', 0, count(o_totalprice) FROM orders WHERE o_orderkey % 3 <> 0",
    "SELECT 'customer', 0, count(*) FROM orders JOIN customer ON o_custkey = c_custkey",
    "SELECT 'lineitems', 0, count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    *(f"SELECT '{c}', 1, count({c}) FROM orders JOIN customer ON o_custkey = c_custkey" for c in ("c_name", "c_mktsegment")),
    *(f"SELECT '{c}', 2, count({c}) FROM orders JOIN lineitem ON l_orderkey = o_orderkey" for c in _ITEM),
]


@_query("key_statistics_all", " UNION ALL ".join(_KEYS))
def _(spark, sf):
    """Occurrences of all keys by level, in objects and arrays of any depth."""
    return key_statistics(spark, fixture(spark, sf, "orders_doc"), "$.orders[*]")


@_query("stream_json_lines", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(spark, sf):
    base = f"{shared_dir(spark)}/stream-{short(sf)}"
    schema = "struct<o_orderkey:bigint,o_totalprice:double>"
    got = stream_json_lines(spark, fixture(spark, sf, "orders_jsonl"), "$", schema).where("o_totalprice > 100000")
    run = f"{base}/{uuid.uuid4().hex}"
    got.writeStream.format("parquet").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start(f"{run}/out").awaitTermination()
    return spark.read.schema("o_orderkey bigint, o_totalprice double").parquet(f"{run}/out")


@_query("stream_windowed", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    """Hourly counts over a stream of JSON Lines; each batch's changed counts are written, the last of each hour holds."""
    run = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    stream = stream_json_lines(spark, fixture(spark, sf, "events_jsonl"), "$", "struct<ts:string,event_type:string>").withColumn("ts", F.to_timestamp("ts"))
    counts = stream.withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, i: int) -> None:
        batch.select("event_type", F.col("w.start").alias("hour"), "n", F.lit(i).alias("batch")).write.mode("overwrite").parquet(f"{run}/out/batch={i}")

    counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("event_type string, hour timestamp, n bigint, batch int").parquet(f"{run}/out")
    last = got.groupBy("event_type", "hour").agg(F.max_by("n", "batch").alias("n"))
    return last.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
