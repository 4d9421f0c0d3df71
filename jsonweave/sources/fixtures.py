"""JSON documents of the shapes the engine is for, built from the Parquet tables (tests and queries)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, shared_dir, short


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)


def _document(rows: DataFrame, head: str, foot: str) -> DataFrame:
    """(k, json) rows -> lines of one document, in order of k."""
    least = rows.agg(F.min("k")).head()[0]
    lines = rows.select("k", F.lit(1).alias("o"), F.concat(F.when(F.col("k") == least, "").otherwise(","), "json").alias("value"))
    spark = rows.sparkSession
    ends = spark.range(2).select(F.lit(0).cast("bigint").alias("k"), F.when(F.col("id") == 0, 0).otherwise(2).alias("o"), F.when(F.col("id") == 0, head).otherwise(foot).alias("value"))
    return lines.unionByName(ends).orderBy("o", "k").select("value")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    items = t("lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", _stamp("l_shipdate")))).alias("lineitems")
    )
    customer = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.struct("c_name", "c_mktsegment").alias("customer"))
    big = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 150000).alias("big")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", _stamp("o_orderdate"), "o_orderpriority", big)
    rows = orders.join(items, orders.o_orderkey == items.l_orderkey, "left").drop("l_orderkey").join(customer, "o_custkey", "left")
    return rows.select(F.col("o_orderkey").alias("k"), F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def orders_doc(spark, sf, path):
    _document(_orders(spark, sf), '{"total": 1, "source": "a {test} [of] \\"brackets\\"", "partial": false, "orders": [', "]}").coalesce(1).write.mode("overwrite").text(path)


def orders_jsonl(spark, sf, path):
    _orders(spark, sf).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


TIMES = 4


def scaled_doc(spark, sf, path):
    """The orders TIMES times over, with new keys in sequence, in one document that begins as the plain one."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    n = o.agg(F.max("o_orderkey")).head()[0] + 1
    rows = o.crossJoin(spark.range(TIMES)).withColumn("o_orderkey", F.col("o_orderkey") + F.col("id") * n).drop("id")
    rows = rows.select(F.col("o_orderkey").alias("k"), F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice")).alias("json"))
    _document(rows, '{"total": 1, "partial": false, "orders": [', "]}").coalesce(1).write.mode("overwrite").text(path)


def customers_dir(spark, sf, path):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    for i in range(3):
        rows = c.where(F.col("c_custkey") % 3 == i).select(F.col("c_custkey").alias("k"), F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment")).alias("json"))
        _document(rows, "[", "]").coalesce(1).write.mode("overwrite").text(f"{path}/part={i}")


def sites_doc(spark, sf, path):
    """A survey of sites: points, lines and squares, one a customer."""
    k = F.col("c_custkey")
    x, y = (k % 20).cast("double"), (k % 15).cast("double")
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(x, y), F.array(x + 1, y)).alias("coordinates"))
    ring = F.array(*(F.array(a, b) for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))))
    area = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    geometry = F.when(k % 4 == 0, F.to_json(line)).when(k % 4 == 2, F.to_json(area)).otherwise(F.to_json(point))
    info = F.to_json(F.struct(k.alias("number"), F.concat(F.lit("S"), k % 50).alias("stock"), F.when(k % 3 == 0, "planned").otherwise("built").alias("state")))
    value = F.concat(F.lit('{"geometry":'), geometry, F.lit(',"info":'), info, F.lit("}"))
    c = spark.read.parquet(f"{sf}/customer.parquet")
    _document(c.select(k.alias("k"), value.alias("json")), '{"survey":{"year":2024,"sites":[', "]}}").coalesce(1).write.mode("overwrite").text(path)


def catalogue(spark, sf, path):
    """A root array of goods, whose trials stand under keys that differ."""
    p, k = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_partkey")
    trial = lambda i: F.struct(F.struct((k % 10 + i).alias("grade"), F.when(k % 2 == 0, "weighed").otherwise("seen").alias("how")).alias("trial"))
    trials = F.when(k % 3 == 0, F.to_json(F.struct(F.array(trial(1), trial(2)).alias("first"), F.array(trial(3)).alias("last")))).otherwise(F.to_json(F.struct(F.array(trial(1)).alias("last"))))
    head = F.to_json(F.struct(F.concat(F.lit("S"), k).alias("code"), F.struct(F.col("p_name").alias("short")).alias("title")))
    value = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"trials":'), F.col("c"), F.lit("}"))
    rows = p.select(k.alias("k"), head.alias("h"), trials.alias("c")).select("k", value.alias("json"))
    _document(rows, "[", "]").coalesce(1).write.mode("overwrite").text(path)


def mixed_doc(spark, sf, path):
    """Values of a different type in each fifth record, keys with dots, and a type and a key that come late."""
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(k % 5 == 2, F.concat(F.lit('"x'), k, F.lit('"')))
    value = value.when(k % 5 == 3, (k % 2 == 0).cast("string")).otherwise('{"deep":1}')
    late = F.when(k >= 1200, F.concat(F.lit(',"late":true,"wide":"w'), k, F.lit('"'))).otherwise(F.concat(F.lit(',"wide":'), k))
    json_ = F.concat(F.lit('{"n":'), k, F.lit(',"v":'), value, F.lit(',"a.b":'), k % 7, F.lit(',"a":{"b":'), -k, F.lit("}"), late, F.lit("}"))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    _document(o.select(k.alias("k"), json_.alias("json")), '{"all.items":[', "]}").coalesce(1).write.mode("overwrite").text(path)


def events_jsonl(spark, sf, path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")
    e.select(F.to_json(F.struct("event_id", time, "user_id", "event_type", "value")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def docs_doc(spark, sf, path):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.select(F.col("doc_id").alias("k"), F.to_json(F.struct("doc_id", "lang", "text")).alias("json"))
    _document(rows, '{"docs":[', "]}").coalesce(1).write.mode("overwrite").text(path)


TYPES = [
    {"a": 1, "b": 1.5, "c": "x", "d": {"e": 1}, "f": [1, 2], "g": None, "h": "", "i": [], "j": -5, "k": True, "l": [1, {"m": 1}], "n": [[1], [2.5]]},
    {"a": 2.5, "b": -3, "c": 4, "d": 7, "f": 3, "g": None, "h": "", "i": [], "j": -6, "k": False, "l": [{"o": "y"}], "n": [[3]], "geometry": {"type": "Point", "coordinates": [1, 2]}},
]


def types_doc(spark, sf, path):
    spark.range(1).select(F.lit(json.dumps({"rows": TYPES})).alias("value")).coalesce(1).write.mode("overwrite").text(path)


BUILDERS: dict[str, Callable] = {f.__name__: f for f in (orders_doc, orders_jsonl, scaled_doc, customers_dir, sites_doc, catalogue, mixed_doc, events_jsonl, docs_doc, types_doc)}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Path of a fixture, built when it is first asked for."""
    path = f"{shared_dir(spark)}/fixtures-{short(sf_dir)}/{name}"
    if not exists(spark, f"{path}/.done"):
        BUILDERS[name](spark, sf_dir, path)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.done")
        fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path).close()
    return path
