"""A streaming source of JSON Lines with a JSONPath query: the same compiler over ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.column_path import jsonpath


def stream_json_lines(spark: SparkSession, path: str, json_path: str, schema, **options) -> DataFrame:
    """A streaming DataFrame with a row for each match in each line of the files that arrive in ``path``."""
    reader = spark.readStream.format("text")
    for k, v in options.items():
        reader = reader.option(k, v)
    return jsonpath(reader.load(path), "value", json_path, schema, [])
