"""Command line: ``python -m jsonweave.cli count|noop INPUT JSONPATH [STRATEGY] [SQL FILTER]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .sources.reader import read_json_path


def run(spark: SparkSession, action: str, source: str, json_path: str, strategy: str = "fullPass", sql_filter: str = "", **options) -> tuple[DataFrame, int | None]:
    builder = "start" if strategy == "speculation" else "fullPass"
    df = read_json_path(spark, source, json_path, partitioning=strategy, schema_builder=builder, **options)
    if sql_filter.strip():
        df = df.where(sql_filter)
    if action == "count":
        return df, df.count()
    df.write.format("noop").mode("overwrite").save()
    return df, None


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("action", choices=["count", "noop"])
    p.add_argument("source")
    p.add_argument("json_path")
    p.add_argument("strategy", nargs="?", default="fullPass", choices=["fullPass", "speculation", "whole"])
    p.add_argument("sql_filter", nargs="?", default="")
    p.add_argument("--extra-fields", action="store_true")
    p.add_argument("--keep-index", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("jsonweave").getOrCreate()
    _, n = run(spark, a.action, a.source, a.json_path, a.strategy, a.sql_filter, extra_fields=a.extra_fields, keep_index=a.keep_index)
    if n is not None:
        print(f"FOUND RECORDS: {n}")


if __name__ == "__main__":
    main()
