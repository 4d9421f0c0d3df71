"""How often each key occurs at each level of the records, in objects and arrays of any depth."""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.paths import PathError, build
from ..sources.reader import ReadOptions, _prefix, split_records

MOST = 100_000  # different keys that a task holds before it hands its counts on
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]', re.S)


def walk(value, counts: Counter) -> None:
    """Count (key, level); a record's own keys have level 0, and each object or array around adds one."""
    waiting = [(value, 0)]
    while waiting:
        v, level = waiting.pop()
        if isinstance(v, dict):
            counts.update((k, level) for k in v)
            v = v.values()
        elif not isinstance(v, list):
            continue
        waiting += [(x, level + 1) for x in v]


def scan(text: str, counts: Counter) -> None:
    """As :func:`walk`, for texts nested deeper than the parser goes."""
    seen: list[set] = []
    for m in _TOKEN.finditer(text):
        if m[0] in "{[":
            seen.append(set())
        elif m[0] in "}]":
            seen.pop()
        elif m[2] and (k := json.loads(f'"{m[1]}"', strict=False)) not in seen[-1]:
            seen[-1].add(k)
            counts[k, len(seen) - 1] += 1


def _batch(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.record_batch([pa.array([k for k, _ in keys], pa.string()), pa.array([n for _, n in keys], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["key", "level", "n"])


def _run(batches):
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            try:
                walk(json.loads(text, strict=False), counts)
            except RecursionError:
                scan(text, counts)
            except ValueError:
                continue  # not JSON
        if len(counts) > MOST:
            yield _batch(counts)
            counts = Counter()
    yield _batch(counts)


def key_statistics(spark: SparkSession, path: str | list[str], json_path: str, **options) -> DataFrame:
    """``(key, level, n)`` over all records of all files; ``json_path`` names the records (``$``, ``$.a.b[*]``)."""
    o = ReadOptions(**options)
    keys, array, rest = _prefix(build(json_path))
    if rest:
        raise PathError(f"key statistics are of whole records, but {json_path!r} goes on below them")
    rows = split_records(spark, path, keys, array, o)
    return rows.select("text").mapInArrow(_run, "key string, level bigint, n bigint").groupBy("key", "level").agg(F.sum("n").alias("n"))
