"""Types of JSON values, their merge, and the Spark schema they give.

Types are plain values, so partial results travel as JSON: ``null long double bool str geo``, or
``{"obj": {key: type}}``, or ``{"arr": type}``. Merging is associative and commutative: null gives way;
long and double are double; objects win over all else, arrays over scalars; other mixtures are str.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import types as T

SCALARS = {"long": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType()}


def type_of(value, key: str | None = None):
    if value is None or value == "":
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "long" if -(2**63) <= value < 2**63 else "double"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "str"
    if isinstance(value, list):
        return {"arr": reduce(merge, (type_of(v) for v in value), "null")}
    if key == "geometry" and "coordinates" in value:
        return "geo"
    return {"obj": {k: type_of(v, k) for k, v in value.items()}}


def merge(a, b):
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    for kind in ("obj", "arr"):
        x, y = (t.get(kind) if isinstance(t, dict) else None for t in (a, b))
        if x is not None and y is not None:
            return {"obj": {k: merge(x.get(k, "null"), y.get(k, "null")) for k in x.keys() | y.keys()}} if kind == "obj" else {"arr": merge(x, y)}
        if x is not None or y is not None:
            return a if x is not None else b
    return "double" if {a, b} == {"long", "double"} else "str"


def to_spark(t, legacy_null: T.DataType | None = None) -> T.DataType | None:
    """The Spark type; None for an array that never has an element and for an object without keys."""
    if t == "geo":
        return T.StringType()
    if t == "null":
        return legacy_null or T.StringType()
    if isinstance(t, str):
        return SCALARS[t]
    if "arr" in t:
        inner = None if t["arr"] == "null" else to_spark(t["arr"])
        return T.ArrayType(inner) if inner is not None else None
    fields = []
    for k in sorted(t["obj"]):
        kind = to_spark(t["obj"][k])
        if kind is not None:
            fields.append(T.StructField(k, kind, True, {"logical": "geometry"} if t["obj"][k] == "geo" else None))
    return T.StructType(fields) if fields else None


def sample_type(texts) -> object:
    """The merged type of JSON texts; texts that aren't JSON say nothing."""
    out = "null"
    for t in texts:
        try:
            out = merge(out, type_of(json.loads(t)))
        except (ValueError, TypeError, RecursionError):
            continue
    return out
