"""``spark.read.format("jsonpath")``: the engine as a registered data source, for SQL and the reader API.

A registered source runs in Python processes that have no Spark session, so paths and filters are evaluated
here on parsed records, with the rules of the native compiler, and a file is one task, read as a
stream. For giant files :func:`~jsonweave.sources.reader.read_json_path` is the way: it splits them.

    register(spark)
    spark.read.format("jsonpath").option("jsonPath", "$.rows[(@.n > 3)]").load("/data/a.json")
    spark.sql("CREATE TEMPORARY VIEW v USING jsonpath OPTIONS (path '/data', jsonPath '$.rows[*]', recursive 'true')")
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.predicates import Attribute, Literal, Logic, parse_filter
from ..plans import lattice
from ..plans.paths import ANY, CHILD, DESCEND, EACH, INDEX, Node, Query, build
from .splitter import Reader, State, target_stack

SAMPLE = 1000
PIECE = 1 << 20


def _number(x) -> float | int | None:
    """A number, or a text that reads as one."""
    if isinstance(x, bool):
        return None
    if isinstance(x, (int, float)):
        return x
    try:
        return int(x) if re.fullmatch(r"\s*[+-]?\d+\s*", x) else float(x)
    except (TypeError, ValueError):
        return None


def _text(x) -> str:
    return x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)


_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _equal(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) != isinstance(b, bool):
        return _text(a) == _text(b) if isinstance(a, str) or isinstance(b, str) else False
    if isinstance(a, str) and isinstance(b, str):
        return a == b
    x, y = _number(a), _number(b)
    return x == y if x is not None and y is not None else isinstance(a, (dict, list, bool)) and _text(a) == _text(b)


def _before(operator: str, a, b) -> bool:
    if a is None or b is None or isinstance(a, bool) != isinstance(b, bool):
        return False
    x, y = _number(a), _number(b)
    if (x is None) != (y is None):
        return False
    return _ORDER[operator](x, y) if x is not None else _ORDER[operator](_text(a), _text(b))


def _geometry(operator: str, a, b) -> bool:
    from ..functions import geo

    if not isinstance(a, dict) or "type" not in a:
        return False
    if operator == "geometrytype":
        return str(a["type"]).lower() == _text(b).lower()
    import numpy as np

    rings = geo.parse_polygon(str(b))
    box = np.vstack(rings)
    try:
        return geo._within(a, rings, box.min(axis=0), box.max(axis=0))
    except (ValueError, KeyError, TypeError, IndexError):
        return False


def holds(ast, value) -> bool:
    """Whether a filter holds for a parsed value."""
    if isinstance(ast, Logic):
        if ast.operator == "~":
            return not holds(ast.parts[0], value)
        return (all if ast.operator == "&&" else any)(holds(p, value) for p in ast.parts)

    def side(x):
        if isinstance(x, Literal):
            return x.value
        assert isinstance(x, Attribute)
        at = value
        for k in x.keys:
            at = at.get(k) if isinstance(at, dict) else None
        return at

    a, b = side(ast.left), side(ast.right)
    match ast.operator:
        case "==":
            return _equal(a, b)
        case "!=":
            return not _equal(a, b)
        case "in":
            return a is not None and any(x is not None and _equal(a, x) for x in (b if isinstance(b, (tuple, list)) else ()))
        case "stringcontains" | "stringstartswith" | "stringendswith":
            if a is None or b is None:
                return False
            x, y = _text(a), _text(b)
            return y in x if ast.operator == "stringcontains" else x.startswith(y) if ast.operator == "stringstartswith" else x.endswith(y)
        case "geometrytype" | "geometrywithin":
            return _geometry(ast.operator, a, b)
        case _:
            return _before(ast.operator, a, b)


def _passes(node: Node, value) -> bool:
    return all(holds(parse_filter(f), value) for f in node.filters)


def _below(value, name: str) -> Iterator:
    """Values of a key at any depth; what is found isn't looked into."""
    for k, v in value.items() if isinstance(value, dict) else ():
        if k == name:
            yield v
        else:
            yield from _below(v, name)
    for v in value if isinstance(value, list) else ():
        yield from _below(v, name)


def _step(node: Node, value) -> Iterator:
    """The values that a step leads to."""
    kind, name = node.step.kind, node.step.name
    if kind == CHILD:
        got = [value[name]] if isinstance(value, dict) and name in value else []
    elif kind == INDEX:
        got = [value[name]] if isinstance(value, list) and -len(value) <= name < len(value) else []
    elif kind == EACH:
        got = value if isinstance(value, list) else []
    elif kind == ANY:
        got = list(value.values()) if isinstance(value, dict) else []
    else:
        got = list(_below(value, name))
    for v in got:
        if (v is not None or kind == EACH) and _passes(node, v):
            yield v


def matches(value, chain: list[Node]) -> Iterator:
    if not chain:
        yield value
        return
    for v in _step(chain[0], value):
        yield from matches(v, chain[1:])


def _branch(node: Node, value):
    """What stands in a column, below the output node."""
    many = node.step.kind in (EACH, ANY, DESCEND)
    if isinstance(value, list) and node.step.kind == CHILD:
        return [_branch(node, x) for x in value]
    found = [v if node.ends or not node.children else _object(node, v) for v in _step(node, value)]
    return found if many and (node.step.kind != DESCEND or len(found) != 1) else found[0] if found else None


def _object(node: Node, value):
    if isinstance(value, list):
        return [_object(node, x) for x in value]
    if len(node.children) == 1 and node.children[0].step.kind != CHILD:
        return _branch(node.children[0], value)
    return {_name(c): _branch(c, value) for c in node.children}


def _name(node: Node) -> str:
    return str(node.step.name) if node.step.kind in (CHILD, DESCEND) else "value"


def rows(query: Query, record, chain: list[Node], last: str | None) -> Iterator[dict]:
    """The rows of a record, as objects."""
    for v in matches(record, chain):
        if query.output.ends or not query.output.children:
            yield v if isinstance(v, dict) else {last or "value": v}
        else:
            yield {_name(c): _branch(c, v) for c in query.output.children}


def fitted(value, kind: T.DataType):
    """A parsed value as one of a Spark type; null where it doesn't fit."""
    if value is None:
        return None
    match kind:
        case T.StructType():
            return {f.name: fitted(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
        case T.ArrayType():
            return [fitted(x, kind.elementType) for x in value] if isinstance(value, list) else None
        case T.MapType():
            return {k: fitted(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
        case T.StringType():
            return _text(value)
        case T.BooleanType():
            return value if isinstance(value, bool) else None
        case T.DoubleType() | T.FloatType():
            return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        case T.IntegralType():
            return value if isinstance(value, int) and not isinstance(value, bool) else None
    return None


def _files(path: str, glob: str | None, recursive: bool) -> list[str]:
    """Files of a path or a pattern, as locations that :func:`_open` takes."""
    import glob as patterns

    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        found = sorted(patterns.glob(path)) if re.search(r"[*?\[]", path) else [path]
        system, places, head = fs.LocalFileSystem(), found, ""
    else:
        system, place = fs.FileSystem.from_uri(path)
        head = path[: len(path) - len(place)] if path.endswith(place) else "file://"
        places = [place]
    out = []
    for place in places:
        info = system.get_file_info(place)
        if info.type == fs.FileType.Directory:
            inner = system.get_file_info(fs.FileSelector(place, recursive=recursive))
            out += sorted(x.path for x in inner if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        elif info.type == fs.FileType.File:
            out.append(place)
        else:
            raise FileNotFoundError(path)
    return [head + x for x in out if not glob or fnmatch.fnmatch(x.rsplit("/", 1)[-1], glob)]


def _open(location: str):
    from pyarrow import fs

    if "://" in location or location.startswith("file:"):
        system, place = fs.FileSystem.from_uri(location)
    else:
        system, place = fs.LocalFileSystem(), location
    return system.open_input_stream(place, compression="detect")


def records(location: str, keys: list[str], array: bool, encoding: str) -> Iterator:
    """The parsed records of a file, read as a stream; texts that aren't JSON are left out."""
    reader, waiting = Reader(target_stack(keys, array), State()), b""
    import codecs

    decode = None if encoding.upper().replace("-", "") == "UTF8" else codecs.getincrementaldecoder(encoding)(errors="ignore")

    def cut(data: bytes):
        for place, text in reader.feed(data):
            if place == "record" and text.strip():
                try:
                    yield json.loads(text, strict=False)
                except ValueError:
                    continue

    with _open(location) as stream:
        while raw := stream.read(PIECE):
            data = waiting + (decode.decode(raw).removeprefix("﻿").encode() if decode else raw)
            end = data.rfind(b"}") + 1
            waiting = data[end:]
            if end:
                yield from cut(data[:end])
        yield from cut(waiting)


class _Part(InputPartition):
    def __init__(self, location: str):
        self.location = location


class _Reader(DataSourceReader):
    def __init__(self, source: JsonPathSource, schema: T.StructType):
        self.source, self.schema = source, schema

    def partitions(self):
        return [_Part(x) for x in self.source.files()]

    def read(self, partition):
        kinds = [(f.name, f.dataType) for f in self.schema.fields]
        if partition is None or not isinstance(partition, _Part):
            return
        for row in self.source.rows(partition.location):
            yield tuple(fitted(row.get(n), k) for n, k in kinds)


class JsonPathSource(DataSource):
    """Options: path, jsonPath ('$'), recursive, pathGlobFilter, encoding."""

    @classmethod
    def name(cls) -> str:
        return "jsonpath"

    def _option(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.options.items() if k.lower() == name.lower()), default)

    def files(self) -> list[str]:
        path = self._option("path")
        if not path:
            raise ValueError("the option path is needed")
        return _files(path, self._option("pathGlobFilter"), self._option("recursive", "false").lower() == "true")

    def rows(self, location: str) -> Iterator[dict]:
        from .reader import _prefix

        query = build(self._option("jsonPath", "$"))
        keys, array, rest = _prefix(query)
        own = rest[0] if array and rest and rest[0].step.kind == EACH else None
        chain = rest[1:] if own else rest
        last = next((str(n.step.name) for n in reversed(query.chain) if n.step.kind in (CHILD, DESCEND)), None)
        for record in records(location, keys, array, self._option("encoding", "UTF-8")):
            if own is None or _passes(own, record):
                yield from rows(query, record, chain, last)

    def schema(self) -> T.StructType:
        """Of the first 1000 rows."""
        kind, n = "null", 0
        for location in self.files():
            for row in self.rows(location):
                kind, n = lattice.merge(kind, lattice.type_of(row)), n + 1
                if n == SAMPLE:
                    break
            if n == SAMPLE:
                break
        found = lattice.to_spark(kind)
        return found if isinstance(found, T.StructType) else T.StructType([T.StructField("value", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonPathSource)
