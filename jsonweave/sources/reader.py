"""``read_json_path``: files and a JSONPath query -> a typed DataFrame, one row a match."""

from __future__ import annotations

import codecs
import json
import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import against_literals, attributes, native, parse_filter, to_column
from ..plans import lattice, needs
from ..plans.compiler import VALUE, expand, matches
from ..plans.compiler import _filter as filters
from ..plans.paths import CHILD, EACH, Node, Query, build
from . import splitter

SAMPLE = 1000


@dataclass(frozen=True)
class ReadOptions:
    """``partitioning``: 'fullPass' (exact split), 'speculation', or 'whole' (a file a task; taken for encodings of
    several bytes a character, but for UTF-8).
    ``schema_builder``: 'start' (columns of the first 1000 matches; what
    decides over matches is typed by all records) or 'fullPass' (all of all records). ``schema``: of a record of the
    split, or of the rows if the path ends there. ``mode``: PERMISSIVE or FAILFAST."""

    schema: T.StructType | str | None = None
    path_glob_filter: str | None = None
    recursive: bool = False
    partitioning: str = "fullPass"
    schema_builder: str = "start"
    extra_fields: bool = False
    keep_index: bool = False
    encoding: str = "UTF-8"
    mode: str = "PERMISSIVE"


def _prefix(query: Query) -> tuple[list[str], bool, list[Node]]:
    """Keys and whether an array follows that the splitter can cut at; the chain that is left."""
    keys: list[str] = []
    for i, node in enumerate(query.chain):
        if node.step.kind == EACH:
            rest = query.chain[i + 1 :]
            return keys, True, ([Node(node.step, node.filters)] if node.filters else []) + rest
        if node.step.kind != CHILD or node.filters:
            break
        keys.append(str(node.step.name))
    return [], False, query.chain


def _roots(text: str):
    """The root values of a document."""
    at, decoder = 0, json.JSONDecoder(strict=False)
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            break
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            end = len(text)
        yield text[at:end]
        at = end


def _decoded(pieces, encoding: str):
    """(file, size, bytes so far, whether it's the end) -> (file, UTF-8, whether it's the end)."""
    decoder, total, mark = None, 0, b"\xef\xbb\xbf"
    for file, size, data, end in pieces:
        if decoder is None:
            decoder, total, begun = codecs.getincrementaldecoder(encoding)("ignore"), 0, False
        total += len(data)
        if end and total - size in (1, 1 - len(mark)):  # the file doesn't end in a brace; Hadoop takes off a byte order mark
            data = data[:-1]
        data = decoder.decode(data, end).encode()
        yield file, data if begun else data.removeprefix(mark), end
        begun = begun or bool(data)
        decoder = None if end else decoder


def _whole_files(spark: SparkSession, path, keys: list[str], array: bool, o: ReadOptions, want: dict | None = None) -> DataFrame:
    """A file a task, as a stream: a task holds a batch of its bytes and the record that is open."""
    encoding, target = o.encoding, splitter.target_stack(keys, array)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())

    def records(found):
        for place, text in found:
            if place == "gap":
                yield from _roots(text.decode(errors="ignore").rstrip().removesuffix("}"))
            elif text.strip():
                yield text.strip().decode(errors="ignore")

    def run(batches):
        reader, n, rows, size = None, 0, [], 0

        def emit():
            nonlocal rows, size
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "block", "n", "text"])
            rows, size = [], 0

        for file, data, end in _decoded(splitter._blocks(batches), encoding):
            if reader is None:
                reader, n = splitter.Reader(target, splitter.State(), want, gaps=True), 0
            for found in (reader.feed(data) if data else (), reader.finish() if end else ()):
                for record in records(found):
                    n += 1
                    rows.append((file, 0, n, record))
                    size += len(record)
                    if len(rows) >= 4096 or size > 1 << 24:
                        yield from emit()
            if end:
                reader = None
        yield from emit()

    files = splitter.files_in_order(spark, path, o.path_glob_filter, o.recursive)
    return files.mapInArrow(run, "file string, block bigint, n bigint, text string")


def split_records(spark: SparkSession, path, keys: list[str], array: bool, o: ReadOptions, want: dict | None = None) -> DataFrame:
    utf8 = o.encoding.upper().replace("-", "") == "UTF8"
    if o.partitioning == "whole" or not (utf8 or splitter.single_byte(o.encoding)):
        return _whole_files(spark, path, keys, array, o, want)
    begin = _begin(spark, path, keys, array, o) if o.partitioning == "speculation" and utf8 else None
    return splitter.records(spark, path, keys, array, o.path_glob_filter, o.recursive, o.partitioning, begin, o.encoding, want)


_BEGIN = re.compile(r'\{\s*"(?:[^"\\]|\\.)*"\s*:', re.S)


def _begin(spark: SparkSession, path, keys, array, o: ReadOptions) -> str | None:
    """The text up to the first key's colon, if all sampled records begin with it and have it nowhere else; else None (exact mode)."""
    if not array:
        return None
    rows = splitter.fragments(spark, path, o.path_glob_filter, o.recursive)
    first = rows.where("block = 0").select("file").head()
    if first is None:
        return None
    sample = rows.where((F.col("file") == first[0]) & (F.col("block") == 0)).limit(SAMPLE).coalesce(1)
    target = splitter.target_stack(keys, array)
    found = sample.mapInArrow(splitter._records(target, splitter.States(target)), splitter.SCHEMA)
    begin = None
    for r in found.where("place = 'record'").select("text").collect():  # SAMPLE rows at most
        m = _BEGIN.match(r["text"].strip())
        if not m or begin not in (None, m[0]) or r["text"].count(m[0]) != 1:
            return None
        begin = m[0]
    return begin


def infer_type(rows: DataFrame, full: bool):
    """The merged type of the record texts: of a sample, or of all (partial types are merged on the driver)."""
    if not full:
        return lattice.sample_type(r["text"] for r in rows.select("text").limit(SAMPLE).collect())

    def run(batches):
        out = "null"
        for batch in batches:
            out = lattice.merge(out, lattice.sample_type(batch.column("text").to_pylist()))
        yield pa.record_batch([pa.array([json.dumps(out)])], ["t"])

    got = rows.select("text").mapInArrow(run, "t string").collect()  # one type a partition
    return reduce(lattice.merge, (json.loads(r["t"]) for r in got), "null")


def _matching_type(rows: DataFrame, query: Query, own: Node | None):
    """The type of a record: what decides over matches from all records, and below the end of the paths the
    columns of the first ``SAMPLE`` matches. One pass over the texts and one over those up to the sample."""
    need = at = needs.needs(query, own)

    def run(batches):
        out = "null"
        for batch in batches:
            for text in batch.column("text").to_pylist():
                try:
                    out = needs.join(out, needs.type_of(json.loads(text, strict=False), need), need)
                except (ValueError, TypeError, RecursionError):
                    continue
        yield pa.record_batch([pa.array([json.dumps(out)])], ["t"])

    got = rows.select("text").mapInArrow(run, "t string").collect()  # one type a partition
    kind = reduce(lambda a, b: needs.join(a, b, need), (json.loads(r["t"]) for r in got), "null")
    for node in query.chain:
        if at.whole:
            return needs.settled(kind, need)
        at = at.keys[str(node.step.name)] if node.step.kind == CHILD else at.each
    _, end = needs.at_end(kind, query.chain, lambda t: t)
    if at.end and end is not None and "obj" in json.dumps(end):
        last = query.chain[-1] if query.chain else own
        # the matches' own texts: filters of the last node read them, those before read the record
        chain = [*query.chain[:-1], Node(last.step)] if query.chain else []
        plain, _ = needs.at_end(needs.settled(kind, need), query.chain, lambda t: "str")
        if query.chain:
            df = rows.select(parsed(F.col("text"), lattice.to_spark(plain)).alias(VALUE))
            if own is not None:
                df = df.where(filters(own, F.col(VALUE), lattice.to_spark(plain)))
            df, _, _ = matches(df, chain, lattice.to_spark(plain), [])
        else:
            df = rows.select(F.col("text").alias(VALUE))
        if last is not None and last.filters:
            inner = lattice.to_spark(needs.settled(end, at)) or T.StringType()
            df = df.where(filters(last, parsed(F.col(VALUE), inner), inner))
        sample = lattice.sample_type(r[0] for r in df.select(VALUE).limit(SAMPLE).collect())
        kind, _ = needs.at_end(kind, query.chain, lambda t: needs.join(t, sample, at))
    return needs.settled(kind, need)


def parsed(text: Column, kind: T.DataType, mode: str = "PERMISSIVE") -> Column:
    """A JSON text of any kind as a typed value; text columns of objects and arrays keep their JSON.

    Objects are parsed as they are, without options, so that Catalyst can leave out the fields that a query doesn't use.
    """
    options = {} if mode == "PERMISSIVE" else {"mode": mode}
    if isinstance(kind, T.StructType):
        return F.from_json(F.when(F.startswith(text, F.lit("{")), text), kind, options)
    wrapped = T.StructType([T.StructField("v", kind)])
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), wrapped, options)["v"]


def _attribute_type(keys: list[tuple[str, ...]]) -> T.StructType | None:
    """An object with texts at ``keys``; None if one leads through another."""
    tree: dict = {}
    for path in keys:
        at = tree
        for k in path[:-1]:
            at = at.setdefault(k, {})
            if at is None:
                return None
        if at.get(path[-1], None) is not None or (path[-1] in at) != (at.get(path[-1], 0) is None):
            return None
        at[path[-1]] = None

    def kind(t: dict | None) -> T.DataType:
        return T.StringType() if t is None else T.StructType([T.StructField(k, kind(v)) for k, v in t.items()])

    return kind(tree)


def _text_test(node: Node, text: Column) -> Column | None:
    """A record's filters on its text: only the attributes in them are parsed, as texts, whatever their types, so
    most records are rejected early and no pass over the data is needed to type them. None if a filter compares
    attributes with each other or isn't native."""
    filters_ = [parse_filter(t) for t in node.filters]
    keys = list(dict.fromkeys(k for f in filters_ for k in attributes(f)))
    kind = _attribute_type(keys) if keys and all(against_literals(f) and native(f) for f in filters_) else None
    if kind is None:
        return None

    def at(value: Column):
        def resolve(path: tuple[str, ...]) -> Column:
            return reduce(lambda c, k: c.getField(k), path, value)

        return resolve

    def test(value: Column) -> Column:
        return reduce(lambda a, b: a & b, (to_column(f, at(value), lambda path: T.StringType()) for f in filters_))

    # as a lambda's variable, the parsed attributes are computed once
    return F.element_at(F.transform(F.array(parsed(text, kind)), test), 1)


def read_json_path(spark: SparkSession, path: str | list[str], json_path: str, **options) -> DataFrame:
    """One row for each match of ``json_path`` in the JSON files of ``path``.

    With several paths (``;``) a row is a match of what they share, and each remainder is a column.
    """
    o = ReadOptions(**options)
    query = build(json_path)
    keys, array, rest = _prefix(query)
    # strict parsing and extra fields need the whole of each record
    want = None if array or o.extra_fields or o.mode != "PERMISSIVE" else needs.wanted(needs.needs(Query(rest, query.output), None))
    rows = split_records(spark, path, keys, array, o, want)
    kind = o.schema
    if isinstance(kind, str):
        kind = T._parse_datatype_string(kind)
    own = rest[0] if rest and rest[0].step.kind == EACH and array else None  # the array's own filter: the element is the value already
    query = Query(rest[1:] if own else rest, query.output)
    test = _text_test(own, F.col("text")) if own is not None else None
    if test is not None:
        rows, own = rows.where(test), None
    if kind is None:
        if o.schema_builder == "fullPass" or (own is None and not query.chain and query.output.ends):  # all records match
            kind = lattice.to_spark(infer_type(rows, o.schema_builder == "fullPass"))
        else:
            kind = lattice.to_spark(_matching_type(rows, query, own))
    keep, extra = [], []
    if kind is None:
        kind = T.StringType()
    if o.keep_index:
        rows = rows.select("*", F.xxhash64("file", "block").alias("partition_id"), F.col("n").alias("partition_row_index"))
        keep += ["partition_id", "partition_row_index"]
    if o.extra_fields:
        known = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else []
        fields = F.from_json("text", T.MapType(T.StringType(), T.StringType()))
        left = F.map_filter(fields, lambda k, _: ~k.isin(known) if known else F.lit(True))
        rows = rows.withColumn("extra_fields", F.when(F.size(left) > 0, F.to_json(left)))
        keep.append("extra_fields")
        extra = ["extra_fields"]
    df = rows.select(*keep, parsed(F.col("text"), kind, o.mode).alias(VALUE))
    if own is not None:
        df = df.where(filters(own, F.col(VALUE), kind))
    out = expand(df, query, kind, keep, keys[-1] if array and keys else None)
    names = [*(c for c in out.columns if c not in keep), *extra, *(c for c in keep if c not in extra)]
    return out.select(*("`" + c.replace("`", "``") + "`" for c in names))


def count_records(spark: SparkSession, path, json_path: str, **options) -> int:
    """Number of matches; records are counted unparsed where the path ends at them."""
    o = ReadOptions(**options)
    query = build(json_path)
    keys, array, rest = _prefix(query)
    if not rest and query.output.ends:
        return split_records(spark, path, keys, array, o).count()
    return read_json_path(spark, path, json_path, **options).count()
