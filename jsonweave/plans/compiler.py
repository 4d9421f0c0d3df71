"""A projection tree and a typed value -> a DataFrame plan of native columns.

The chain down to the output node makes rows (explode, filters as where); below it every branch becomes
one column, with filters as conditional values, so a branch that fails is null and the row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import parse_filter, to_column
from .paths import ANY, CHILD, DESCEND, EACH, INDEX, Node, Query

VALUE = "__value"


def _field(kind: T.DataType, name: str) -> T.DataType | None:
    if isinstance(kind, T.StructType):
        return next((f.dataType for f in kind.fields if f.name == name), None)
    return None


def _filter(node: Node, value: Column, kind: T.DataType | None) -> Column | None:
    """The node's filters on ``value``, whose attributes are those of its object."""
    out = None
    for text in node.filters:

        def resolve(keys: tuple[str, ...]) -> Column:
            column, own = value, kind
            for k in keys:
                own = _field(own, k)
                if own is None:
                    return F.lit(None)
                column = column.getField(k)
            return column

        def kind_of(keys: tuple[str, ...]) -> T.DataType | None:
            own = kind
            for k in keys:
                own = _field(own, k)
            return own

        c = to_column(parse_filter(text), resolve, kind_of)
        out = c if out is None else out & c
    return out


def _null(kind: T.DataType | None) -> Column:
    return F.lit(None).cast(kind or T.StringType())


def _flat(value: Column, kind: T.DataType, inner: T.DataType) -> Column:
    return F.flatten(F.filter(value, lambda x: x.isNotNull())) if isinstance(inner, T.ArrayType) else value


def _apply(node: Node, value: Column, kind: T.DataType | None) -> tuple[Column, T.DataType | None]:
    """One step below the output node, then what is below it."""
    step = node.step
    if step.kind == CHILD:
        own = _field(kind, step.name)
        if own is None and isinstance(kind, T.ArrayType):  # a key of an array's objects
            got: dict = {}

            def each(x: Column) -> Column:
                c, got["k"] = _apply(node, x, kind.elementType)
                return c

            column = F.transform(value, each)
            return column, T.ArrayType(got["k"] or T.StringType())
        if own is None:
            return _null(None), None
        return _below(node, value.getField(step.name), own)
    if step.kind == INDEX:
        if not isinstance(kind, T.ArrayType):
            return _null(None), None
        n = step.name
        return _below(node, F.get(value, n if n >= 0 else F.size(value) + n), kind.elementType)
    if step.kind == EACH:
        if not isinstance(kind, T.ArrayType):
            return _null(None), None
        inner = kind.elementType
        if node.filters:
            value = F.filter(value, lambda x: _filter(node, x, inner))
        bare = Node(step, [], node.ends, node.children)
        got = {}

        def one(x: Column) -> Column:
            c, got["k"] = _below(bare, x, inner)
            return c

        return (value, kind) if node.ends else (F.transform(value, one), T.ArrayType(got.setdefault("k", inner) or inner))
    if step.kind == ANY:
        if not isinstance(kind, T.StructType):
            return _null(None), None
        kinds = {f.dataType.simpleString() for f in kind.fields}
        parts = [value.getField(f.name) for f in kind.fields]
        inner = kind.fields[0].dataType if len(kinds) == 1 else T.StringType()
        if len(kinds) > 1:
            parts = [p if isinstance(f.dataType, T.StringType) else F.to_json(p) if isinstance(f.dataType, (T.StructType, T.ArrayType)) else p.cast("string") for p, f in zip(parts, kind.fields)]
        return F.filter(F.array(*parts), lambda x: x.isNotNull()), T.ArrayType(inner)
    return _descend(node, value, kind)


def _merged(kinds: list[T.DataType]) -> T.DataType:
    """One type for the finds of a descent: equal types, structs by union of fields, else string."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.StructType) for k in kinds):
        names = sorted({f.name for k in kinds for f in k.fields})
        return T.StructType([T.StructField(n, _merged([f.dataType for k in kinds for f in k.fields if f.name == n])) for n in names])
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return T.ArrayType(_merged([k.elementType for k in kinds]))
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def _fit(value: Column, kind: T.DataType, want: T.DataType) -> Column:
    if kind == want:
        return value
    if isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in kind.fields}
        parts = [(_fit(value.getField(f.name), own[f.name], f.dataType) if f.name in own else _null(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _fit(x, kind.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(value)
    return value.cast(want)


def _finds(name: str, value: Column, kind: T.DataType | None):
    """(value, type, many) for each place below ``value`` where the schema has the key."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            inner = value.getField(f.name)
            if f.name == name:
                yield inner, f.dataType, False
            else:
                yield from _finds(name, inner, f.dataType)
    elif isinstance(kind, T.ArrayType):
        # schema first: which places are below one element
        probe = [(k, many) for _, k, many in _finds(name, F.lit(None), kind.elementType)]
        for i, (k, many) in enumerate(probe):
            got = F.transform(value, _picker(name, kind.elementType, i))
            yield F.flatten(F.filter(got, lambda x: x.isNotNull())) if many else F.filter(got, lambda x: x.isNotNull()), k, True


def _picker(name: str, kind: T.DataType, i: int):
    return lambda x: list(_finds(name, x, kind))[i][0]


def _fitter(kind: T.DataType, want: T.DataType):
    return lambda x: _fit(x, kind, want)


def _descend(node: Node, value: Column, kind: T.DataType | None) -> tuple[Column, T.DataType | None]:
    finds = list(_finds(node.step.name, value, kind))
    if not finds:
        return _null(None), None
    want = _merged([k for _, k, _ in finds])
    if not any(many for _, _, many in finds):
        found = F.coalesce(*(_fit(c, k, want) for c, k, _ in reversed(finds)))
        return _below(node, found, want)
    parts = []
    for c, k, many in finds:
        own = F.transform(c, _fitter(k, want)) if many else F.array(_fit(c, k, want))
        parts.append(F.coalesce(own, F.array().cast(T.ArrayType(want))))
    every = F.filter(F.concat(*parts), lambda x: x.isNotNull())
    if node.filters:
        every = F.filter(every, lambda x: _filter(node, x, want))
    if node.ends:
        return every, T.ArrayType(want)
    got: dict = {}

    def one(x: Column) -> Column:
        c, got["k"] = _below(Node(node.step, [], node.ends, node.children), x, want)
        return c

    return F.transform(every, one), T.ArrayType(got.get("k") or want)


def _below(node: Node, value: Column, kind: T.DataType | None) -> tuple[Column, T.DataType | None]:
    """The value of a node that was reached: whole, or rebuilt from its branches."""
    test = _filter(node, value, kind)
    if node.ends or not node.children:
        out, own = value, kind
    elif len(node.children) == 1 and node.children[0].step.kind != CHILD:
        out, own = _apply(node.children[0], value, kind)
    elif isinstance(kind, T.ArrayType):
        got: dict = {}

        def each(x: Column) -> Column:
            c, got["k"] = _below(Node(node.step, [], False, node.children), x, kind.elementType)
            return c

        out = F.transform(value, each)
        own = T.ArrayType(got.get("k") or kind.elementType)
    else:
        parts, fields = [], []
        for child in node.children:
            c, k = _apply(child, value, kind)
            name = column_name(child)
            parts.append(c.alias(name))
            fields.append(T.StructField(name, k or T.StringType()))
        out, own = F.when(value.isNotNull(), F.struct(*parts)), T.StructType(fields)
    return (F.when(test, out) if test is not None else out), own


def column_name(node: Node) -> str:
    return str(node.step.name) if node.step.kind in (CHILD, DESCEND) else "value"


def matches(df: DataFrame, chain: list[Node], kind: T.DataType | None, keep: list[str], name: str | None = None) -> tuple[DataFrame, T.DataType | None, str | None]:
    """The rows of ``chain`` in column VALUE, their type, and the last name on the way."""
    last = name
    for node in chain:
        value, step = F.col(VALUE), node.step
        if step.kind == CHILD:
            own = _field(kind, step.name)
            df = df.withColumn(VALUE, value.getField(step.name) if own is not None else _null(None))
            kind, last = own, step.name
        elif step.kind == INDEX:
            own = kind.elementType if isinstance(kind, T.ArrayType) else None
            n = step.name
            df = df.withColumn(VALUE, F.get(value, n if n >= 0 else F.size(value) + n) if own is not None else _null(None))
            kind = own
        else:
            if step.kind == EACH:
                rows, own = (value, kind.elementType) if isinstance(kind, T.ArrayType) else (None, None)
            else:
                bare = Node(step, [], True, [])
                rows, found = _apply(bare, value, kind)
                last = step.name if step.kind == DESCEND else last
                if isinstance(found, T.ArrayType):
                    own = found.elementType
                else:
                    rows, own = (F.array(rows), found) if found is not None else (None, None)
            if rows is None:
                df, kind = df.where(F.lit(False)).withColumn(VALUE, _null(None)), None
                continue
            df = df.select(*keep, F.explode(rows).alias(VALUE))
            kind = own
        test = _filter(node, F.col(VALUE), kind)
        if test is not None:
            df = df.where(test)
        elif step.kind in (CHILD, INDEX):
            df = df.where(F.col(VALUE).isNotNull())
    return df, kind, last


def expand(df: DataFrame, query: Query, kind: T.DataType | None, keep: list[str], name: str | None = None) -> DataFrame:
    """Rows of ``query`` from column VALUE of type ``kind``; ``keep`` columns go along.

    ``name``: of the single column if rows aren't objects and the path names none.
    """
    df, kind, last = matches(df, query.chain, kind, keep, name)
    out, value = query.output, F.col(VALUE)
    if out.ends or not out.children:
        if isinstance(kind, T.StructType):
            return df.select(*keep, *(value.getField(f.name).alias(f.name) for f in kind.fields))
        return df.select(*keep, value.alias(last or "value"))
    columns = [_apply(child, value, kind)[0].alias(column_name(child)) for child in out.children]
    return df.select(*keep, *columns)
