"""The filter language of path steps, compiled to Spark columns.

Logic is two-valued: a comparison with a missing or null side is false, but ``==`` and ``!=`` are
null-safe (``x == null`` holds for missing x, and missing x ``!= 5``). Lowest to highest: ``||``, ``&&``,
``~``, comparisons. New comparisons are added by :func:`register_operator`.

Sides of different types never fail: a text counts as a number beside one where it reads as one, else the two
are unequal and no order holds; a boolean beside a text counts as its word; a boolean and a number are unequal.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geo import geometry_type, geometry_within


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Attribute:
    """``keys`` lead from the object at hand to the value; none is the object itself."""

    keys: tuple[str, ...]


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Compare:
    operator: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    operator: str
    parts: tuple


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _text(c: Column) -> Column:
    return c.cast("string")


#: name (lower case) -> function of (left column, right column, right literal or None)
OPERATORS: dict[str, Callable[[Column, Column, object], Column]] = {
    "==": lambda a, b, v: a.eqNullSafe(b),
    "!=": lambda a, b, v: ~a.eqNullSafe(b),
    "<": lambda a, b, v: _false_if_null(a < b),
    "<=": lambda a, b, v: _false_if_null(a <= b),
    ">": lambda a, b, v: _false_if_null(a > b),
    ">=": lambda a, b, v: _false_if_null(a >= b),
    "in": lambda a, b, v: _false_if_null(a.isin(list(v))) if isinstance(v, tuple) else _false_if_null(F.array_contains(b, a)),
    "stringcontains": lambda a, b, v: _false_if_null(F.contains(_text(a), _text(b))),
    "stringstartswith": lambda a, b, v: _false_if_null(F.startswith(_text(a), _text(b))),
    "stringendswith": lambda a, b, v: _false_if_null(F.endswith(_text(a), _text(b))),
    "geometrytype": lambda a, b, v: _false_if_null(geometry_type(a) == F.lower(_text(b))),
    "geometrywithin": lambda a, b, v: _false_if_null(geometry_within(a, str(v))),
}
_ALIASES = {"startswith": "stringstartswith", "endswith": "stringendswith", "contains": "stringcontains"}


def register_operator(name: str, build: Callable[[Column, Column, object], Column]) -> None:
    """Add ``left name right`` to the language; ``build`` must return a boolean that is never null."""
    OPERATORS[name.lower()] = build


_TOKEN = re.compile(
    r"""\s*(?:
    (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*') |
    (?P<attribute>@(?:\.(?:[^\s.()\[\]!=<>&|~,]+)|\[\s*(?:"[^"]*"|'[^']*')\s*\])*) |
    (?P<logic>&&|\|\||~) |
    (?P<symbol>==|!=|<=|>=|<|>) |
    (?P<bracket>[()\[\],]) |
    (?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![^\s()\[\],&|=!<>~])) |
    (?P<word>[^\s()\[\],&|=!<>~]+)
    )""",
    re.X,
)


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, i = text, [], 0
        while text[i:].strip():
            m = _TOKEN.match(text, i)
            if not m:
                raise FilterError(f"can't read {text[i:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, value: str | None = None) -> tuple[str | None, str]:
        t = self.peek()
        if t[0] is None or value not in (None, t[1]):
            raise FilterError(f"{value or 'a term'} is expected in {self.text!r}")
        self.at += 1
        return t

    def whole(self):
        out = self.joined("||", lambda: self.joined("&&", self.unary))
        if self.peek()[0]:
            raise FilterError(f"{self.peek()[1]!r} isn't expected in {self.text!r}")
        return out

    def joined(self, operator: str, part: Callable):
        parts = [part()]
        while self.peek() == ("logic", operator):
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Logic(operator, tuple(parts))

    def unary(self):
        if self.peek() == ("logic", "~"):
            self.take()
            return Logic("~", (self.unary(),))
        if self.peek()[1] == "(":
            self.take()
            out = self.joined("||", lambda: self.joined("&&", self.unary))
            self.take(")")
            return out
        left = self.term()
        kind, value = self.peek()
        name = _ALIASES.get(value.lower(), value.lower())
        if kind in ("symbol", "word") and name in OPERATORS:
            self.take()
            return Compare(name, left, self.term())
        return Compare("==", left, Literal(True))  # a bare attribute must be true

    def term(self):
        kind, value = self.take()
        if kind == "attribute":
            keys = re.findall(r"\.([^.\[]+)|\[\s*(?:\"([^\"]*)\"|'([^']*)')\s*\]", value)
            return Attribute(tuple(a or b or c for a, b, c in keys))
        if kind == "string":
            return Literal(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "number":
            return Literal(int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value))
        if value in ("[", "("):
            items = []
            while self.peek()[1] not in ("]", ")"):
                items.append(self.term().value)
                if self.peek()[1] == ",":
                    self.take()
            self.take()
            return Literal(tuple(items))
        if kind == "word":
            return Literal({"true": True, "false": False, "null": None}.get(value, value))
        raise FilterError(f"{value!r} isn't expected in {self.text!r}")


def parse_filter(text: str):
    return _Parser(text).whole()


def attributes(ast) -> list[tuple[str, ...]]:
    """Keys of the attributes in a filter, in order of appearance."""
    if isinstance(ast, Attribute):
        return [ast.keys]
    parts = ast.parts if isinstance(ast, Logic) else (ast.left, ast.right) if isinstance(ast, Compare) else ()
    return list(dict.fromkeys(x for p in parts for x in attributes(p)))


def against_literals(ast) -> bool:
    """Whether no attribute is compared with another, so that attributes may be read as texts."""
    if isinstance(ast, Logic):
        return all(map(against_literals, ast.parts))
    return isinstance(ast.right, Literal) and isinstance(ast.left, Attribute) and bool(ast.left.keys)


NATIVE = frozenset(OPERATORS) - {"geometrywithin"}


def native(ast) -> bool:
    """Whether a filter has only built-in comparisons that need no user function."""
    if isinstance(ast, Logic):
        return all(map(native, ast.parts))
    return not isinstance(ast, Compare) or ast.operator in NATIVE


NUMBER, TEXT, TRUTH = "number", "text", "truth"


def _class(kind: T.DataType | None, value) -> str | None:
    if isinstance(value, bool) or isinstance(kind, T.BooleanType):
        return TRUTH
    if isinstance(value, (int, float)) or isinstance(kind, T.NumericType):
        return NUMBER
    return TEXT if isinstance(value, str) or isinstance(kind, T.StringType) else None


def _as_number(text: Column, whole: bool) -> Column:
    return text.try_cast("bigint" if whole else "double")


def _by_number(operator: str, text: Column, number: Column, whole: bool, swap: bool) -> Column:
    """A text beside a number; ``whole``: the number is a whole one, and so exact beyond 2**53."""

    def told(x: Column) -> Column:
        return OPERATORS[operator](*((number, x) if swap else (x, number)), None)

    as_double = _as_number(text, False)
    got = told(as_double)
    if whole:
        as_whole = _as_number(text, True)
        # a cast of 7.5 to a whole number is 7: it counts only where nothing is cut off
        exact = as_whole.isNotNull() & F.coalesce(as_whole.cast("double") == as_double, F.lit(False))
        got = F.when(exact, told(as_whole)).otherwise(told(as_double))
    other = F.lit(operator == "!=")
    return F.when(text.isNotNull() & as_double.isNull(), other).otherwise(got)


def _compare(operator: str, left: Column, right: Column, value, kinds: tuple) -> Column:
    """One comparison of sides of any types (see the top)."""
    f, (a, b) = OPERATORS[operator], kinds
    if operator == "in":
        if isinstance(value, tuple):
            return reduce(lambda x, y: x | y, (_compare("==", left, F.lit(v), v, kinds) for v in value if v is not None), F.lit(False))
        return f(left, right, value) if isinstance(b, T.ArrayType) and _class(a, None) == _class(b.elementType, None) else F.lit(False)
    if operator not in ("==", "!=", "<", "<=", ">", ">="):
        return f(left, right, value)
    x, y = _class(a, None), _class(b, value)
    if NUMBER in (x, y) and TEXT in (x, y):
        text, number, kind = (left, right, b) if x == TEXT else (right, left, a)
        whole = isinstance(value, int) or isinstance(kind, T.LongType)
        return _by_number(operator, text, number, whole, x == NUMBER)
    if TRUTH in (x, y) and TEXT in (x, y):
        return f(left.cast("string"), right.cast("string"), value) if operator in ("==", "!=") else F.lit(False)
    if TRUTH in (x, y) and NUMBER in (x, y):
        both = left.isNull() & right.isNull()
        return {"==": both, "!=": ~both}.get(operator, F.lit(False))
    if x == y == TEXT and operator not in ("==", "!="):
        p, q = left.try_cast("double"), right.try_cast("double")
        mixed = (p.isNull() & left.isNotNull()) != (q.isNull() & right.isNotNull())
        return F.when(mixed, F.lit(False)).when(p.isNotNull() & q.isNotNull(), f(p, q, value)).otherwise(f(left, right, value)) if value is not None else f(left, right, value)
    if x == NUMBER and isinstance(value, float):
        return f(left.cast("double"), right, value)
    return f(left, right, value)


def to_column(ast, resolve: Callable[[tuple], Column], kind_of: Callable[[tuple], T.DataType | None] = lambda keys: None) -> Column:
    """A boolean column, never null; ``resolve`` gives the column of an attribute's keys (null if there is none), ``kind_of`` its type."""
    if isinstance(ast, Logic):
        parts = [to_column(p, resolve, kind_of) for p in ast.parts]
        if ast.operator == "~":
            return ~parts[0]
        return reduce((lambda a, b: a & b) if ast.operator == "&&" else (lambda a, b: a | b), parts)

    def side(x, array: bool = False) -> tuple[Column, T.DataType | None]:
        if isinstance(x, Attribute):
            c, kind = resolve(x.keys), kind_of(x.keys)
            if isinstance(kind, T.StructType) or (isinstance(kind, T.ArrayType) and not array):
                return F.to_json(c), T.StringType()
            return c, kind
        kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(x.value))
        return (F.lit(None) if x.value is None or isinstance(x.value, tuple) else F.lit(x.value)), kind

    value = ast.right.value if isinstance(ast.right, Literal) else None
    (left, a), (right, b) = side(ast.left), side(ast.right, ast.operator == "in")
    return _compare(ast.operator, left, right, value, (a, b))
