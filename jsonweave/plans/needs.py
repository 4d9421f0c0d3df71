"""What of a record decides whether it matches: the keys of the paths and the attributes of the filters.

Their types come from all records, so no sample decides which rows match; only the columns of an object
at the end of the paths come from a sample of the matches. Below a descent or ``*`` everything decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from ..functions.predicates import attributes, parse_filter
from ..sources.splitter import LISTS
from . import lattice
from .paths import ANY, CHILD, DESCEND, Node, Query


@dataclass
class Need:
    """Of a value: ``leaf``: a filter compares it; ``end``: it makes a row; ``whole``: all in it;
    ``lists``: keys are looked for in an array's elements too (below the output node)."""

    keys: dict[str, Need] = field(default_factory=dict)
    each: Need | None = None
    leaf: bool = False
    end: bool = False
    whole: bool = False
    lists: bool = False

    def key(self, name: str) -> Need:
        return self.keys.setdefault(name, Need(lists=self.lists))

    def filtered(self, node: Node) -> Need:
        for text in node.filters:
            for keys in attributes(parse_filter(text)):
                at = self
                for k in keys:
                    at = at.key(k)
                at.leaf = True
        return self

    def step(self, node: Node) -> Need:
        if node.step.kind in (ANY, DESCEND):
            self.whole = True
            return self
        if node.step.kind == CHILD:
            return self.key(str(node.step.name)).filtered(node)
        self.each = self.each or Need(lists=self.lists)
        return self.each.filtered(node)


def needs(query: Query, own: Node | None) -> Need:
    """``own``: the node whose filters are those of the record itself."""
    root = at = Need() if own is None else Need().filtered(own)
    for node in query.chain:
        at = at.step(node)
        if at.whole:
            return root
    if query.output.ends or not query.output.children:
        at.end = True
        return root

    def below(at: Need, node: Node) -> None:
        at.lists = True
        for child in node.children:
            x = at.step(child)
            if x.whole:
                continue
            x.whole = child.ends
            below(x, child)

    below(at, query.output)
    return root


def wanted(need: Need) -> dict | None:
    """Keys -> the same below, as the splitter takes them; None: all is wanted."""
    if need.whole or need.end or need.leaf or need.each or not need.keys:
        return None
    return {k: wanted(x) for k, x in need.keys.items()} | ({LISTS: None} if need.lists else {})


NOTHING = Need()


def join(a, b, need: Need):
    """As :func:`lattice.merge`, but what a filter compares is text if it is an object here and a scalar there."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if isinstance(a, dict) and isinstance(b, dict) and a.keys() == b.keys():
        if "arr" in a:
            return {"arr": join(a["arr"], b["arr"], need.each or NOTHING)}
        x, y = a["obj"], b["obj"]
        return {"obj": {k: join(x.get(k, "null"), y.get(k, "null"), need.keys.get(k, NOTHING)) for k in x.keys() | y.keys()}}
    if need.leaf and not need.keys and not need.each and (isinstance(a, dict) or isinstance(b, dict)):
        return "str"
    return lattice.merge(a, b)


def type_of(value, need: Need, key: str | None = None):
    """The type of what is needed of a value; of a value that no match can come from, null."""
    if need.whole:
        return lattice.type_of(value, key)
    if isinstance(value, dict):
        if need.keys:
            return {"obj": {k: type_of(value[k], x, k) for k, x in need.keys.items() if k in value}}
        return lattice.type_of({"coordinates": 0}, key) if "coordinates" in value and key == "geometry" and (need.leaf or need.end) else {"obj": {}} if need.leaf or need.end else "null"
    if isinstance(value, list):
        inner = need.each or (need if need.end or (need.lists and need.keys) else None)
        if inner:
            return {"arr": reduce(lambda a, b: join(a, b, inner), (type_of(v, inner) for v in value), "null")}
        return lattice.type_of(value, key) if need.leaf else "null"
    return lattice.type_of(value, key) if need.leaf or need.end else "null"


def settled(kind, need: Need):
    """Objects and arrays of which nothing is known stay as text, so that they count as there."""
    if isinstance(kind, dict):
        if "arr" in kind:
            kind = {"arr": settled(kind["arr"], need.each or NOTHING)}
        else:
            kind = {"obj": {k: settled(v, need.keys.get(k, NOTHING)) for k, v in kind["obj"].items()}}
        if (need.leaf or need.end) and lattice.to_spark(kind) is None:
            return "str"
    return kind


def at_end(kind, chain: list[Node], change):
    """The type with ``change`` applied where the chain ends, and the type that was there; None if nothing is."""
    if not chain:
        return change(kind), kind
    step = chain[0].step
    if step.kind == CHILD:
        inner = kind["obj"].get(str(step.name)) if isinstance(kind, dict) and "obj" in kind else None
        if inner is None:
            return kind, None
        new, was = at_end(inner, chain[1:], change)
        return {"obj": kind["obj"] | {str(step.name): new}}, was
    if not isinstance(kind, dict) or "arr" not in kind:
        return kind, None
    new, was = at_end(kind["arr"], chain[1:], change)
    return {"arr": new}, was
