"""JSONPath text -> immutable steps -> one projection tree for all paths of a query.

Grammar: paths separated by ``;``; a path is an optional ``$`` and steps: ``.name``, ``..name``, ``.*``,
``['name']``, ``[*]``, ``[n]``, ``[(filter)]`` or ``[?(filter)]``, and ``.name(filter)``.
``$[*]``, ``$.[*]`` and ``[*]`` are the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

CHILD, DESCEND, EACH, INDEX, ANY = "child", "descend", "each", "index", "any"


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    kind: str
    name: str | int | None = None
    filter: str | None = None


def _closing(text: str, at: int) -> int:
    """Index of the bracket that closes the one at ``at``; brackets in quotes don't count."""
    pairs, waiting, quote, i = {"(": ")", "[": "]"}, [], None, at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif c in "\"'":
            quote = c
        elif c in pairs:
            waiting.append(pairs[c])
        elif waiting and c == waiting[-1]:
            waiting.pop()
            if not waiting:
                return i
        i += 1
    raise PathError(f"bracket at {at} isn't closed in {text!r}")


def split_paths(text: str) -> list[str]:
    """The paths of a query, cut at semicolons outside quotes and brackets."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] in "([":
            i = _closing(text, i)
        elif text[i] == ";":
            out.append(text[start:i])
            start = i + 1
        i += 1
    out.append(text[start:])
    return [p.strip() for p in out if p.strip()]


def _condition(inside: str) -> str | None:
    """A filter's text without needless outer brackets; None for ``*`` and nothing."""
    inside = inside.strip()
    while inside.startswith("(") and _closing(inside, 0) == len(inside) - 1:
        inside = inside[1:-1].strip()
    return inside if inside not in ("", "*") else None


def parse_path(text: str) -> tuple[Step, ...]:
    steps: list[Step] = []
    i, n = (1 if text.startswith("$") else 0), len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "[":
            end = _closing(text, i)
            inside = text[i + 1 : end].strip()
            if re.fullmatch(r"-?\d+", inside):
                steps.append(Step(INDEX, int(inside)))
            elif len(inside) > 1 and inside[0] in "\"'" and inside[-1] == inside[0]:
                steps.append(Step(CHILD, inside[1:-1]))
            else:
                steps.append(Step(EACH, None, _condition(inside.removeprefix("?"))))
            i = end + 1
        elif c == "(":
            end = _closing(text, i)
            got = _condition(text[i + 1 : end])
            if got:
                if not steps:
                    raise PathError(f"a filter needs a step before it in {text!r}")
                steps[-1] = Step(steps[-1].kind, steps[-1].name, got)
            i = end + 1
        else:
            kind = DESCEND if text.startswith("..", i) else CHILD
            i += 2 if kind == DESCEND else 1 if c == "." else 0
            m = re.compile(r"[^.\[(\s;]+").match(text, i)
            if m:
                steps.append(Step(ANY) if m[0] == "*" and kind == CHILD else Step(kind, m[0]))
                i = m.end()
            elif i < n and text[i] not in "[":
                raise PathError(f"a name is expected at {i} in {text!r}")
    return tuple(steps)


@dataclass
class Node:
    """A step of the projection tree. ``ends``: a path ends here, so the whole value is wanted."""

    step: Step
    filters: list[str] = field(default_factory=list)
    ends: bool = False
    children: list[Node] = field(default_factory=list)

    def child(self, step: Step) -> Node:
        for x in self.children:
            if (x.step.kind, x.step.name) == (step.kind, step.name):
                break
        else:
            x = Node(Step(step.kind, step.name))
            self.children.append(x)
        if step.filter and step.filter not in x.filters:
            x.filters.append(step.filter)
        return x


@dataclass
class Query:
    """``chain``: the steps that all paths share down to ``output``, which gives the rows."""

    chain: list[Node]
    output: Node


def build(text: str) -> Query:
    paths = [parse_path(p) for p in split_paths(text)]
    root = Node(Step(CHILD, "$"))
    for steps in paths or [()]:
        node = root
        for s in steps:
            node = node.child(s)
        node.ends = True
    chain, node = [], root
    while len(node.children) == 1 and not node.ends:
        node = node.children[0]
        chain.append(node)
    return Query(chain, node)
