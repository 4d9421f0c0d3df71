"""Chat formatting: the cheapest repair of the roles of a conversation, then its rendering.

Legal conversations are those of an automaton: at most one system turn, first; then user and assistant in
turn, the assistant last. Every turn may keep its role or get another (``relabel``), become a turn of
its own or be joined to the one before (``merge``), and empty turns may be put in (``insert``); a dynamic
programme finds the repair of least total cost. Among equals, what keeps more comes first: a turn of its
own before a merge, then the roles in the order system, user, assistant.

A turn is a matrix of costs between the automaton's four states, and turns compose by the (min, +)
product. So a conversation of any length is worked on in chunks of ``CHUNK`` turns, cut from one global
order of turns. A conversation that lies in one chunk is repaired there; the others, which stand at the edges of
chunks, two a chunk at most, become a product each chunk, and products of a conversation are composed in order
(one row for thousands of turns), which gives the states between which each chunk repairs its part. No task
holds a whole conversation, and Python sees roles only: texts are rendered where they are, by native columns.

Defined cases: roles are trimmed and lower-cased, null and unknown ones cost ``relabel`` whatever they
become; null text is empty; turns are ordered by turn (nulls first), then role and text, so ties and
repeated rows have a fixed order and are all kept; rows without conv_id are one conversation; the
markers of the template are broken up where they occur in a text. conv_id and turn may have any type that can be put
in order; an empty table gives an empty table; very long texts never leave the JVM; further columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, stash

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
CHUNK_BITS = 12
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
INF = float("inf")


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    relabel: float = 2.5
    insert: float = 2.0


def choices(state: int, role: str, c: Costs) -> Iterator[tuple[float, int, str, tuple[str, ...], bool]]:
    """(cost, next state, new role, empty turns before, merged) for a turn read in a state."""
    for q, new in enumerate(ROLES, 1):
        if q == SYSTEM:
            before = () if state == START else None
        elif q == USER:
            before = ("assistant",) if state == USER else ()
        else:
            before = () if state == USER else ("user",)
        if before is not None:
            yield len(before) * c.insert + (new != role) * c.relabel, q, new, before, False
    if state != START:
        yield c.merge + (ROLES[state - 1] != role) * c.relabel, state, ROLES[state - 1], (), True


def ending(state: int) -> tuple[str, ...]:
    """Empty turns that make a conversation end legally."""
    return {ASSISTANT: (), USER: ("assistant",)}.get(state, ("user", "assistant"))


def product(roles: list[str], c: Costs) -> list[float]:
    """Least costs from each state to each over some turns, row by row."""
    out = []
    for s in range(4):
        row = [INF] * 4
        row[s] = 0.0
        for r in roles:
            nxt = [INF] * 4
            for t in range(4):
                if row[t] < INF:
                    for cost, q, *_ in choices(t, r, c):
                        nxt[q] = min(nxt[q], row[t] + cost)
            row = nxt
        out += row
    return out


def repair(roles: list[str], enter: int, leave: int, c: Costs) -> list[tuple[str, tuple[str, ...], bool]]:
    """(new role, empty turns before, merged) of each turn on the cheapest way from one state to another."""
    to_go = [[INF] * 4 for _ in range(len(roles) + 1)]
    to_go[-1][leave] = 0.0
    for i in range(len(roles) - 1, -1, -1):
        for s in range(4):
            to_go[i][s] = min(cost + to_go[i + 1][q] for cost, q, *_ in choices(s, roles[i], c))
    out, s = [], enter
    for i, r in enumerate(roles):
        _, s, new, before, merged = min(choices(s, r, c), key=lambda x: x[0] + to_go[i + 1][x[1]])
        out.append((new, before, merged))
    return out


def _empty(roles) -> str:
    return "".join(f"{OPEN}{r}\n{CLOSE}\n" for r in roles)


def compose(products: list[list[float]], c: Costs) -> tuple[list[int], float]:
    """The states before, between and after the parts of a conversation on its cheapest repair, and its cost."""
    ways = [[0.0, INF, INF, INF]]
    for m in products:
        ways.append([min(ways[-1][s] + m[4 * s + t] for s in range(4)) for t in range(4)])
    s = min(range(4), key=lambda t: (ways[-1][t] + len(ending(t)) * c.insert, -t))
    total, states = ways[-1][s] + len(ending(s)) * c.insert, [s]
    for m, way in zip(products[::-1], ways[-2::-1]):
        s = min(range(4), key=lambda t: (way[t] + m[4 * t + states[-1]], t))
        states.append(s)
    return states[::-1], total


def _parts(table: pa.Table) -> tuple[list, list, list, list[tuple[int, int]]]:
    """A chunk's conversations, roles and positions in order, and where each conversation begins and ends in it."""
    table = table.sort_by("position")
    convs, roles, positions = (table.column(x).to_pylist() for x in ("conv_id", "r", "position"))
    edge = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
    return convs, roles, positions, list(pairwise(edge))


def _decide(roles: list[str], enter: int, leave: int, last: bool, c: Costs) -> Iterator[tuple[str, str, int, str, str]]:
    """(new role, action, inserted, what stands before the text, what after) of each turn."""
    begun = enter != START
    for i, (r, (new, before, merged)) in enumerate(zip(roles, repair(roles, enter, leave, c))):
        head = "\n\n" if merged else f"{CLOSE}\n" * begun + _empty(before) + f"{OPEN}{new}\n"
        begun = True
        after = ending(leave) if last and i == len(roles) - 1 else ()
        tail = f"{CLOSE}\n" + _empty(after) if last and i == len(roles) - 1 else ""
        action = "+".join(x for x, y in (("merge", merged), ("relabel", new != r)) if y) or "keep"
        yield new, action, len(before) + len(after), head, tail


def format_conversations(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per turn: conv_id, position (order of all turns), turn, role, new_role, action, inserted, rendered, conv_cost.

    ``rendered`` has the empty turns put in before and, with the last turn, after it; a conversation's
    text is its turns' in order of position.
    """
    spark, conv = turns.sparkSession, turns.schema["conv_id"].dataType
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    rows = turns.select("conv_id", "turn", "role", role.alias("r"), F.coalesce("text", F.lit("")).alias("text"))
    key = ["conv_id", "turn", "r", "text"]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    rows = stash(rows.withColumn("position", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("position", CHUNK_BITS)), "chat-turns")
    roles = rows.select("conv_id", "r", "position", "chunk")
    conv_field = T.StructField("conv_id", conv)
    long = T.LongType()

    def at_edges(table: pa.Table) -> pa.Table:
        convs, own, _, parts = _parts(table)
        chosen = parts if len(parts) < 3 else [parts[0], parts[-1]]
        return pa.table([pa.array([convs[a] for a, _ in chosen], table.schema.field("conv_id").type), pa.array([table.column("chunk")[0].as_py()] * len(chosen), pa.int64()), pa.array([product(own[a:b], costs) for a, b in chosen], pa.list_(pa.float64()))], ["conv_id", "chunk", "m"])

    edges = roles.groupBy("chunk").applyInArrow(at_edges, T.StructType([conv_field, T.StructField("chunk", long), T.StructField("m", T.ArrayType(T.DoubleType()))]))

    def between(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        states, total = compose(table.column("m").to_pylist(), costs)
        n = table.num_rows
        return pa.table([table.column("conv_id"), table.column("chunk"), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array([False] * (n - 1) + [True]), pa.array([total] * n, pa.float64())], ["conv_id", "chunk", "enter", "leave", "last", "cost"])

    known = T.StructType([conv_field, T.StructField("chunk", long), *(T.StructField(x, T.IntegerType()) for x in ("enter", "leave")), T.StructField("last", T.BooleanType()), T.StructField("cost", T.DoubleType())])
    states = edges.groupBy("conv_id").applyInArrow(between, known)  # conversations at edges of chunks only
    states = states.groupBy("chunk").agg(F.collect_list(F.struct("conv_id", "enter", "leave", "last", "cost")).alias("known"))  # two a chunk

    def decide(table: pa.Table) -> pa.Table:
        edge = {x["conv_id"]: (x["enter"], x["leave"], x["last"], x["cost"]) for x in table.column("known")[0].as_py() or ()}
        convs, own, positions, parts = _parts(table)
        out = []
        for a, b in parts:
            if convs[a] in edge:
                enter, leave, last, cost = edge[convs[a]]
            else:
                (enter, leave), cost, last = *compose([product(own[a:b], costs)], costs), True
            out += [(p, *x, cost) for p, x in zip(positions[a:b], _decide(own[a:b], enter, leave, last, costs))]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["position", "new_role", "action", "inserted", "head", "tail", "conv_cost"])

    told = roles.join(states, "chunk", "left").groupBy("chunk").applyInArrow(decide, "position bigint, new_role string, action string, inserted int, head string, tail string, conv_cost double")
    text = F.concat("head", F.replace("text", F.lit("<|"), F.lit("< |")), "tail")
    return rows.join(told, "position").select("conv_id", "position", "turn", "role", "new_role", "action", "inserted", text.alias("rendered"), "conv_cost")
