"""Records of giant JSON documents, found in parallel.

A document's bytes are read by Spark's text source with ``}`` as its line separator, so any file system
and codec works and blocks begin behind a closing brace. Records are the elements of one array (given by
the keys that lead to it), or the root values. Exact mode, two passes:

1. each block is summarised under both hypotheses, that it begins inside a string or not: how many
   containers it closes that it didn't open, and which it leaves open, with their keys. At the same time,
   for each depth at which it may begin, the pieces of records at its two edges are kept, if short;
2. the driver folds the summaries of a file (one a block) to the true state at each block's start, and
   picks each block's true pieces; records that cross blocks are joined from them. Blocks are read again
   with their states, and the records that lie inside of one block are cut out.

Where a piece is too long to be kept in the first pass, pieces come from one more pass like the second.
Root values may be as long as a whole document: where it is known which keys are ``want``ed of them, long ones are cut
down to these as they are read, block by block, so no task ever holds one.

The speculative mode reads with the text that the sampled records begin with (such as ``{"key":``) as the
line separator: then Spark itself cuts the records, without Python. In a string that text can't
stand, since its quotes would be escaped. One pass over all lines tells whether each is one whole record,
with one head and one foot a file; if not, the exact mode is used.
"""

from __future__ import annotations

import bisect
import json
import re
from array import array
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keep

_KIND = np.zeros(256, np.int8)
for _c in b"{[":
    _KIND[_c] = 1
for _c in b"}]":
    _KIND[_c] = -1
_MARK = _KIND != 0
_MARK[ord(",")] = True

#: Longest piece of a record that the first pass keeps, and the deepest start of a block that it allows for.
LIMIT = 1 << 20
LEVELS = 32


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, whether an odd number of quotes stands before each, and before the end."""
    quotes = np.flatnonzero(data == 34)
    back = np.flatnonzero(data == 92)
    if len(back) and len(quotes):
        place = np.arange(len(back))
        run = place - np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(back) != 1)), place, 0)) + 1
        j = np.minimum(np.searchsorted(back, quotes - 1), len(back) - 1)
        quotes = quotes[~((back[j] == quotes - 1) & (run[j] % 2 == 1))]
    at = np.flatnonzero(_MARK[data])
    return at, np.searchsorted(quotes, at) % 2 == 1, len(quotes) % 2


@dataclass
class State:
    """Open containers as (bracket, key) from the root, whether a string is open, and the bytes since the last
    bracket or comma if they may be the begin of a key."""

    stack: list = field(default_factory=list)
    in_string: bool = False
    begun: bytes = b""


def _key(between: bytes) -> str | None:
    """The key that stands between a bracket or comma and an opening bracket."""
    text = between.strip()
    if not text.endswith(b":"):
        return None
    try:
        return json.loads(text[:-1].decode(errors="replace"), strict=False)
    except ValueError:
        return None


def _begun_key(between: bytes) -> bytes:
    """``between``, which ends inside a string, if that string may be a key: then it stands first."""
    text = between.lstrip()
    return between if text.startswith(b'"') and not re.match(rb'"(?:[^"\\]|\\.)*"', text, re.S) else b""


class Summary:
    """What a block does to the state, under one hypothesis on its start; fed piece by piece."""

    def __init__(self, in_string: bool, array: bool):
        self.in_string, self.array = in_string, array
        self.closed, self.opened, self.since, self.size = 0, [], b"", 0
        self.seen, self.first = False, b""  # of the first opener, if nothing stands before it: what may end a key begun earlier
        self.ends: dict[int, list] = {}  # by how far the block begins below the records: first, last, number, over

    def feed(self, data: bytes, raw: np.ndarray, at: np.ndarray, odd: np.ndarray, quotes: int) -> None:
        at = at[odd == self.in_string]
        step = _KIND[raw[at]].astype(np.int64)
        base = len(self.opened) - self.closed
        depth = base + np.cumsum(step)
        if len(at):
            low = min(base, int(depth.min()))
            pops = base - low
            lost = max(0, pops - len(self.opened))
            del self.opened[len(self.opened) - (pops - lost) :]
            self.closed += lost
            later = np.minimum.accumulate(depth[::-1])[::-1]
            for i in np.flatnonzero((step > 0) & (later >= depth)).tolist():
                p = int(at[i])
                between = data[int(at[i - 1]) + 1 : p] if i else self.since + data[:p]
                self.opened.append([chr(data[p]), _key(between)])
                if not i and not self.seen:
                    self.first = between
            for k in range(min(self.closed, LEVELS) + 1):
                self._mark(k, at, step, depth)
            self.since, self.seen = data[int(at[-1]) + 1 :], True
        else:
            self.since += data
        self.in_string ^= bool(quotes)
        self.size += len(data)

    def _mark(self, k: int, at: np.ndarray, step: np.ndarray, depth: np.ndarray) -> None:
        e = self.ends.setdefault(k, [None, None, 0, False, None])
        if e[3]:
            return
        if self.array:
            close = (step < 0) & (depth == -k - 1)
            hit = np.flatnonzero(((step == 0) & (depth == -k)) | close)
            over = np.flatnonzero(close[hit])
            if len(over):
                hit, e[3] = hit[: int(over[0]) + 1], True
        else:
            hit = np.flatnonzero((step < 0) & (depth == -k))
            begins = np.flatnonzero((step > 0) & (depth == 1 - k))
            if len(begins):
                e[4] = self.size + int(at[begins[-1]])
        if len(hit):
            if e[0] is None:
                e[0] = self.size + int(at[hit[0]])
            e[1] = self.size + int(at[hit[-1]])
            e[2] += len(hit)

    def pieces(self, lead: bytes, trail: bytes):
        """(k, records inside, piece at the begin, piece at the end or None, whether all is one piece), if short."""
        depth = len(self.opened) - self.closed
        for k, (first, last, n, over, begin) in self.ends.items():
            if self.array:
                if first is None:
                    if self.size <= LIMIT:
                        yield k, 0, lead, None, True
                elif first <= LIMIT and (over or self.size - last - 1 <= LIMIT):
                    yield k, n - 1, lead[:first], None if over else trail[len(trail) - (self.size - last - 1) :], False
                continue
            open_ = depth > -k
            if k and first is None:
                if self.size <= LIMIT:
                    yield k, 0, lead, None, True
            elif (not k or first < LIMIT) and (not open_ or (begin is not None and self.size - begin <= LIMIT)):
                yield k, n - (k > 0), lead[: first + 1] if k else b"", trail[len(trail) - (self.size - begin) :] if open_ else None, False

    def told(self) -> dict:
        return {"closed": self.closed, "opened": self.opened, "string": self.in_string, "begun": _begun_key(self.since).decode("latin-1") if self.in_string else "", "first": self.first.decode("latin-1")}


def summarise(data: bytes, in_string: bool) -> dict:
    """The summary of a whole block."""
    s = Summary(in_string, True)
    raw = np.frombuffer(data, np.uint8)
    s.feed(data, raw, *structure(raw))
    return s.told()


def advance(state: State, summary: dict) -> State:
    opened = list(map(tuple, summary["opened"]))
    if opened and state.begun and summary["first"]:  # the first one's key began in an earlier block
        opened[0] = (opened[0][0], _key(state.begun + summary["first"].encode("latin-1")))
    own = state.stack[: max(0, len(state.stack) - summary["closed"])]
    return State([*own, *opened], summary["string"], summary["begun"].encode("latin-1"))


def target_stack(keys: list[str], array: bool) -> list[tuple]:
    """The containers that are open right inside the array at ``keys``; [] for root values."""
    if not array:
        return []
    kinds = ["{"] * len(keys) + ["["]
    return list(zip(kinds, [None, *keys]))


#: Among wanted keys: arrays are wanted too, in whole.
LISTS = 0


def levels(want: dict | None) -> int:
    return 0 if want is None else 1 + max(map(levels, want.values()), default=0)


class Pruner:
    """A root value's text without what isn't wanted: the insides of containers at other keys go, and of members at
    other keys that stand side by side in a block all but one. What is left is as well-formed as the whole was on these
    levels. Fed piece by piece, from the value's begin or (``state``) the middle. ``want``: key -> the same below, None for all."""

    def __init__(self, want: dict, state: State):
        self.want, self.levels = want, levels(want)
        self.stack, self.depth = list(state.stack[: self.levels + 1]), len(state.stack)
        self.in_string, self.since, self.kept = state.in_string, state.begun, bytearray()
        self.dropping = 0  # depth of the container whose insides go
        self.members: dict[int, list] = {}  # by depth: begin of the member in what is kept if seen, whether the last one wasn't wanted, names
        for d in range(1, len(self.stack) + 1):
            self._enter(d, None)
            if d not in self.members:
                break

    def _enter(self, d: int, begin: int | None) -> None:
        inside: dict | None | bool = self.want
        for i, (bracket, key) in enumerate(self.stack[:d]):
            if i:
                inside = inside.get(key, False)
            if not isinstance(inside, dict):
                break
            if bracket == "[":
                inside = None if LISTS in inside else False
                break
        if inside is False:
            self.dropping = d
        elif inside is not None:
            self.members[d] = [begin, False, inside]

    def _ended(self, d: int) -> None:
        """A member at depth ``d`` ends where the kept text does."""
        begin, other, names = mine = self.members[d]
        m = begin is not None and re.compile(rb'[\s,]*("(?:[^"\\]|\\.)*"\s*:)', re.S).match(self.kept, begin)
        key = _key(m[1]) if m else None
        mine[1] = key is not None and key not in names
        if mine[1] and other:
            del self.kept[begin:]

    def feed(self, new: bytes) -> None:
        raw = np.frombuffer(new, np.uint8)
        at, odd, quotes = structure(raw)
        at = at[odd == self.in_string]
        self.in_string ^= bool(quotes)
        step = _KIND[raw[at]].astype(np.int64)
        depth = self.depth + np.cumsum(step)
        start = 0
        for i in np.flatnonzero(np.where(step > 0, depth - 1, depth) <= self.levels).tolist():
            p, d, s = int(at[i]), int(depth[i]), int(step[i])
            if s > 0:
                between = new[int(at[i - 1]) + 1 : p] if i else self.since + new[:p]
                self.stack = self.stack[: d - 1] + [(chr(new[p]), _key(between) if d > 1 else None)]
                if not self.dropping and (d == 1 or d - 1 in self.members):
                    self.kept += new[start : p + 1]
                    start = p + 1
                    self._enter(d, len(self.kept))
                continue
            inner = d + (s < 0)
            if s < 0:
                self.stack = self.stack[: max(d, 0)]
                if self.dropping == inner:
                    start, self.dropping = p, 0
                    continue
            if not self.dropping and inner in self.members:
                self.kept += new[start:p]
                start = p
                self._ended(inner)
                if s < 0:
                    del self.members[inner]
                else:
                    self.members[inner][0] = len(self.kept)
        if not self.dropping:
            self.kept += new[start:]
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.since = new[int(at[-1]) + 1 :] if len(at) else self.since + new


class Reader:
    """Cuts records out of a block that is fed piece by piece. ``out`` gets (place, text), where place is
    'record', 'head' (end of a record begun earlier), 'tail' (begin of one that goes on) or 'middle'. ``want``: of root
    values only this is kept, in long records and in all pieces. ``gaps``: what stands between root objects and arrays is
    told too, as 'gap'."""

    def __init__(self, target: list[tuple], state: State, want: dict | None = None, gaps: bool = False):
        self.want, self.began, self.pruner, self.gaps = want, state, None, gaps and not target
        self.target, self.depth = target, len(target)
        self.stack, self.in_string, self.since = list(state.stack), state.in_string, state.begun
        self.inside = len(self.stack) >= self.depth and self.stack[: self.depth] == target
        self.open = self.inside and (len(self.stack) > self.depth or self.in_string)
        self.cut = not self.open  # a boundary was seen, so what comes is not of an earlier record
        if self.depth and self.inside and len(self.stack) == self.depth:
            self.open, self.cut = True, False  # between records: what stands before the next comma is of the earlier one
        self.text = b""

    def feed(self, new: bytes):
        raw = np.frombuffer(new, np.uint8)
        at, odd, quotes = structure(raw)
        at = at[odd == self.in_string]
        self.in_string ^= bool(quotes)
        step = _KIND[raw[at]].astype(np.int64)
        depth = len(self.stack) + np.cumsum(step)
        shallow = np.flatnonzero(np.where(step > 0, depth - 1, depth) <= self.depth)
        stack, start, before = self.stack[: self.depth + 1], 0, self.text
        end = int(depth[-1]) if len(depth) else len(self.stack)

        def upto(p: int) -> bytes:
            return before + new[start:p]

        for i in shallow.tolist():
            p, d, s = int(at[i]), int(depth[i]), int(step[i])
            if s > 0:
                if d <= self.depth:
                    between = new[int(at[i - 1]) + 1 : p] if i else self.since + new[:p]
                    stack = stack[: d - 1] + [(chr(new[p]), _key(between) if d > 1 else None)]
                    if d == self.depth and stack == self.target:
                        self.inside = self.open = self.cut = True
                        before, start = b"", p + 1
                elif not self.depth and not self.open:
                    if self.gaps:
                        yield "gap", upto(p)
                    self.open, before, start = True, b"", p
            elif s < 0:
                if self.depth and self.inside and d == self.depth - 1:
                    yield from self._done(upto(p))
                    before, self.inside, self.open = b"", False, False
                elif not self.depth and d == 0:
                    yield from self._done(self._pruned(upto(p + 1), not self.cut))
                    before, start, self.open = b"", p + 1, False
                if d < self.depth:
                    stack = stack[: max(d, 0)]
            elif self.inside and self.depth and d == self.depth:
                yield from self._done(upto(p))
                before, start, self.open = b"", p + 1, True
        # the full stack, for the next piece: only its depth and its first levels matter
        self.stack = (stack + [("", None)] * max(end, 0))[:end] if end > len(stack) else stack[: max(end, 0)]
        self.since = new[int(at[-1]) + 1 :] if len(at) else self.since + new
        self.text = upto(len(new)) if self.open or self.gaps else b""
        if self.open and self.want is not None and (self.pruner or len(self.text) > LIMIT):
            self._prune()

    def _prune(self) -> None:
        self.pruner = self.pruner or Pruner(self.want, State() if self.cut else self.began)
        self.pruner.feed(self.text)
        self.text = b""

    def _pruned(self, text: bytes, piece: bool) -> bytes:
        """A record or piece that ends: what is wanted of it."""
        if self.want is None or not (piece or self.pruner or len(text) > LIMIT):
            return text
        self.text = text
        self._prune()
        text, self.pruner = bytes(self.pruner.kept), None
        return text

    def _done(self, text: bytes):
        place = "record" if self.cut else "head"
        self.cut = True
        if text.strip() or place == "head":
            yield place, text

    def finish(self):
        if self.open:
            yield ("tail" if self.cut else "middle"), self._pruned(self.text, True)
        elif self.gaps:
            yield "gap", self.text


def _blocks(batches):
    """(file, block, bytes so far, whether it's the block's end) from rows in file order."""
    key, parts, size = None, [], 0
    for batch in batches:
        files, blocks, values = (batch.column(c) for c in ("file", "block", "value"))
        if not batch.num_rows:
            continue
        names, starts = files.dictionary_encode().indices.to_numpy(), blocks.to_numpy(zero_copy_only=False)
        binary = values.cast(pa.binary())
        edge = [0, *(np.flatnonzero((np.diff(names) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(names)]
        for a, b in zip(edge, edge[1:]):
            now = (files[a].as_py(), int(starts[a]))
            if key is not None and key != now:
                yield (*key, b"".join(parts), True)
                parts = []
            elif parts:
                yield (*key, b"".join(parts), False)
                parts = []
            key = now
            parts = [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), binary.slice(a, b - a)), b"}")[0].as_py(), b"}"]
    if key is not None:
        yield (*key, b"".join(parts), True)


@cache
def single_byte(encoding: str) -> tuple[str, str] | None:
    """Characters of the upper 128 bytes as ISO-8859-1 has them, those that mean nothing last, and what they are in
    ``encoding``; None if that isn't a superset of ASCII with a byte a character."""

    def read(*b: int) -> str:
        return bytes(b).decode(encoding, errors="ignore")

    try:
        each = {b: read(b) for b in range(256)}
    except (UnicodeError, LookupError):
        return None
    if any(each[b] != chr(b) for b in range(128)) or any(read(b, c) != each[b] + each[c] for b in range(128, 256) for c in range(0x30, 256)):
        return None
    upper = sorted(range(128, 256), key=lambda b: not each[b])
    return "".join(map(chr, upper)), "".join(each[b] for b in upper)


def fragments(spark: SparkSession, path, glob: str | None, recursive: bool, separator: str = "}", encoding: str = "UTF-8") -> DataFrame:
    """(file, block, value): the text between separators. In encodings of one byte a character, bytes are cut at the same
    places, and decoded natively (a byte that means nothing is left out)."""
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    value = F.col("value")
    if encoding.upper().replace("-", "") != "UTF8":
        value = F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), *single_byte(encoding)).alias("value")
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value)


WHOLE = 1 << 50  # bytes


def files_in_order(spark: SparkSession, path, glob: str | None, recursive: bool) -> DataFrame:
    """(file, block, value): as :func:`fragments`, but bytes, of a whole file in one task and in order; block is the file's size."""
    # a session of its own has the blocks' size; the result is the caller's session's
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key in sizes:
        own.conf.set(key, str(WHOLE))
    reader = own.read.option("lineSep", "}").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    meta = F.col("_metadata")
    rows = reader.text(path).select(meta["file_path"].alias("file"), meta["file_size"].alias("block"), F.col("value").cast("binary").alias("value"), meta["file_block_start"].alias("start"))
    rows = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows._jdf.logicalPlan()), spark)
    if any(own.conf.get(key) != str(WHOLE) for key in sizes):  # a platform may hold them
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("at", F.monotonically_increasing_id()).repartition(n, "file").sortWithinPartitions("file", "start", "at")
    return rows.select("file", "block", "value")


EDGES = "file string, block bigint, known int, k int, n bigint, head string, tail string, whole boolean"
KNOWN = 2  # the block's state is known: it is its file's first


def _edges(target: list[tuple], want: dict | None = None):
    """Of each block a row with its summaries (known = -1), and one for each way its edges may be cut."""
    array = bool(target)
    names = [x.split()[0] for x in EDGES.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_())

    def run(batches):
        sums, lead, trail, reader, n = None, b"", b"", None, 0
        for file, block, data, end in _blocks(batches):
            if sums is None:
                sums = [Summary(s, array) for s in ((False,) if block == 0 else (False, True))]
                lead, trail, n = b"", b"", 0
                reader = Reader(target, State(), want) if block == 0 else None
            raw = np.frombuffer(data, np.uint8)
            found = structure(raw)
            for s in sums:
                s.feed(data, raw, *found)
            if reader:
                n += sum(place == "record" for place, _ in reader.feed(data))
            elif len(lead) <= LIMIT:
                lead += data[: LIMIT + 1 - len(lead)]
            if not reader:
                trail = data[-LIMIT:] if len(data) >= LIMIT else (trail + data)[-LIMIT:]
            if not end:
                continue
            text = lambda x: None if x is None else x.decode(errors="ignore")
            rows = []
            if reader and want is not None:
                # a piece that is kept is whole, as those that it is joined with
                rows += [(file, block, KNOWN, 0, n, None, text(reader.text), False)] * (reader.open and not reader.pruner)
            elif reader:
                rows += [(file, block, KNOWN, 0, n, None, text(t), False) for _, t in reader.finish()]
            else:
                rows += [(file, block, int(i), k, m, text(head), text(tail), whole) for i, s in enumerate(sums) for k, m, head, tail, whole in s.pieces(lead, trail)]
            kept = [[r[2], r[3], r[6] is not None, r[7]] for r in rows]
            rows.append((file, block, -1, 0, 0, json.dumps([[s.told() for s in sums], kept]), None, False))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            sums = None

    return run


class States:
    """The state at the start of every block, in little: of a block inside the records its depth below them and whether
    a string is open, two numbers, and which of the few ``begins`` its stack has; the first block of a file needs nothing, and others
    (before and behind the records, or within a key) are kept whole. ``deep``: levels below the records that are told apart."""

    def __init__(self, target: list[tuple], deep: int = 0):
        self.target, self.deep = target, len(target) + deep
        self.inside: dict[str, tuple] = {}  # file -> blocks in order, 2 * depth + string, number of the begin
        self.begins: dict[tuple, int] = {}
        self.order: list[tuple] = []
        self.others: dict[tuple[str, int], State] = {}

    def put(self, file: str, block: int, state: State) -> None:
        if not block:
            return
        if _inside(state, self.target) and not state.begun:
            blocks, told, begins = self.inside.setdefault(file, (array("q"), array("l"), array("l")))
            blocks.append(block)
            told.append(2 * len(state.stack) + state.in_string)
            begins.append(self.begins.setdefault(tuple(map(tuple, state.stack[: self.deep])), len(self.begins)))
        else:
            self.others[file, block] = state

    def __getitem__(self, place: tuple[str, int]) -> State:
        file, block = place
        if not block:
            return State()
        if place in self.others:
            return self.others[place]
        blocks, told, begins = self.inside[file]
        i = bisect.bisect_left(blocks, block)
        if i == len(blocks) or blocks[i] != block:
            raise KeyError(place)
        if len(self.order) < len(self.begins):
            self.order = list(self.begins)
        begin = list(self.order[begins[i]])
        return State(begin + [("", None)] * ((told[i] >> 1) - len(begin)), bool(told[i] & 1))


@dataclass
class Plan:
    """The states at the start of all blocks, and which of their kept pieces are true: (file, block, known, k, group of
    the piece at the begin, group of the piece at the end), a group being the block where the record begins;
    None if a piece wasn't kept, or if records of which little is wanted fill whole blocks."""

    states: States
    picks: list[tuple] | None


def _inside(state: State, target: list[tuple]) -> bool:
    return len(state.stack) >= len(target) and state.stack[: len(target)] == target


def fold(rows, target: list[tuple], want: dict | None = None) -> Plan:
    """``rows``: (file, block, summaries) of all blocks."""
    states, picks, whole, now, last, group = States(target, levels(want) + 1 if want is not None else 0), [], True, State(), None, None
    for file, block, text in sorted(rows):
        told, kept = json.loads(text)
        if file != last:
            now, last, group = State(), file, None
        states.put(file, block, now)
        after = advance(now, told[now.in_string] if block else told[0])
        if block == 0:
            if kept:
                picks.append((file, block, KNOWN, 0, None, block))
                group = block
            elif want is not None and after.stack:
                whole = False
        elif _inside(now, target):
            key = [int(now.in_string), len(now.stack) - len(target)]
            mine = next((x for x in kept if x[:2] == key), None)
            if mine is None or (mine[3] and want is not None) or (target and not mine[2] and not mine[3] and _inside(after, target)):
                whole = False
            else:
                picks.append((file, block, *key, group, block if mine[2] else None))
                group = group if mine[3] else block if mine[2] else None
        elif _inside(after, target):
            whole = False  # the array begins in a later block
        now = after
    return Plan(states, picks if whole else None)


def _records(target: list[tuple], states: States, want: dict | None = None):
    schema = ["file", "block", "n", "place", "text"]

    def run(batches):
        reader, count, rows, size = None, 0, [], 0

        def emit():
            nonlocal rows, size
            if rows:
                got = list(zip(*rows))
                yield pa.record_batch([pa.array(got[0]), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64()), pa.array(got[3]), pa.array([(t.strip() if p == "record" else t).decode(errors="ignore") for p, t in zip(got[3], got[4])], pa.large_string()).cast(pa.string())], schema)
            rows, size = [], 0

        for file, block, data, end in _blocks(batches):
            if reader is None:
                count, reader = 0, Reader(target, states[file, block], want)
            for place, text in reader.feed(data):
                count += place == "record"
                rows.append((file, block, count if place == "record" else 0, place, text))
                size += len(text)
                if len(rows) >= 4096 or size > 1 << 24:
                    yield from emit()
            if end:
                rows += [(file, block, count + 1 if place == "tail" else 0, place, text) for place, text in reader.finish()]
                reader = None
        yield from emit()

    return run


SCHEMA = "file string, block bigint, n bigint, place string, text string"


def records(spark: SparkSession, path, keys: list[str], array: bool, glob=None, recursive=False, strategy="fullPass", begin: str | None = None, encoding: str = "UTF-8", want: dict | None = None) -> DataFrame:
    """(file, block, n, text): the records, n counting from 1 in each block (speculation: growing in each). ``begin``: what all
    records begin with, for speculation. ``want``: the keys that matter of root values, see :class:`Pruner`."""
    target = target_stack(keys, array)
    if strategy == "speculation" and (begin or not array) and encoding.upper().replace("-", "") == "UTF8":
        found = _speculated(spark, path, target, glob, recursive, begin) if array else _lines(spark, path, glob, recursive)
        if found is not None:
            return found
    parts = fragments(spark, path, glob, recursive, encoding=encoding)
    edges = keep(parts.mapInArrow(_edges(target, want), EDGES), "edges")
    told = edges.where("known = -1").select("file", "block", "head").toArrow()
    plan = fold(list(zip(*(told.column(i).to_pylist() for i in range(3)))), target, want)
    found = parts.mapInArrow(_records(target, plan.states, want), SCHEMA)
    inside = found.where("place = 'record'").select("file", "block", "n", "text")
    if plan.picks is None and want is not None:
        # pruned pieces are short, so one pass finds them and tells whether whole records stand beside them
        few = found.where("place <> 'record' or n = 1").withColumn("text", F.when(F.col("place") != "record", F.col("text")))
        few = keep(few, "pieces")
        joined = _joined(few)
        if few.where("place = 'record'").isEmpty():
            return joined.where("text <> ''").select("file", "block", "n", "text")
    else:
        joined = _joined(found) if plan.picks is None else _picked(edges, plan.picks)
    if joined is None:
        return inside
    return inside.unionByName(joined.where("text <> ''").select("file", "block", "n", "text"))


def _whole(pieces: DataFrame) -> DataFrame:
    """Records from (file, g, block, o, text, n): their pieces in order; they count where they begin."""
    out = pieces.groupBy("file", "g").agg(F.sort_array(F.collect_list(F.struct("block", "o", "text", "n"))).alias("p"))
    text = F.btrim(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit(" \t\r\n"))
    return out.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"), text.alias("text"))


def _picked(edges: DataFrame, picks: list[tuple]) -> DataFrame | None:
    """Records that cross blocks, from the pieces that the first pass kept."""
    picks = [x for x in picks if x[4] is not None or x[5] is not None]
    if not picks:
        return None
    names, kinds = ["file", "block", "known", "k", "g_head", "g_tail"], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    table = edges.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*picks), kinds)], names))
    mine = edges.join(table, ["file", "block", "known", "k"])
    head = mine.where("g_head is not null").select("file", F.col("g_head").alias("g"), "block", F.lit(0).alias("o"), F.col("head").alias("text"), F.lit(0).cast("bigint").alias("n"))
    tail = mine.where("g_tail is not null").select("file", F.col("g_tail").alias("g"), "block", F.lit(1).alias("o"), F.col("tail").alias("text"), (F.col("n") + 1).alias("n"))
    return _whole(head.unionByName(tail))


def _joined(found: DataFrame) -> DataFrame:
    """Records that cross blocks, from their pieces in a full pass."""
    order = F.when(F.col("place") == "tail", 1).otherwise(0)
    w = Window.partitionBy("file").orderBy("block", order).rowsBetween(Window.unboundedPreceding, 0)
    pieces = found.where("place <> 'record'").withColumn("g", F.sum(F.when(F.col("place") == "tail", 1).otherwise(0)).over(w))
    # a file's last piece may hold the marks that close its document
    return _whole(pieces.select("file", "g", "block", order.alias("o"), "text", "n"))


MOST_ENDS = 100


def _line(begin: str) -> Column:
    """A line as its record's text: the separator put back, the comma behind the record taken off."""
    return F.concat(F.lit(begin), F.regexp_replace("value", r",\s*$", ""))


def _one_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else: what is put behind it is reached only then."""
    return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit(',"w":1}')), "$.w").isNotNull()


def _valid(text: str) -> bool:
    try:
        json.loads(text, strict=False)
        return True
    except ValueError:
        return False


def _odd(target: list[tuple], begin: str):
    """(file, kind, text) of lines that are no whole record: 'head' before a file's first record, 'none' of a file
    without any, 'last' with what follows the file's last record, and 'bad'."""

    def kind(line: str) -> tuple[str, str]:
        try:
            _, end = json.JSONDecoder(strict=False).raw_decode(begin + line)
        except ValueError:
            reader = Reader(target, State())
            if list(reader.feed(line.encode())):
                return "bad", ""
            if reader.inside and reader.cut and not reader.text.strip():
                return "head", line
            return ("none" if _valid(line) else "bad"), line
        rest, after = (begin + line)[end:], Reader(target, State(target, False))
        after.open = after.cut = True
        out = [place for place, _ in (*after.feed((begin + line).encode()), *after.finish())]
        return ("last" if rest.lstrip().startswith("]") and out == ["record"] and not after.stack and not after.in_string else "bad"), rest

    def run(batches):
        for batch in batches:
            told = [kind(x) for x in batch.column("value").to_pylist()]
            yield pa.record_batch([batch.column("file"), pa.array([k for k, _ in told], pa.string()), pa.array([t for _, t in told], pa.string()), batch.column("lines")], ["file", "kind", "text", "lines"])

    return run


def _numbered(lines: DataFrame, text: Column) -> DataFrame:
    n = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return lines.select("file", "block", n.alias("n"), text.alias("text"))


def _lines(spark: SparkSession, path, glob, recursive) -> DataFrame | None:
    """Root values, if each stands in a line of its own; else None."""
    lines = fragments(spark, path, glob, recursive, "\n").withColumn("value", F.btrim("value", F.lit(" \t\r"))).where("value <> ''")
    if not lines.where(~_one_value(F.col("value"))).isEmpty():
        return None
    return _numbered(lines.where(F.substring("value", 1, 1).isin("{", "[")), F.col("value"))


def _speculated(spark: SparkSession, path, target: list[tuple], glob, recursive, begin: str) -> DataFrame | None:
    """The records as Spark's lines, or None if some line isn't one."""
    lines = fragments(spark, path, glob, recursive, begin)
    odd = lines.select("file", F.when(~_one_value(_line(begin)), F.col("value")).alias("odd"))
    odd = odd.groupBy("file").agg(F.count("*").alias("lines"), F.count("odd").alias("c"), F.min("odd").alias("a"), F.max("odd").alias("b"))
    odd = keep(odd, "odd")  # a row a file
    if not odd.where("c not in (1, 2)").isEmpty():
        return None
    each = odd.select("file", "lines", F.explode(F.when(F.col("c") == 1, F.array("a")).otherwise(F.array("a", "b"))).alias("value"))
    told = keep(each.mapInArrow(_odd(target, begin), "file string, kind string, text string, lines bigint"), "told")
    kinds = told.groupBy("file").agg(F.sort_array(F.collect_list("kind")).alias("k"), F.max("lines").alias("lines"))
    fine = (F.col("k") == F.array(F.lit("head"), F.lit("last"))) | ((F.col("k") == F.array(F.lit("none"))) & (F.col("lines") == 1))
    if not kinds.where(~fine).isEmpty():
        return None
    ends = told.select((F.col("kind") == "last").alias("last"), "text").distinct().limit(2 * MOST_ENDS + 1).collect()  # few, else exact mode
    heads, feet = [r["text"] for r in ends if not r["last"]], [r["text"] for r in ends if r["last"]]
    if len(ends) > 2 * MOST_ENDS or sum(map(len, heads + feet)) > LIMIT:
        return None
    own, text = F.concat(F.lit(begin), "value"), _line(begin)
    for foot in sorted(feet, key=len):  # no foot ends as a record does, so the longest that fits is the file's own
        last = ~F.regexp_like("value", F.lit(r",\s*$")) & own.endswith(foot)
        text = F.when(last, F.substring(own, F.lit(1), F.length(own) - len(foot))).otherwise(text)
    return _numbered(lines.where(~F.col("value").isin(heads)) if heads else lines, text)
