"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three transducers, composed with each text as it is read:

* :class:`Normaliser`: an arc a character, along the sources of the character map's rules; where the longest rule
  ends its target is put out, other characters pass. Blanks become the mark U+2581, runs of them one mark where the
  model says so, and a mark is put first.
* :class:`Arcs`, the pieces: from the first state an arc a character along each piece, put out with weight minus
  its score where it ends, from which the first state is reached again.
* byte fallback: a character that no piece begins and ends with is an arc of its own, whose labels are its UTF-8
  bytes (or the unknown piece, a run of which is one label).

The ids are the labels of the shortest path in the tropical semiring (min, +) through the composition: its states are
a place of the text with a state of the pieces, made as they are reached, and weights add up along a path. For
unigram models these are the scores, added as 32-bit floats as the model's makers do. For merge-trained (BPE) models
that path isn't what the model encodes: there a state also has the last piece, an arc from piece x to y
weighs 0 if merging the characters of xy by score gives just x, y, and infinity otherwise. A
segmentation is the model's own exactly if all its neighbours agree so, hence one path is finite, and
each place needs one state: the last piece of the only finite path to it.

In a merge-trained model no piece has a mark after another character, so every run of marks begins words that are
independent; words are encoded apart and kept in a bounded cache. Work is linear in the text.

Defined cases: null and empty texts have no ids; control characters, unpaired bytes and text that looks
like a control piece are ordinary text; repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_arrow

MARK = "▁"
CACHE = 500_000
LONGEST = 64
INF = float("inf")
UNREACHED, SHIFT = -2, 24
_loaded: dict[str, Transducer] = {}


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            x = raw[i]
            value, shift, i = value | (x & 127) << shift, shift + 7, i + 1
            if x < 128:
                return value, i

    while i < len(raw):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            if kind == 2:
                n, i = varint(i)
            else:
                n = 4 if kind == 5 else 8
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


class _Words(dict):
    """Ids of a mark and a word; long words are not kept."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        got = self.owner._word(MARK + word)
        if len(word) <= LONGEST:
            self[word] = got
        return got


class Normaliser:
    """A sequential transducer over characters: arcs along the sources of the rules, their targets where they end."""

    def __init__(self, charsmap: bytes, squeeze: bool, prefix: bool, kept: list[str] = ()):
        self.squeeze, self.prefix = squeeze, prefix
        self.arcs: dict[tuple[int, str], int] = {}
        self.targets: dict[int, str] = {}
        self.states = 1
        for source, target in [*_rules(charsmap), *((x, x) for x in kept)]:  # pieces that users define aren't changed
            state = 0
            for c in source:
                state = self._arc(state, c)
            self.targets[state] = target
        first = "".join(re.escape(c) for state, c in self.arcs if not state)
        self.rule = re.compile(f"[{first}]") if first else None

    def _arc(self, state: int, c: str) -> int:
        if (state, c) not in self.arcs:
            self.arcs[state, c] = self.states
            self.states += 1
        return self.arcs[state, c]

    def _mapped(self, text: str):
        """What is put out for each longest rule, and for the characters between."""
        i, arcs, targets = 0, self.arcs, self.targets
        while i < len(text):
            m = self.rule.search(text, i) if self.rule else None
            if m is None:
                yield text[i:]
                return
            if m.start() > i:
                yield text[i : m.start()]
                i = m.start()
            state, j, best, end = 0, i, text[i], i + 1
            while j < len(text) and (state := arcs.get((state, text[j]))) is not None:
                j += 1
                if state in targets:
                    best, end = targets[state], j
            yield best
            i = end

    def __call__(self, text: str) -> str:
        """The normalised text."""
        if self.rule:
            text = "".join(self._mapped(text))
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        out = (MARK if self.prefix else "") + text.replace(" ", MARK) if text else ""
        return out.rstrip(MARK) if self.squeeze else out  # a mark that ends a text counts as a blank


def _rules(charsmap: bytes):
    """(source, target) of a compiled character map: a double array of 32-bit units, then targets that end with 0."""
    if not charsmap:
        return
    size = int.from_bytes(charsmap[:4], "little")
    units = np.frombuffer(charsmap[4 : 4 + size], "<u4").astype(np.int64)
    strings, every = charsmap[4 + size :], np.arange(1, 256)

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    waiting = [(offset(int(units[0])), b"")]
    while waiting:
        at, source = waiting.pop()
        near = at ^ every
        near, labels = near[near < len(units)], every[near < len(units)]
        there = units[near]
        for k in np.flatnonzero((there & 0x800000FF) == labels).tolist():
            unit, key = int(there[k]), source + bytes([int(labels[k])])
            below = int(near[k]) ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                yield key.decode(errors="replace"), strings[start : strings.index(b"\0", start)].decode()
            waiting.append((below, key))


class Arcs:
    """The pieces as a transducer: ``next`` has each state's arcs by character, ``ends`` the piece and its
    weight where one ends."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float] | None] = [None]
        for piece, end in pieces.items():
            state = 0
            for c in piece:
                got = self.next[state].get(c)
                if got is None:
                    got = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                state = got
            self.ends[state] = end

    def paths(self, text: str, start: int) -> list[tuple[int, int, float]]:
        """(end, piece, weight) of the pieces that begin at a place, shortest first."""
        out, arcs, following, ends, j = [], self.next[0], self.next, self.ends, start
        for c in text[start:]:
            state = arcs.get(c)
            if state is None:
                break
            j += 1
            end = ends[state]
            if end:
                out.append((j, *end))
            arcs = following[state]
        return out


#: Fixed value: how much worse than the worst piece a character without one is.
UNKNOWN_COST = 10.0


class Transducer:
    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        charsmap, self.merges, self.prefix, self.squeeze = b"", False, True, True
        for number, value in _fields(raw):
            if number == 1:
                d = dict(_fields(value))
                self.pieces.append(d.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(d.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(d.get(3, 1))
            elif number == 2:
                d = dict(_fields(value))
                self.merges = d.get(3, 1) == 2
                if d.get(3, 1) not in (1, 2) or d.get(24, 0):
                    raise NotImplementedError("models of words or characters, and marks behind words")
            elif number == 3:
                d = dict(_fields(value))
                charsmap, self.prefix, self.squeeze = d.get(2, b""), bool(d.get(3, 1)), bool(d.get(4, 1))
        own = [p for p, k in zip(self.pieces, self.kinds) if k == 4]
        if own and self.merges:
            raise NotImplementedError("pieces that users define in a merge-trained model")
        self.normal = Normaliser(charsmap, self.squeeze, self.prefix, own)
        self.arcs = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (1, 4)}
        normal = [s for s, k in zip(self.scores, self.kinds) if k == 1]
        most = max(normal, default=0.0)
        weights = [-(len(p.encode()) * most - 0.1) if k == 4 else -s for p, k, s in zip(self.pieces, self.kinds, self.scores)]
        self.machine = Arcs({p: (i, 0.0 if self.merges else weights[i]) for p, i in self.arcs.items()})
        self.piece_at = [-1 if e is None else e[0] for e in self.machine.ends]
        self.missing = 0.0 if self.merges else UNKNOWN_COST - min(normal, default=0.0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        self.unknown = self.kinds.index(2)
        self.apart = self.merges and not any(MARK in p.lstrip(MARK) for p in self.arcs)
        self.agree: dict[int, bool] = {}
        self.inner = {p[i : i + 2] for p in self.arcs for i in range(len(p) - 1)}
        self.words, self.parts = _Words(self), {}
        self.shown = {i: bytes([b]) for b, i in self.bytes.items()}

    # pieces

    def merged(self, text: str) -> list[str]:
        """Segmentation of a short text by merging neighbours, best score first, leftmost among equals."""
        parts, arcs, scores = list(text), self.arcs, self.scores
        gains = [scores[k] if (k := arcs.get(x + y)) is not None else -INF for x, y in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > -INF:
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            for i in (at - 1, at):
                if 0 <= i < len(gains):
                    k = arcs.get(parts[i] + parts[i + 1])
                    gains[i] = scores[k] if k is not None else -INF
        return parts

    def agreement(self, before: int, piece: int) -> bool:
        """Whether a merge-trained model's arc from one piece to the next weighs 0, and not infinity."""
        y = self.pieces[piece]
        if before < 0 or before in self.shown:
            ok = self.merged(y) == [y]
        else:
            x = self.pieces[before]
            ok = self.merged(x + y) == [x, y]
        if len(self.agree) > 3_000_000:
            self.agree.clear()
        self.agree[before << SHIFT | piece] = ok
        return ok

    def fallback(self, c: str) -> list[int]:
        """Labels of a character without a piece."""
        return [self.bytes.get(b, self.unknown) for b in c.encode()] if self.bytes else [self.unknown]

    def _by_scores(self, text: str):
        """The composition's best way to each place: last piece (-1: fallback) and where that begins."""
        n, paths = len(text), self.machine.paths
        cost, last, back = [INF] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here, single = np.float32(cost[i]), False
            for j, piece, w in paths(text, i):
                single |= j == i + 1
                if (total := float(here + np.float32(w))) < cost[j]:
                    cost[j], last[j], back[j] = total, piece, i
            if not single and (total := float(here + np.float32(self.missing))) < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = total, -1, i
        return last, back

    def _by_agreement(self, text: str):
        """As :meth:`_by_scores`, for a merge-trained model, whose weights are zero and infinity: the one finite way.
        States are made in depth, longest pieces first, until the end is reached; a place is reached one way at most."""
        n, first, following, ends, agrees = len(text), self.machine.next[0], self.machine.next, self.piece_at, self.agree.get
        last, back = [UNREACHED] * (n + 1), [0] * (n + 1)
        last[0], behind_bytes, i, waiting = -1, self.bytes.get(0, self.unknown), 0, []
        while last[n] == UNREACHED:
            arcs, j, ways = first, i, []
            for c in text[i:]:
                state = arcs.get(c)
                if state is None:
                    break
                j += 1
                if ends[state] >= 0:
                    ways.append((j, ends[state]))
                arcs = following[state]
            if not ways or ways[0][0] > i + 1:
                ways.insert(0, (i + 1, -1))
            before = last[i]
            waiting.append((i, (before if before >= 0 or not i else behind_bytes) << SHIFT, ways))
            while True:
                i, before, ways = waiting[-1]
                if not ways:
                    waiting.pop()
                    continue
                j, piece = ways.pop()
                if last[j] != UNREACHED:
                    continue
                if piece >= 0:
                    ok = agrees(before | piece)
                    if not ok and (ok is not None or not self.agreement(before >> SHIFT, piece)):
                        continue
                last[j], back[j], i = piece, i, j
                break
        return last, back

    def shortest_path(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        last, back = self._by_agreement(text) if self.merges else self._by_scores(text)
        out: list[list[int]] = []
        j = len(text)
        while j:
            i = back[j]
            own = self.fallback(text[i]) if last[j] < 0 else [last[j]]
            if not (out and own == out[-1] == [self.unknown]):  # a run of unknown characters is one label
                out.append(own)
            j = i
        return [x for own in reversed(out) for x in own]

    def _word(self, word: str) -> bytes:
        """Ids of marks and what follows them. No piece has a pair of neighbours outside ``inner``: cuts there are safe."""
        got = self.parts.get(word)
        if got is not None:
            return got
        inner, cuts = self.inner, [0]
        cuts += [i for i, x in enumerate(map(add, word, word[1:]), 1) if x not in inner]
        parts = []
        for i, j in zip(cuts, [*cuts[1:], len(word)]):
            x = word[i:j]
            got = self.parts.get(x)
            if got is None:
                got = array("I", self.shortest_path(x)).tobytes()
                if len(x) <= LONGEST:
                    if len(self.parts) > CACHE:
                        self.parts.clear()
                    self.parts[x] = got
            parts.append(got)
        return b"".join(parts)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text = self.normal(text or "")
        if not text:
            return b""
        if not self.apart:
            return np.array(self.shortest_path(text), "<u4").tobytes()
        if len(self.words) > CACHE:
            self.words = _Words(self)
        head, *rest = text.split(MARK)
        first = self._word(head) if head else b""
        if MARK + MARK in text or text.endswith(MARK):
            out, lead = [first], MARK
            for x in rest:
                if x:
                    out.append(self.words[x] if lead == MARK else self._word(lead + x))
                    lead = MARK
                else:
                    lead += MARK
            return b"".join([*out, self._word(lead[1:])] if lead != MARK else out)
        return first + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        if not hasattr(self, "spelled"):
            self.spelled = [self.shown.get(i) or (b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(MARK, " ").encode()) for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    """The compiled model of ``path``, once in each Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Transducer(f.read())
    return _loaded[path]


def _rows(path: str, with_ids: bool, step: int = 256):
    def run(batches):
        t = transducer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = batch.column("text").to_pylist()
                ids = [t.encode(x) for x in texts]
                back = [t.decode(x) for x in ids]
                columns = {
                    "doc_id": batch.column("doc_id"),
                    "n_ids": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    "round_trip": pa.array([x == (y or "") for x, y in zip(back, texts)], pa.bool_()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array(back, pa.string())
                yield pa.record_batch(columns)

    return run


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, decoded_sha256, round_trip; with_ids adds ids and decoded."""
    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"
    return by_arrow(docs.select("doc_id", "text"), _rows(model, with_ids), schema + (", ids array<int>, decoded string" if with_ids else ""))
