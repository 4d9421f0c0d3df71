import json
import random

import pytest

from jsonweave.plans.needs import needs, wanted
from jsonweave.plans.paths import build
from jsonweave.sources import reader, splitter
from jsonweave.sources.reader import read_json_path

KEYS = ["a", "b", "c}", 'd"', "a\\", "é"]


def _value(r, depth):
    x = r.random()
    if depth > 3 or x < 0.3:
        return r.choice([1, None, True, "a}b", 'q"u\\o', "[{,", "é😀", "", '"a":1', "}\\"])
    if x < 0.8:
        return {r.choice(KEYS): _value(r, depth + 1) for _ in range(r.randrange(6))}
    return [_value(r, depth + 1) for _ in range(r.randrange(4))]


def _only(value, want):
    """What is wanted of a value; other arrays count as empty."""
    if want is None:
        return value
    if isinstance(value, dict):
        return {k: _only(v, want[k]) for k, v in value.items() if k in want}
    return (value if splitter.LISTS in want else []) if isinstance(value, list) else value


def _want(r, depth=0):
    return {k: _want(r, depth + 1) if depth < 2 and r.random() < 0.4 else None for k in r.sample(KEYS, r.randrange(1, 3))} | ({splitter.LISTS: None} if r.random() < 0.2 else {})


def test_pruned_pieces_of_any_blocks_hold_all_that_is_wanted(monkeypatch):
    r = random.Random(5)
    for _ in range(400):
        monkeypatch.setattr(splitter, "LIMIT", r.choice([0, 20, 1 << 20]))
        roots = [{r.choice(KEYS): _value(r, 0) for _ in range(r.randrange(6))} if r.random() < 0.9 else [_value(r, 1)] for _ in range(r.randrange(1, 4))]
        text, want = "\n".join(json.dumps(x, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for x in roots), _want(r)
        parts = text.encode().split(b"}")
        parts = parts[:-1] if parts[-1] == b"" else parts
        blocks, now = [], []
        for p in parts:
            now.append(p)
            if r.random() < 0.3:
                blocks.append(now)
                now = []
        blocks += [now] if now else []
        states, state, got, piece = splitter.States([], splitter.levels(want) + 1), splitter.State(), [], None
        for n, block in enumerate(blocks):
            states.put("f", n, state)
            found, own = [], splitter.Reader([], states["f", n], want)
            for p in block:
                found += own.feed(p + b"}")
            for place, x in [*found, *own.finish()]:
                if place == "record":
                    got.append(x)
                elif place == "tail":
                    piece = x
                elif piece is not None:
                    piece += x
                    if place == "head":
                        got.append(piece)
                        piece = None
            state = splitter.advance(state, splitter.summarise(b"}".join(block) + b"}", state.in_string))
        got += [piece] if piece is not None else []
        assert [_only(json.loads(x), want) for x in got] == [_only(x, want) for x in roots], (text, want, got)


def test_neighbours_that_are_not_wanted_leave_one():
    own = splitter.Reader([], splitter.State(), {"k70": None})
    doc = json.dumps({f"k{i}": {"x": [i] * 9} if i % 2 else i for i in range(200_000)}).encode()
    text = b"".join(x for _, x in [*own.feed(doc), *own.finish()])
    assert json.loads(text)["k70"] == 70 and len(text) < 100


def test_wanted_keys_of_paths():
    want = lambda path: wanted(needs(build(path), None))
    assert want("$.a") == {"a": None} and want("$.a.b;$.a.c") == {"a": {"b": None, "c": None, splitter.LISTS: None}}
    assert want("$.a(@.x == 1).b[*].c") == {"a": {"x": None, "b": None}} and want("$") is want("$..a") is want("$.*") is None


@pytest.mark.parametrize("block", ["128m", "1m", "64k"])
def test_a_long_document_is_never_one_record(spark, tmp_path, monkeypatch, block):
    rows = [{"id": i, "k": [{"partial": i}], "t": "x}" + "y" * 300} for i in range(6000)]
    doc = {"source": 'a {x} "y"', "orders": rows, "partial": False, "more": {"rows": rows[:100], "total": {"n": 5}}, "b": rows}
    (tmp_path / "d.json").write_text(json.dumps(doc) + "\n" + json.dumps({"partial": True, "more": {"total": {"n": 6}}}) + "\n")
    texts, split = [], reader.split_records
    monkeypatch.setattr(reader, "split_records", lambda *a: texts.append(split(*a)) or texts[-1])
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", block)
    own.conf.set("spark.sql.files.openCostInBytes", block)
    got = lambda path, **o: sorted(tuple(map(str, r)) for r in read_json_path(own, str(tmp_path / "d.json"), path, **o).collect())
    assert got("$.partial") == got("$.partial", schema_builder="fullPass") == [("False",), ("True",)]
    assert got("$.more.total.n") == [("5",), ("6",)]
    assert got("$.source;$.partial") == [("None", "True"), ('a {x} "y"', "False")]
    for t in texts:
        assert max(len(r["text"]) for r in t.collect()) < 1 << 14
