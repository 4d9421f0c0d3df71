"""Keys of any length and with dots, filters over values of several types, and edges of blocks."""

import json
import random

import pytest

from jsonweave.sources import splitter
from jsonweave.sources.reader import read_json_path
from tests.test_splitter import _document, _small


@pytest.mark.parametrize("size", [10, 4090, 4200, 70_000])
def test_a_key_of_any_length_is_found(spark, tmp_path, size):
    (tmp_path / "a.json").write_text('{"x": 1, "' + "k" * size + '": [{"i": 1}, {"i": 2}]}')
    got = read_json_path(spark, str(tmp_path), "$." + "k" * size + "[*]", schema="struct<i:bigint>")
    assert sorted(r["i"] for r in got.collect()) == [1, 2]


def test_blanks_before_the_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"r":' + " " * 5000 + '[{"i": 1}], "z": ' + "\n" * 9000 + "[{}]}")
    assert [r["i"] for r in read_json_path(spark, str(tmp_path), "$.r[*]", schema="struct<i:bigint>").collect()] == [1]


def test_keys_with_dots(spark, tmp_path):
    rows = [{"x.y": i, "i": i, "a": {"b": -i}, "a.b": i, "`": "q", "s": {"t.u": [{"v.w": i}]}} for i in range(5)]
    (tmp_path / "a.json").write_text(json.dumps({"r": rows}))
    read = lambda p: read_json_path(spark, str(tmp_path), p)
    assert sorted(r["x.y"] for r in read("$.r[*]").collect()) == [0, 1, 2, 3, 4] and "`" in read("$.r[*]").columns
    assert [r["i"] for r in read("$.r[(@['a.b'] == 3)]").collect()] == [3]
    assert [r["i"] for r in read("$.r[(@.a.b == -2)]").collect()] == [2]
    assert sorted(r[0] for r in read("$.r[(@['x.y'] > 2)]['x.y']").collect()) == [3, 4]
    assert [r[0] for r in read("$.r[(@['x.y'] == 4)].s['t.u'][(@['v.w'] == 4)]['v.w']").collect()] == [4]


def test_filters_over_values_of_several_types(spark, tmp_path):
    rows = [{"i": i, "v": v} for i, v in enumerate([5, "5", "abc", True, None, {"o": 1}, [1], 7.5, "", -1])] + [{"i": 10}]
    (tmp_path / "a.json").write_text(json.dumps({"r": rows, "n": [{"r": rows}]}))
    ids = lambda p: sorted(r["i"] for r in read_json_path(spark, str(tmp_path), p).collect())
    for path in ("$.r[({})]", "$.n[*].r[({})]"):
        assert ids(path.format("@.v < 5")) == [9], path
        assert ids(path.format("@.v == 5")) == [0, 1], path
        assert ids(path.format("@.v == 'abc'")) == [2], path
        assert ids(path.format("@.v in ['abc', 7.5]")) == [2, 7], path
        assert ids(path.format("@.v")) == [3], path
        assert set(ids(path.format("@.v > 'abb'"))) - {5, 6} == {2, 3}, path  # objects and arrays count as their text
        assert 10 in ids(path.format("@.v == null")) and 0 not in ids(path.format("@.v == null")), path


def _cut(text, r):
    parts = text.encode().split(b"}")
    parts = parts[:-1] if parts[-1] == b"" else parts
    blocks, now = [], []
    for p in parts:
        now.append(p)
        if r.random() < 0.4:
            blocks.append(now)
            now = []
    return blocks + ([now] if now else [])


def test_kept_pieces_give_the_records_that_cross_blocks():
    """The first pass over random cuts of random documents: where its picks are whole, they are the second pass's pieces."""
    import pyarrow as pa

    r, whole = random.Random(5), 0
    for _ in range(250):
        text, keys, array, _ = _document(r)
        target = splitter.target_stack(keys, array)
        blocks = _cut(text, r)
        names = [(i, "f", 0 if not i else 100 * i) for i in range(len(blocks))]
        batches = [pa.record_batch([pa.array(["f"] * len(b)), pa.array([names[i][2]] * len(b), pa.int64()), pa.array([x.decode(errors="ignore") for x in b])], ["file", "block", "value"]) for i, b in enumerate(blocks)]
        rows = [x for b in splitter._edges(target)(iter(batches)) for x in b.to_pylist()]
        plan = splitter.fold([(x["file"], x["block"], x["head"]) for x in rows if x["known"] == -1], target)
        found = [x for b in splitter._records(target, plan.states)(iter(batches)) for x in b.to_pylist()]
        want = [(x["block"], x["place"], x["text"], x["n"]) for x in found if x["place"] != "record" and x["text"].strip()]
        if plan.picks is None:
            continue
        whole += 1
        kept = {(x["block"], x["known"], x["k"]): x for x in rows if x["known"] >= 0}
        got = []
        for _, block, known, k, g_head, g_tail in plan.picks:
            x = kept[block, known, k]
            if g_head is not None and x["head"].strip():
                got.append((block, "middle" if x["whole"] else "head", x["head"], 0))
            if g_tail is not None and x["tail"].strip():
                got.append((block, "tail", x["tail"], x["n"] + 1))
        # the end of a document that isn't followed by a record is a piece of none
        assert [g for g in got if g[1] != "tail"] == [w for w in want if w[1] != "tail"][: len([g for g in got if g[1] != "tail"])], text
        assert {g[:3] for g in got} <= {w[:3] for w in want}, text
    assert whole > 150


def test_speculation_needs_no_python_and_falls_back(spark, tmp_path):
    for name, text in {
        "a": json.dumps({"rows": [{"id": i, "t": "]}, {\"id\": 1}"} for i in range(50)], "z": {"q": []}}),
        "b": json.dumps({"rows": []}),
        "c": json.dumps({"rows": [{"id": 100, "t": "x"}]}),
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda **o: read_json_path(_small(spark, 500), str(tmp_path), "$.rows[*]", schema="struct<id:bigint,t:string>", **o)
    got = read(partitioning="speculation")
    want = sorted(map(tuple, read().collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 51
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "d.json").write_text('{"rows": [{"id": 1}, {"t": "y", "id": 2}], "z": [{"id": 7}]}')
    got = read(partitioning="speculation")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, read().collect())) and got.count() == 53


def test_exact_mode_reads_the_text_once_more(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"id": i, "t": "x" * 50} for i in range(400)]}))
    got = read_json_path(_small(spark, 2000), str(tmp_path), "$.rows[*]", schema="struct<id:bigint>")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 400 and plan.count(" text") - plan.count("AS text") >= 1 and plan.count("MapInArrow") == 1


def test_json_lines_by_speculation(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"i": i}) for i in range(30)) + "\n\n")
    read = lambda: read_json_path(_small(spark, 60), str(tmp_path), "$", partitioning="speculation")
    assert sorted(r["i"] for r in read().collect()) == list(range(30))
    assert "MapInArrow" not in read()._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "b.json").write_text(json.dumps({"i": 30}, indent=1) + json.dumps({"i": 31}))
    assert sorted(r["i"] for r in read().collect()) == list(range(32))


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "cp1252", "ISO-8859-15"])
def test_encodings_of_a_byte_a_character_are_split(spark, tmp_path, encoding):
    rows = [{"i": i, "t": "né€Šß}{"[: 1 + i % 7].encode(encoding, errors="replace").decode(encoding)} for i in range(200)]
    (tmp_path / "a.json").write_bytes(json.dumps({"r": rows}, ensure_ascii=False).encode(encoding))
    got = read_json_path(_small(spark, 700), str(tmp_path), "$.r[*]", encoding=encoding)
    assert sorted((r["i"], r["t"]) for r in got.collect()) == [(r["i"], r["t"]) for r in rows]
    assert got.rdd.getNumPartitions() > 5
    assert splitter.single_byte("UTF-16") is None and splitter.single_byte("cp037") is None and splitter.single_byte("shift_jis") is None


def test_records_longer_than_the_first_pass_keeps(spark, tmp_path):
    rows = [{"i": i, "t": "x} \\" * (400_000 if i % 3 == 0 else 3)} for i in range(7)]
    (tmp_path / "a.json").write_text(json.dumps({"h": 1, "r": rows}))
    for how in ("fullPass", "speculation"):
        got = read_json_path(_small(spark, 500_000), str(tmp_path), "$.r[*]", schema="struct<i:bigint,t:string>", partitioning=how)
        assert sorted((r["i"], r["t"]) for r in got.collect()) == [(r["i"], r["t"]) for r in rows], how
