import json
import random

from jsonweave.sources import splitter
from jsonweave.sources.reader import count_records, read_json_path


def _value(r, depth):
    x = r.random()
    if depth > 2 or x < 0.4:
        return r.choice([1, -2, 3.5, None, True, "a}b", 'q"u\\o', "[{,", "é😀", "", "k:1", "\\"])
    if x < 0.7:
        return {r.choice(["a", "b", "k}", 'q"', "items", "z"]): _value(r, depth + 1) for _ in range(r.randrange(4))}
    return [_value(r, depth + 1) for _ in range(r.randrange(4))]


def _document(r):
    records = [_value(r, 0) for _ in range(r.randrange(9))]
    indent = r.choice([None, 1])
    kind = r.choice(["root", "key", "deep", "roots"])
    dump = lambda x: json.dumps(x, ensure_ascii=False, indent=indent)
    if kind == "roots":
        records = [x if isinstance(x, (dict, list)) else {"v": x} for x in records]
        return "\n".join(map(dump, records)), [], False, records
    doc = {"root": records, "key": {"h": _value(r, 1), "items": records, "z": 1}, "deep": {"a": {"x": [1], "items": records}, "items": 2}}[kind]
    return dump(doc), {"root": [], "key": ["items"], "deep": ["a", "items"]}[kind], True, records


def test_any_cut_gives_the_records_of_json_loads():
    r = random.Random(11)
    for _ in range(300):
        text, keys, array, want = _document(r)
        parts = (text + r.choice(["", "\n"])).encode().split(b"}")
        parts = parts[:-1] if parts[-1] == b"" else parts
        blocks, now = [], []
        for p in parts:
            now.append(p)
            if r.random() < 0.3:
                blocks.append(now)
                now = []
        blocks += [now] if now else []
        state, got, piece = splitter.State(), [], None
        for block in blocks:
            data = b"}".join(block) + b"}"
            reader, at = splitter.Reader(splitter.target_stack(keys, array), state), 0
            found = []
            for p in block:
                found += reader.feed(p + b"}")
            for place, x in [*found, *reader.finish()]:
                if place == "record":
                    got.append(x)
                elif place == "tail":
                    piece = x
                elif piece is not None:
                    piece += x
                    if place == "head":
                        got.append(piece)
                        piece = None
            state = splitter.advance(state, splitter.summarise(data, state.in_string))
        got += [piece] if piece is not None else []
        assert [json.loads(x) for x in got if x.strip()] == want


def _small(spark, size):
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    s.conf.set("spark.sql.files.openCostInBytes", str(size))
    return s


def test_files_in_small_blocks(spark, tmp_path):
    rows = [{"id": i, "text": "}{\"é" * (i % 7), "sub": [{"x": i}, {"x": [i, "]"]}]} for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps({"n": {"rows": 3}, "rows": rows, "z": [{"rows": [1]}]}, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"rows": rows[:3]}, indent=2))
    want = sorted([(r["id"], r["text"]) for r in rows + rows[:3]])
    for strategy in ("fullPass", "speculation", "whole"):
        df = read_json_path(_small(spark, 3000), str(tmp_path), "$.rows[*]", partitioning=strategy, schema="struct<id:bigint,text:string>")
        assert sorted((r["id"], r["text"]) for r in df.collect()) == want, strategy
    assert count_records(_small(spark, 3000), str(tmp_path), "$.rows[*]") == 503


def test_misleading_data_fall_back_to_the_exact_split(spark, tmp_path):
    rows = [{"id": i, "text": '{"id": 1}, {"id": 2}' * 20} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    df = read_json_path(_small(spark, 2000), str(tmp_path), "[*]", partitioning="speculation")
    assert sorted(r["id"] for r in df.collect()) == list(range(200))


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"rows": []}')
    (tmp_path / "other.json").write_text('{"rows": {"a": 1}}')
    (tmp_path / "cut.json").write_text('{"rows": [{"a": 1}, {"a": 2}, {"a"')
    df = read_json_path(spark, str(tmp_path), "$.rows[*]", schema="struct<a:bigint>")
    assert sorted(str(r["a"]) for r in df.collect()) == ["1", "2", "None"]


def test_encoding(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('[{"t": "héllo"}, {"t": "ß"}]'.encode("utf-16"))
    df = read_json_path(spark, str(tmp_path / "a.json"), "[*].t", encoding="UTF-16")
    assert sorted(r["t"] for r in df.collect()) == ["héllo", "ß"]
