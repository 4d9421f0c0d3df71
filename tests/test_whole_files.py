import json

import pytest

from jsonweave.sources.reader import read_json_path

ROWS = [{"id": i, "t": "x}\\" + 'é"' * 3, "k": [{"a": i}]} for i in range(30_000)]


def _ids(df):
    return [r["id"] for r in df.select("id").collect()]


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16", "UTF-16-LE", "ISO-8859-1", "Shift-JIS"])
def test_a_whole_file_is_read_as_a_stream(spark, tmp_path, encoding):
    rows = [r | {"t": r["t"].replace("é", "ｽ" if encoding == "Shift-JIS" else "é")} for r in ROWS[:3000]]
    for n, end in enumerate(("", "\n")):
        (tmp_path / f"{n}.json").write_bytes(json.dumps({"h": {"id": 7}, "r": rows, "n": n}, ensure_ascii=False, indent=n or None).encode(encoding) + end.encode(encoding.replace("UTF-16", "UTF-16-LE") if encoding == "UTF-16" else encoding))
    got = read_json_path(spark, str(tmp_path), "$.r[*]", partitioning="whole", encoding=encoding)
    assert sorted((r["id"], r["t"], r["k"][0]["a"]) for r in got.collect()) == sorted((r["id"], r["t"], r["k"][0]["a"]) for r in rows * 2)
    assert sorted(r[0] for r in read_json_path(spark, str(tmp_path), "$.n", partitioning="whole", encoding=encoding).collect()) == [0, 1]


def test_a_task_never_holds_a_whole_file(spark, tmp_path):
    """Spark refuses files as single values from a size on: streams have none."""
    (tmp_path / "d.json").write_text(json.dumps({"r": ROWS, "partial": False}))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:
        got = read_json_path(spark, str(tmp_path / "d.json"), "$.r[(@.id >= 100)]", partitioning="whole", keep_index=True)
        assert [r["id"] for r in got.orderBy("partition_row_index").collect()] == [*range(100, 30_000)]
        assert got.agg({"partition_row_index": "max"}).head()[0] == 30_000 and got.rdd.getNumPartitions() == 1
        got.createOrReplaceTempView("whole_rows")  # the rows are the caller's session's
        assert spark.sql("SELECT count(*) FROM whole_rows").head()[0] == 29_900
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_blocks_that_a_platform_holds_are_put_in_order(spark, tmp_path, monkeypatch):
    for n in range(3):
        (tmp_path / f"{n}.json").write_text("﻿" + json.dumps({"r": [r | {"id": r["id"] + n * 3000} for r in ROWS[:3000]]}, indent=n or None))
    kind = type(spark.conf)
    put = kind.set
    monkeypatch.setattr(kind, "set", lambda self, key, value: put(self, key, "20000" if key.startswith("spark.sql.files.") else value))
    got = read_json_path(spark, str(tmp_path), "$.r[*]", partitioning="whole")
    assert sorted(_ids(got)) == [*range(9000)]


@pytest.mark.parametrize("text", ['{"id": 1}\n 5 "a}b" {"id": 2}[]\n{"id": 3} null', '﻿{"id": 1} {"id": 2}{"id": 3}', '1 {"id": 1}{"id": 2}\n\n{"id": 3}\n'])
def test_root_values_of_whole_files(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    got = read_json_path(spark, str(tmp_path / "d.json"), "$", partitioning="whole", schema="struct<id:bigint>")
    assert [r for r in _ids(got) if r is not None] == [1, 2, 3]
    decoder, at, n, text = json.JSONDecoder(), 0, 0, text.removeprefix("﻿")
    while at < len(text.rstrip()):
        at = at + len(text[at:]) - len(text[at:].lstrip())
        _, at = decoder.raw_decode(text, at)
        n += 1
    assert got.count() == n


def test_a_file_that_breaks_off_gets_no_brace(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"r": [{"id": 1}, {"id": 2')
    assert _ids(read_json_path(spark, str(tmp_path / "d.json"), "$.r[*]", partitioning="whole", schema="struct<id:bigint>").where("id is not null")) == [1]
