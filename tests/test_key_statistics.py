import json

from jsonweave.operators.key_statistics import key_statistics


def test_all_keys_of_all_files_at_any_depth(spark, tmp_path):
    deep = '{"d":[' * 30_000 + "1" + "]}" * 30_000
    (tmp_path / "a.json").write_text('{"rows":[' + json.dumps({"a": 1, "b": {"a": [{"c": 1}, {"c": 2, "e": {}}], "x": [[{"y": None}]]}}) + "," + deep + "]}")
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"a": "{", "z\"q": []}, {"b": 5}]}))
    got = {(r["key"], r["level"]): r["n"] for r in key_statistics(spark, str(tmp_path), "$.rows[*]").collect()}
    assert {k: n for k, n in got.items() if k[0] != "d"} == {("a", 0): 2, ("b", 0): 2, ("a", 1): 1, ("x", 1): 1, ("c", 3): 2, ("e", 3): 1, ("y", 4): 1, ('z"q', 0): 1}
    assert {k: n for k, n in got.items() if k[0] == "d"} == {("d", 2 * i): 1 for i in range(30_000)}
