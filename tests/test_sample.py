import json

import pytest

from jsonweave.sources.reader import read_json_path

N = 1500  # more than the sample


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """Keys, and types of keys, that first occur after the sample."""
    rows = [{"id": i, "k": i, "tags": {"a": 1}, "items": [{"q": 1}]} for i in range(N)]
    rows += [
        {"id": N, "rare": 5, "k": "abc", "tags": {"a": 1, "wiki": "Q1"}, "items": [{"q": 2.5, "late": {"x": "y"}}], "only": {"z": 1}},
        {"id": N + 1, "rare": 6, "k": {"o": 1}, "tags": {"a": 1}, "items": [{"q": "s"}], "only": {"z": 2}},
        {"id": N + 2, "rare": "5x", "k": 7.5, "tags": {"wiki": "Q2", "kind": "b"}, "items": []},
    ]
    path = tmp_path_factory.mktemp("late") / "a.json"
    path.write_text('{"rows": [\n' + ",\n".join(map(json.dumps, rows)) + "\n]}")
    return str(path)


@pytest.mark.parametrize(
    "path, ids",
    [
        ("$.rows[(@.rare == 5)]", [N]),
        ("$.rows[(@.rare > 5)]", [N + 1]),
        ("$.rows[(@.rare != null)]", [N, N + 1, N + 2]),
        ("$.rows[(@.rare in [5, 6])]", [N, N + 1]),
        ("$.rows[(@.only != null)]", [N, N + 1]),
        ("$.rows[(@.k == 'abc')]", [N]),
        ("$.rows[(@.k == 7.5)]", [N + 2]),
        ("$.rows[(@.k > 1498)]", [N - 1]),
        ("$.rows[(@.tags.wiki == 'Q2')]", [N + 2]),
        ("$.rows[(@.none == 1)]", []),
    ],
)
def test_no_sample_decides_which_records_match(spark, late, path, ids):
    got = read_json_path(spark, late, path)
    assert sorted(r["id"] for r in got.collect()) == ids if ids else got.count() == 0


def test_no_sample_decides_which_paths_match(spark, late):
    read = lambda p: [tuple(r) for r in read_json_path(spark, late, p).collect()]
    assert sorted(read("$.rows[*].tags.wiki")) == [("Q1",), ("Q2",)]
    assert sorted(read("$.rows[*].only")) == [(1,), (2,)]
    assert read("$.rows[*].items[(@.late != null)].late.x") == [("y",)]
    assert sorted(r[0] for r in read("$.rows[*].items[*].q"))[-2:] == ["2.5", "s"]
    got = read_json_path(spark, late, "$.rows[(@.rare != null)].id;$.rows[*].tags(@.kind == 'b').wiki").collect()
    assert sorted((r["id"], r["tags"] and r["tags"]["wiki"]) for r in got) == [(N, None), (N + 1, None), (N + 2, "Q2")]


def test_columns_are_those_of_the_first_matches(spark, late):
    got = read_json_path(spark, late, "$.rows[(@.id >= 1500)]")
    assert {"only", "rare"} <= set(got.columns)
    assert "only" not in read_json_path(spark, late, "$.rows[(@.id < 1500)]").columns
