import pytest

from jsonweave.plans.paths import ANY, CHILD, DESCEND, EACH, INDEX, PathError, build, parse_path, split_paths


def kinds(text):
    return [(s.kind, s.name, s.filter) for s in parse_path(text)]


def test_steps():
    assert kinds("$.a..b[*].c") == [(CHILD, "a", None), (DESCEND, "b", None), (EACH, None, None), (CHILD, "c", None)]
    assert kinds("$[*]") == kinds("$.[*]") == kinds("[*]") == [(EACH, None, None)]
    assert kinds("$['a b'][2].*") == [(CHILD, "a b", None), (INDEX, 2, None), (ANY, None, None)]
    assert kinds("$.a[]()(*)") == [(CHILD, "a", None), (EACH, None, None)]


def test_filters():
    assert kinds("$.a[(@.x > 5)]")[1] == (EACH, None, "@.x > 5")
    assert kinds("$.a[?(@.x == 'a)]')].b((@.y))") == [(CHILD, "a", None), (EACH, None, "@.x == 'a)]'"), (CHILD, "b", "@.y")]


def test_several_paths():
    assert split_paths("$.a[(@.x == ';')].b; $.c ;") == ["$.a[(@.x == ';')].b", "$.c"]
    q = build("$.f[(@.p)].g;$.f[(@.q)].h(@.r).t.w")
    assert [n.step.name for n in q.chain] == ["f", None] and q.chain[1].filters == ["@.p", "@.q"]
    assert [c.step.name for c in q.output.children] == ["g", "h"]


def test_whole_document_and_errors():
    assert build("$").chain == [] and build("$").output.ends
    with pytest.raises(PathError):
        parse_path("$.a[(@.x")
