import hashlib
import re

import pytest

from jsonweave.llm.ngram_join import near_duplicates
from jsonweave.llm.substring import locate, remove_repeats, substring_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("which", ["hard", "clashing"])
def test_components(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(rows)
    got = near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == sorted((str(i), len(shingles(t)), str(want.get(i))) for i, t in rows)


def test_chain_and_families(spark):
    from tests.llm.conftest import DOCS, prose

    rows, w = [], prose(0, 200).split()
    for k in range(12):  # a chain: neighbours link, ends don't
        rows.append((100 + k, " ".join(w[10 * k : 10 * k + 80])))
    base = prose(3000, 100).split()
    for k in range(60):  # a family around a text that is there
        x = list(base)
        x[(k * 7) % 100] = f"edit{k}"
        rows.append((500 + k, " ".join(x)))
    rows.append((499, " ".join(base)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == want
    assert len(set(want.values())) == 2


def test_signatures_bound_the_difference(spark):
    import numpy as np

    from jsonweave.llm.ngram_join import FOLD, _differ, folded, needed_overlap, reaches, signature

    r, rows = np.random.default_rng(4), []
    for _ in range(150):
        n = int(r.integers(1, 700))
        s = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        t = np.unique(np.concatenate((s[: int(r.integers(0, n + 1))], r.integers(0, 2**64, int(r.integers(1, max(2, n))), dtype=np.uint64))))
        share = len(np.intersect1d(s, t))
        fold = int(np.bitwise_count((folded(signature(s)) ^ folded(signature(t))).view(np.uint64)).sum())
        assert fold <= len(s) + len(t) - 2 * share and len(signature(s)) * 64 >= FOLD
        if 2 * min(len(s), len(t)) > max(len(s), len(t)):
            rows.append((signature(s).tolist(), signature(t).tolist(), len(s) + len(t) - 2 * share))
        for need in (1, share, share + 1, needed_overlap(len(s), len(t), 75)):
            assert reaches(s, t, need, 64) == (share >= need)
    got = spark.createDataFrame(rows, "sign_a array<bigint>, sign_b array<bigint>, d int").select(_differ("sign_a", "sign_b").alias("x"), "d").collect()
    assert all(g["x"] <= g["d"] for g in got) and sum(g["x"] > 0.5 * g["d"] for g in got) > 0.7 * len(got)


def brute_removal(rows, width=13):
    first, words = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        words.append(w)
        for k in range(len(w) - width + 1):
            x, o = tuple(w[k : k + width]), 2**63 - 1 if i is None else i
            first[x] = min(o, first.get(x, o))
    out = []
    for (i, _), w in zip(rows, words):
        gone, o = [False] * len(w), 2**63 - 1 if i is None else i
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < o:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["hard", "clashing"])
def test_removal(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring_report(docs).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted(brute_removal(rows))


def test_cleaned_texts_keep_what_is_not_repeated(hard):
    got = {r["doc_id"]: r["text"] for r in remove_repeats(hard).where("doc_id is not null").collect()}
    assert 22 not in got and got[-1] == hard.where("doc_id = -1").head()["text"]
    from tests.llm.conftest import prose

    assert got[21].strip() == prose(200, 30)


def test_locate():
    a, b = b"p q r s t", b"z q r s t"
    got = locate([(a, 1, 1), (b, 2, 2)], 4)
    assert got == [[2**63 - 1, 1], [2**63 - 1, 1]]
    assert locate([(a, 1, 1)], 4) == [None]
    assert locate([(a, 1, 1), (b, 2, 2)], 4, signs=3) == got  # more words than signs: phrases are sequences of numbers


def test_nothing_but_copies_goes_without_the_automaton():
    from jsonweave.llm import substring

    segments = [(b"p q r s t", 1, 1), (b"z q r s t", 2, 2)]
    phrases = substring.confirm(["abcde", "fbcde"], segments, 4)
    assert phrases == {"bcde": 1}
    assert [x for _, x in substring.compile_phrases(phrases, False).iter("xbcdebcde")] == [1, 1]
    full, substring.compile_phrases = substring.compile_phrases, lambda phrases, numbers: None
    try:
        assert locate(segments, 4) == [None, None]
    finally:
        substring.compile_phrases = full


def test_empty(none):
    assert near_duplicates(none).count() == 0 and substring_report(none).count() == 0 and remove_repeats(none).count() == 0
