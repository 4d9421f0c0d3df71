"""The pipeline and its stages against brute force, on hard rows, on clashing columns and on empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jsonweave.llm.langid import language_filter
from jsonweave.llm.ngram_join import drop_near_duplicates
from jsonweave.llm.quality import quality_filter, quality_report
from jsonweave.llm.substring import remove_repeats
from tests.llm.conftest import DOCS, prose
from tests.llm.test_pairs_and_passages import WORD, brute_removal, shingles


def odd(docs):
    """Columns named as the operators' own, and with a dot."""
    names = ("_o", "_cls", "_cleaned", "_q_n_words", "_q_text", "row", "rid", "doc", "cls", "o", "cleaned", "text_a", "_place", "a.b", "m")
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def brute_near(rows):
    """One row of each group: the least doc_id, nulls last, then what comes first."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        key = (r[0] is None, r[0] or 0, i)
        if k not in best or key < best[k]:
            best[k] = key
    return [rows[k[2]] for k in best.values()]


def same_but_ties(got, want):
    """Rows of one group and doc_id may stand for each other: texts are compared by their sets."""
    cut = lambda rows: sorted((str(r[0]), sorted(map(str, shingles(r[1])))[:1] and len(shingles(r[1]))) for r in rows)
    assert cut(got) == cut(want)


def test_near_duplicates_by_row(spark, hard):
    rows = [tuple(r) for r in hard.coalesce(1).collect()]
    same_but_ties([tuple(r) for r in drop_near_duplicates(hard).collect()], brute_near(rows))
    more = spark.createDataFrame([(1, prose(0, 80), "en", "a", 1), (1, prose(4000, 80), "de", "a", 1), (2, prose(0, 80), "en", "b", 1), (None, prose(0, 80), "en", "b", 1), (None, None, None, None, None)], DOCS)
    got = drop_near_duplicates(more).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"]) == [("1", prose(0, 80)), ("1", prose(4000, 80))] and len(got) == 3


def brute_repeats(rows):
    out = []
    for (i, n, gone, sha), r in zip(brute_removal([(r[0], r[1]) for r in rows]), rows):
        if gone < n or not n:
            out.append((i, sha, gone))
    return sorted(out)


def test_repeats_by_row(hard):
    rows = [tuple(r) for r in hard.collect()]
    got = remove_repeats(hard).collect()
    sha = lambda t: hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()
    assert sorted((str(r["doc_id"]), sha(r["text"])) for r in got) == sorted(x[:2] for x in brute_repeats(rows))


@pytest.mark.parametrize("f", [language_filter, quality_filter, drop_near_duplicates, remove_repeats])
def test_stages_carry_all_columns(hard, none, f):
    want, got = f(hard), f(odd(hard))
    assert got.columns == odd(hard).columns and rows_of(got.select(*hard.columns)) == rows_of(want)
    assert want.columns == hard.columns and f(none).count() == 0


def test_quality_filter_keeps_what_the_report_keeps(hard):
    kept = sorted(str(r["doc_id"]) for r in quality_report(hard).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in quality_filter(hard).collect()) == kept


def test_whole_pipeline(spark, hard, tmp_path):
    prose_of = [(100 + i, prose(37 * i, 70 + i), ("en", "de")[i % 2], "p", 1) for i in range(12)]
    docs = hard.unionByName(spark.createDataFrame(prose_of, DOCS))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in now.coalesce(1).collect()]
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns and set(rows_of(after.select("doc_id"))) <= set(rows_of(now.select("doc_id")))
        if name == "ngram_jaccard_join":
            same_but_ties([tuple(r) for r in after.collect()], brute_near(rows))
        now = spark.createDataFrame([tuple(r) for r in after.collect()], DOCS)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {str(r["doc_id"]) for r in pieces} == {str(r["doc_id"]) for r in now.collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    import numpy as np

    crcs = sorted(zlib.crc32(np.array([*t.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in now.collect() if len(t.encode(r["text"], add_special_tokens=False).ids) < 1024)
    assert sorted(r["ids_crc32"] for r in pieces if r["length"] <= 1024 and r["piece"] == 0 and sum(x["doc_id"] == r["doc_id"] for x in pieces) == 1) == crcs


def test_empty_pipeline(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
