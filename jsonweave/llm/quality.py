"""Quality rules: a table of thresholds, compiled into native projections without user functions.

Every measure is a native column over one row, so the whole filter is a narrow stage over the scan:
no shuffle, no Python, no state. Work per document is O(n log n) in its words.

Defined cases: null, empty and blank texts have no words and fail the base rule; repeated rows are
judged one by one; an empty table gives an empty table; further columns of the input are carried
by :func:`quality_filter` as one struct, so no name of theirs clashes with the measures. Repeated windows
are found by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, text_of, words_of

#: Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for as with was on are by be at or this from an not have had "
    "der die das und in zu den von mit ist des im dem nicht ein eine als auch es an auf für sich "
    "de la le et les des en un une du que est pour dans qui par sur au pas plus "
    "el los las y que del se por con para una su al lo como"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; a bound that is None doesn't count."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Lenient bounds: prose in any of the languages lies far inside them.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.4),
)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows are compared by their 64-bit hash. Sorting (hash, place) pairs finds equal windows; the
    places of those, sorted, give the covered words as a sum of gaps of at most three.
    """
    tri = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                s,
                                lambda x, j: F.struct(
                                    x["i"].alias("i"),
                                    (
                                        F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                                    ).alias("d"),
                                ),
                            ),
                            lambda y: y["d"],
                        ),
                        lambda y: y["i"],
                    )
                ),
                lambda p: F.aggregate(
                    F.transform(p, lambda a, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - a, F.lit(3)))),
                    F.lit(0).cast("bigint"),
                    lambda acc, x: acc + x,
                ),
            ),
        )

    return let(tri, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("bigint")).otherwise(covered(t)))


def measures(docs: DataFrame, text: str = "text", p: str = "_q_") -> DataFrame:
    """``docs`` with the measures of each text in columns that begin with ``p``."""
    t = F.col(f"{p}text")
    lines, words = F.col(f"{p}lines"), F.col(f"{p}words")
    n = F.size(words).cast("bigint")
    out = docs.withColumn(f"{p}text", text_of(text))
    out = out.withColumn(f"{p}words", words_of(t)).withColumn(
        f"{p}lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    )
    found = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        "n_repeat_words": _repeat_words(words, F.size(words)),
    }
    # The generator is a fence: without it, filters on the measures are pushed below the
    # projections, and every measure is computed again for each rule.
    out = out.select(*docs.columns, F.explode(F.array(F.struct(*(c.alias(k) for k, c in found.items())))).alias(p))
    m = {k: F.col(f"{p}.{k}") for k in found}
    some = F.greatest(m["n_words"], F.lit(1))
    ratios = {
        "mean_word_chars": m["word_chars"] / some,
        "symbol_ratio": m["n_symbols"] / some,
        "stop_ratio": m["n_stop"] / some,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "base_failed": (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"]),
    }
    return out.select(*docs.columns, *(c.alias(f"{p}{k}") for k, c in (m | ratios).items()))


def verdict(rules=RULES, p: str = "_q_") -> Column:
    """The rules as one boolean column."""
    tests = [F.col(f"{p}{r.measure}") >= r.low for r in rules if r.low is not None]
    tests += [F.col(f"{p}{r.measure}") <= r.high for r in rules if r.high is not None]
    return reduce(lambda a, b: a & b, tests, ~F.col(f"{p}base_failed"))


def quality_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    got = measures(docs.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return got.select("doc_id", *(F.col(f"_q_{x}").alias(x) for x in names), verdict(rules).alias("kept"))


def quality_filter(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that all rules keep, with the columns of ``docs``, whatever their names."""
    got = measures(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    return got.where(verdict(rules)).select("row.*")
