"""Language identification by words first, then ever shorter character n-grams.

A model has, for each language, smoothed log frequencies of its words and of the character n-grams
(1 to 5) of its words, with marks at word ends. A text's word is scored by its own log frequencies if
the model knows it; an unseen word by the mean over its n-grams of the greatest order of which the
model knows any; a word with no known n-gram says nothing. Scores add up over the whole text; the
posterior under equal priors gives the language and its score.

Fitting takes a bounded sample of the labelled rows of each language (about ``sample_docs``, chosen by a
hash of the text; all if there are no more), so a rare language is learned at any size of the table. Words
of any length are learned from; the tables are bounded (``max_words`` and ``max_grams`` a language), so the model that goes to the
executors has a fixed size. Prediction is a narrow pass over the texts with a bounded cache of words.

Defined cases: null text and texts without a letter are ``und`` with score 0, and so is everything if
no row can be learned from; repeated rows are predicted one by one; nothing but text steers a
prediction.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_arrow, give_back

ORDERS = (5, 4, 3, 2, 1)
CACHE = 200_000
SPREAD = 1 << 52


def plain(word: str) -> str:
    """A word without what isn't a letter at its ends; empty if it has no letter."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b].lower()


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Words and n-grams by row of ``rows``: log frequencies in each language, less their mean.

    ``items`` has both kinds as one text, an item a line, words first: so a model is small wherever it is
    kept, and the tables are made where they are asked."""

    langs: list[str]
    n_words: int
    items: str
    rows: np.ndarray

    def __post_init__(self):
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self) -> tuple[dict[str, int], dict[str, int]]:
        if self._tables is None:
            items = self.items.split("\n") if self.items else []
            words = {x: i for i, x in enumerate(items[: self.n_words])}
            self._tables = words, {x: i for i, x in enumerate(items[self.n_words :], self.n_words)}
        return self._tables

    def vector(self, word: str) -> np.ndarray:
        """A plain word's scores in each language."""
        words, parts = self.tables()
        got = words.get(word)
        if got is not None:
            return self.rows[got]
        for n in ORDERS:
            known = [i for g in grams(word, n) if (i := parts.get(g)) is not None]
            if known:
                return self.rows[known].mean(axis=0)
        return np.zeros(len(self.langs))


def _count():
    """(lang, kind, item, count) of a partition: words, and n-grams of words; counts of words weigh them."""

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words[lang].update(text.split())
        for lang, raw in words.items():
            own, parts = Counter(), Counter()
            for w, c in raw.items():
                if p := plain(w):
                    own[p] += c
            for w, c in own.items():
                for n in ORDERS:
                    for g in grams(w, n):
                        parts[g] += c
            for kind, items in (("w", own), ("g", parts)):
                keys = list(items)
                for i in range(0, len(keys), 50_000):
                    k = keys[i : i + 50_000]
                    yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array([kind] * len(k), pa.string()), pa.array(k, pa.string()), pa.array([items[x] for x in k], pa.int64())], ["lang", "kind", "item", "c"])

    return run


def fit(labelled: DataFrame, sample_docs: int = 6000, max_words: int = 40_000, max_grams: int = 60_000) -> Model:
    """A model from rows (text, lang), both not null."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(float(sample_docs * SPREAD)) / F.col("n")
    rows = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("text"), F.lit(SPREAD)) < share).select("text", "lang")
    counts = by_arrow(rows, _count(), "lang string, kind string, item string, c bigint").groupBy("lang", "kind", "item").agg(F.sum("c").alias("c")).where("c > 1 or kind = 'g'")
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("c"), "item"))
    top = counts.withColumn("p", place).where(F.col("p") <= F.when(F.col("kind") == "w", max_words).otherwise(max_grams)).drop("p")
    got = top.toArrow()  # bounded by the languages and the two limits; columns, not a Row object for each item
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return Model([], 0, "", np.zeros((0, 0), np.float32))
    items, rows, n_words = [], [], 0
    for kind in ("w", "g"):
        part = got.filter(pc.equal(got.column("kind"), kind))
        code = part.column("item").combine_chunks().dictionary_encode()
        counts = np.full((len(code.dictionary), len(langs)), 0.5)
        own = np.searchsorted(langs, part.column("lang").to_pylist())
        counts[code.indices.to_numpy(), own] += part.column("c").to_numpy()
        items += code.dictionary.to_pylist()
        logs = np.log(counts / np.maximum(counts.sum(axis=0), 1.0))
        rows.append((logs - logs.mean(axis=1, keepdims=True)).astype(np.float32))
        n_words = len(items) if kind == "w" else n_words
    return Model(langs, n_words, "\n".join(items), np.concatenate(rows))


class Predictor:
    """Predicts texts by a model; words are scored once and kept, ``CACHE`` of them at most."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.model.langs))), np.float32)
        self.lettered = np.zeros(1024, bool)

    def close(self) -> None:
        """Drop all tables: a worker that waits for its next task keeps nothing."""
        self._clear()
        self.model._tables = None

    def _learn(self, fresh: set[str]) -> None:
        model, cache = self.model, self.cache
        while len(cache) + len(fresh) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.lettered = np.concatenate((self.lettered, np.zeros_like(self.lettered)))
        for w in fresh:
            i = cache[w] = len(cache)
            p = plain(w)
            self.lettered[i] = bool(p)
            self.rows[i] = model.vector(p) if p and model.langs else 0.0

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = text.split() if text else []
        if not self.model.langs or not words:
            return "und", 0.0
        if len(self.cache) > CACHE:
            self._clear()
        ids = list(map(self.cache.get, words))
        if None in ids:
            self._learn({w for w, i in zip(words, ids) if i is None})
            ids = list(map(self.cache.get, words))
        if not self.lettered[ids].any():
            return "und", 0.0
        total = self.rows[ids].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())


def _predict(model: Model):
    def run(batches):
        say = Predictor(model)
        for batch in batches:
            langs, scores = zip(*(say(t.as_py()) for t in batch.column("text"))) if batch.num_rows else ((), ())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])
        say.close()

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out (if there), lang_pred, score."""
    given = [c for c in ("doc_id", "held_out") if c in docs.columns]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in given), "lang_pred string", "score double"])
    return by_arrow(docs.select(*given, "text"), _predict(model), schema)


def held_out(doc_id: str = "doc_id"):
    """Every fourth document, by the checksum of its id's digits (a null id is not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_report(docs: DataFrame, **limits) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; held-out rows are not learned from."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(rows, fit(rows.where(~F.col("held_out")), **limits))


def language_filter(docs: DataFrame, min_score: float = 0.5, **limits) -> DataFrame:
    """The rows of ``docs`` whose language is told with ``min_score`` or more; their columns, whatever their names.

    Null texts and texts without a letter go, and all rows if none can be learned from; rows are judged
    one by one, so repeated ones fare alike; an empty table stays empty."""
    model = fit(docs.where(~held_out()), **limits)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        say = Predictor(model)
        for texts in batches:
            yield pa.array([say(t.as_py())[1] for t in texts], pa.float64())
        say.close()
        give_back()

    return docs.where(F.arrow_udf(scores, "double")(F.col("text")) >= min_score)
