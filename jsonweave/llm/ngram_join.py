"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when the Jaccard similarity of their sets of n-word shingles is at least
``percent`` / 100. Texts never move: what moves are incidences, 64-bit hashes of shingles (sets are equal
and overlaps counted by those). The steps:

1. *Classes.* Documents of equal sets are one row of the matrix (its least doc_id stands for it), so
   exact copies, however many, cost one row; they are merged before they are shuffled.
2. *Order.* Shingles are put in one order for all documents: those that fall in crowded hash buckets
   (counted over all documents, 2**18 counters whatever the input) come last, others by hash. With
   n shingles, a linked pair shares one among the first n - ceil(percent n / 100) + 1 of each.
3. *Product, first block.* The incidences of those columns are dealt out by column (very crowded columns
   over 16 blocks) and read as a stream; columns with one row say nothing. In a column, every row of
   compatible size is paired with its hub, the document of whose prefix most is shared, and overlap
   counts are accumulated over the columns where a pair meets.
4. *Bound.* A document's signature has the parity of its shingles' number in each of some 2 n hash cells.
   Two signatures differ in no more cells than the sets in shingles, so a pair whose signatures
   differ in more than n1 + n2 - 2 * need cells, need = ceil(percent (n1 + n2) / (100 + percent)), is discarded.
5. *Product, remaining blocks.* For surviving pairs the incidences of both rows are fetched, and overlap
   counts accumulated column block by column block; a pair is discarded as soon as its sum and what is
   left of the shorter row can't reach ``need``.
6. *Residue.* Links give components. A column whose rows all lie in one component has nothing to
   add. In others, rows of different components are paired if their signatures, folded to 256 cells,
   allow it, the most crowded columns of each set aside as far as a linked pair must still meet
   elsewhere. Pairs that meet in fewer columns than their sizes ask for are discarded, the rest go through
   4 and 5. So no link between two components is lost, and none within one is needed.

A group of m near copies costs about m candidates, not m * m. No cap is set anywhere.

Defined cases: a document with fewer words than n has one shingle, its whole sequence; without words
or with null text its set is empty and it links with nothing. A null doc_id links with nothing and has
no component. Rows that share a doc_id are one document, whose links are those of any of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, arrow_batches, by_arrow, drop, marked, marks, release, shuffle_partitions, stash
from .components import connected_components
from .textnum import U, Words, column_words, mix

BUCKET_BITS = 18
BLOCKS = 16


def _sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted shingle set of each document of a slice."""
    grams = w.grams(n)
    for a, b in zip(w.cut[:-1].tolist(), w.cut[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield mix(np.array([xxhash.xxh3_64_intdigest(w.hash[a:b].tobytes())], U))
        else:
            yield np.zeros(0, U)


def prefix_size(n, percent: int):
    return n - (-(-percent * n // 100)) + 1


def needed_overlap(n1, n2, percent: int):
    return -(-percent * (n1 + n2) // (100 + percent))


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for ordinary buckets; for crowded ones twice the binary logarithm of how crowded."""
    mean = max(1.0, counts.sum() / len(counts))
    return np.where(counts >= mean + 6 * np.sqrt(mean) + 8, np.floor(2 * np.log2(np.maximum(counts / mean, 1.0))) + 1, 0).astype(np.uint8)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BUCKET_BITS)).astype(np.int64)


FOLD = 256


def signature(s: np.ndarray) -> np.ndarray:
    """Parities of a set's number of elements in hash cells, a power of two of them, some two an element, as 64-bit words."""
    cells = max(FOLD, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(words: np.ndarray) -> np.ndarray:
    """A signature of ``FOLD`` cells from a larger one."""
    return np.bitwise_xor.reduce(words.reshape(-1, FOLD // 64), axis=0)


def _crowding(n: int):
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for w in column_words(batch.column("text"), fold=True):
                sets = list(_sets(w, n))
                counts += np.bincount(_bucket(np.concatenate(sets)), minlength=len(counts))
        b = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(b, pa.int64()), pa.array(counts[b], pa.int64())], ["bucket", "c"])

    return run


OWN = "doc_id bigint, n bigint, key binary, head binary, sign array<bigint>, f0 bigint, f1 bigint, f2 bigint, f3 bigint"


def _own(n: int, percent: int, levels: np.ndarray):
    """Per document the size and digest of its set, its first shingles in the common order, and its signatures."""

    def run(batches):
        for batch in batches:
            sizes, keys, heads, signs, folds = [], [], [], [], []
            for w in column_words(batch.column("text"), fold=True):
                for s in _sets(w, n):
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    signs.append(signature(s))
                    folds.append(folded(signs[-1]))
                    if len(s):
                        own = levels[_bucket(s)]
                        if own.any():
                            s = s[np.lexsort((s, own))]
                        s = s[: prefix_size(len(s), percent)]
                    heads.append(s.tobytes())
            if sizes:
                kinds = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(heads, pa.binary()), pa.array(signs, pa.list_(pa.int64())), *(pa.array(f, pa.int64()) for f in np.array(folds).T)]
                yield pa.record_batch([batch.column("doc_id"), *kinds], ["doc_id", "n", "key", "head", "sign", "f0", "f1", "f2", "f3"])

    return run


def _incidences(levels: np.ndarray):
    """(h, pack, doc): pack has set size and place in the order; crowded columns carry a block number in h."""

    def run(batches):
        for batch in batches:
            docs, sizes, heads = (batch.column(i) for i in range(3))
            h = [np.frombuffer(x.as_py(), U) for x in heads]
            long = np.array([len(x) for x in h], np.int64)
            if not long.sum():
                continue
            h = np.concatenate(h)
            d = np.repeat(docs.to_numpy(zero_copy_only=False), long)
            place = np.arange(len(h)) - np.repeat(np.cumsum(long) - long, long)
            pack = (np.repeat(sizes.to_numpy(zero_copy_only=False), long) << 32) | place
            h = h & ~U(BLOCKS - 1)
            crowded = levels[_bucket(h)] > 0
            h = np.where(crowded, h | (mix(d.astype(U)) & U(BLOCKS - 1)), h)
            for i in range(0, len(h), 1 << 18):
                yield pa.record_batch([pa.array(x[i : i + (1 << 18)]) for x in (h.view(np.int64), pack, d)], ["h", "pack", "doc"])

    return run


def _shared(levels: np.ndarray):
    """From rows in order of h: those of columns with two rows or more, and of crowded columns."""
    names = ["h", "pack", "doc"]

    def run(batches):
        last_h, waiting = None, None
        for batch in batches:
            cells = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            h = cells[0]
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            goes_on = last_h is not None and h[0] == last_h
            keep = np.concatenate(([goes_on], same)) | np.concatenate((same, [False])) | (levels[_bucket(h.view(U))] > 0)
            out = [[c[keep]] for c in cells]
            if waiting is not None and goes_on:
                for o, c in zip(out, waiting):
                    o.append(c)
            waiting = None if keep[-1] else [c[-1:] for c in cells]
            last_h = h[-1]
            yield pa.record_batch([pa.array(np.concatenate(o)) for o in out], names)

    return run


def _rows(n: int):
    """(doc_id, cells): the incidences of a document, its shingles in order of hash."""

    def run(batches):
        for batch in batches:
            cells = [s.tobytes() for w in column_words(batch.column("text"), fold=True) for s in _sets(w, n)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(cells, pa.binary())], ["doc_id", "cells"])

    return run


def reaches(s: np.ndarray, t: np.ndarray, need: int, block: int = 512) -> bool:
    """Whether two rows share ``need`` columns, counted block by block in order of hash."""
    total = j = 0
    for i in range(0, len(s), block):
        x = s[i : i + block]
        k = len(t) if i + block >= len(s) else int(np.searchsorted(t, x[-1], "right"))
        if k > j:
            place = np.searchsorted(x, t[j:k])
            place[place == len(x)] = 0
            total += int((x[place] == t[j:k]).sum())
        j = k
        if total + min(len(s) - i - block, len(t) - j) < need and total < need:
            return False
    return total >= need


def _accumulated(percent: int):
    """The candidate pairs that link."""

    def run(batches):
        for batch in batches:
            left, right = ([np.frombuffer(x.as_py(), U) for x in batch.column(c)] for c in ("cells_a", "cells_b"))
            kept = [
                bool(len(s)) and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and reaches(s, t, needed_overlap(len(s), len(t), percent))
                for s, t in zip(left, right)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _size(pack) -> Column:
    return F.shiftright(pack, 32)


def _least_shared(pack_x, pack_y, percent: int) -> Column:
    """How many columns of their prefixes a linked pair shares at least: its overlap, less all the
    columns of one of the two that are beyond its prefix."""
    need = F.ceil(percent * (_size(pack_x) + _size(pack_y)) / (100 + percent))
    beyond = F.greatest(*(F.ceil(percent * _size(p) / 100) - 1 for p in (pack_x, pack_y)))
    return F.greatest(need - beyond, F.lit(1))


def _spared(least: Column) -> Column:
    """How many of a row's most crowded columns needn't be multiplied, if ``least`` are shared."""
    return F.floor((least - 1) / 2)


def _promising(met: DataFrame, percent: int, spared: bool) -> DataFrame:
    """Pairs (a, b) that meet in enough columns (rows: documents and packs of both)."""
    least = _least_shared("pack", "other_pack", percent)
    cells = met.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"), (least - _spared(least) if spared else least).alias("least"))
    return cells.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("least").alias("least")).where("c >= least").select("a", "b")


def _differ(x: str, y: str) -> Column:
    """In how many cells two signatures differ; the longer one is folded. (If one is four times as long, sizes are incompatible.)"""
    least = F.least(F.size(x), F.size(y))

    def at(c: str, i: Column) -> Column:
        return F.get(F.col(c), i).bitwiseXOR(F.coalesce(F.get(F.col(c), i + least), F.lit(0).cast("bigint")))

    cells = F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.bit_count(at(x, i).bitwiseXOR(at(y, i))))
    return F.aggregate(cells, F.lit(0), lambda total, c: total + c)


def _slack(size_x: Column, size_y: Column, percent: int) -> Column:
    """In how many shingles the sets of a linked pair may differ."""
    return size_x + size_y - 2 * F.ceil(percent * (size_x + size_y) / (100 + percent))


def _links(pairs: DataFrame, docs: DataFrame, own: DataFrame, n: int, percent: int, name: str, shelf: list[str]) -> DataFrame:
    """The pairs that link: by their signatures first, then by all columns."""

    def ends(p: DataFrame) -> DataFrame:
        return stash(p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids", shelf)

    def sides(p: DataFrame, rows: DataFrame) -> DataFrame:
        a, b = (rows.select(*(F.col(c).alias(v if c == "doc_id" else f"{c}_{v}") for c in rows.columns)) for v in "ab")
        return p.join(a, "a").join(b, "b")

    ids = ends(pairs)
    signs = marked(own.where("n > 0").select("doc_id", "n", "sign"), marks(ids)).join(ids, "doc_id")
    near = sides(pairs, stash(signs, f"{name}-signs", shelf)).where(_differ("sign_a", "sign_b") <= _slack(F.col("n_a"), F.col("n_b"), percent))
    near = stash(near.select("a", "b").distinct(), f"{name}-near", shelf)
    ids = ends(near)
    rows = by_arrow(marked(docs, marks(ids)), _rows(n), "doc_id bigint, cells binary").join(ids, "doc_id")
    full = sides(near, stash(rows, f"{name}-rows", shelf, batch=1000)).select("a", "b", "cells_a", "cells_b")
    out = stash(by_arrow(full, _accumulated(percent), "a bigint, b bigint"), name, shelf, batch=256)
    del full
    release(docs.sparkSession)
    return out


def _compatible(pack_x, pack_y, percent: int) -> Column:
    return 100 * F.least(_size(pack_x), _size(pack_y)) >= percent * F.greatest(_size(pack_x), _size(pack_y))


def _with_hubs(rows: DataFrame, percent: int) -> DataFrame:
    """Each row of a column with the column's row of highest score, if their sizes are compatible."""
    best = rows.groupBy("k").agg(F.max(F.struct("score", "doc", "pack")).alias("m"))
    best = best.select("k", F.col("m.doc").alias("other"), F.col("m.pack").alias("other_pack"))
    return rows.join(best, "k").where((F.col("doc") != F.col("other")) & _compatible("pack", "other_pack", percent)).select("doc", "pack", "other", "other_pack")


def _across_components(rows: DataFrame, parts: DataFrame, own: DataFrame, percent: int, shelf: list[str]) -> DataFrame:
    """Pairs of rows of one column that lie in different components, of compatible sizes, by their folded signatures.

    Columns are ordered by their number of rows. If a pair shares s columns of the prefixes at least, it
    shares s - t of them when each of the two leaves out its t most crowded ones: what is left out of the
    shared columns is the crowded end of their order, the same for both.
    """
    label = F.coalesce("component", "doc").alias("comp")
    named = rows.join(parts.withColumnRenamed("node", "doc"), "doc", "left").select("k", "pack", "doc", label)
    mixed = named.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("crowd")).where("lo <> hi").select("k", "crowd")
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("crowd"), F.desc("k"))) - 1
    named = named.join(mixed, "k").select("k", "pack", "doc", "comp", place.alias("place"))
    signs = own.where("n > 0").select(F.col("doc_id").alias("doc"), F.col("n").alias("size"), *(f"f{i}" for i in range(4))).distinct()
    named = stash(named.join(signs, (named["doc"] == signs["doc"]) & (_size("pack") == F.col("size"))).select("k", "pack", named["doc"], "comp", "place", *(f"f{i}" for i in range(4))), "ngram-mixed", shelf)
    x, y = named.alias("x"), named.alias("y")
    size_x, size_y = _size("x.pack"), _size("y.pack")
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.f{i}").bitwiseXOR(F.col(f"y.f{i}"))) for i in range(4)))
    return x.join(
        y,
        (F.col("x.k") == F.col("y.k"))
        & ((size_x < size_y) | ((size_x == size_y) & (F.col("x.doc") < F.col("y.doc"))))
        & (F.col("x.comp") != F.col("y.comp"))
        & _compatible("x.pack", "y.pack", percent)
        & (F.least("x.place", "y.place") >= _spared(_least_shared("x.pack", "y.pack", percent)))
        & (differ <= _slack(size_x, size_y, percent)),
    ).select(F.col("x.doc").alias("doc"), F.col("x.pack").alias("pack"), F.col("y.doc").alias("other"), F.col("y.pack").alias("other_pack"))


def _merge(parts: DataFrame, links: DataFrame, shelf: list[str]) -> DataFrame:
    """Components after further links."""
    a, b = (parts.select(F.col("node").alias(v), F.col("component").alias(f"c{v}")) for v in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    whole = connected_components(between, shelf).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return parts.join(whole, "component", "full").select(F.coalesce("node", "component").alias("node"), F.coalesce("whole", "component").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with arrow_batches(spark, 2000):
        crowding = by_arrow(docs, _crowding(n), "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # 2**18 rows at most
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[crowding.column("bucket").to_numpy()] = crowding.column("c").to_numpy()
    levels = _levels(counts)
    with Shelf(spark) as shelf:
        own = stash(by_arrow(docs, _own(n, percent, levels), OWN), "ngram-own", shelf, batch=2000)
        # a class's copies are merged where they are read, so a hot one moves a row a task
        first = own.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "head")).alias("m")).select("m.*")
        cells = by_arrow(first, _incidences(levels), "h bigint, pack bigint, doc bigint")
        cells = cells.repartition(2 * shuffle_partitions(spark), "h").sortWithinPartitions("h", "pack")
        rows = stash(by_arrow(cells, _shared(levels), "h bigint, pack bigint, doc bigint"), "ngram-columns", shelf)
        del first, cells
        sizes = stash(own.select("doc_id", "n", "key"), "ngram-sets")
        own = stash(own.drop("head", "key"), "ngram-signs", shelf)
        drop(spark, shelf.pop(0))
        release(spark)

        # How much of a document's prefix is shared: the texts that others were made from come first.
        head = F.shiftright("pack", 32) - F.ceil(percent * F.shiftright("pack", 32) / 100) + 1
        score = rows.groupBy("doc").agg((F.count("*") / F.max(head)).alias("score"))
        rows = stash(rows.select(F.shiftright("h", 4).alias("k"), "pack", "doc").join(score, "doc"), "ngram-rows", shelf)
        parts = None
        for name in ("ngram-hubs", "ngram-late"):
            with Shelf(spark) as used:
                met = _with_hubs(rows, percent) if parts is None else _across_components(rows, parts, own, percent, used)
                pairs = stash(_promising(met, percent, parts is not None), f"{name}-pairs", used)
                links = _links(pairs, docs, own, n, percent, name, used)
                parts = stash(connected_components(links, used) if parts is None else _merge(parts, links, used), f"{name}-parts")
                del met, pairs, links
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    found = parts.select(F.col("node").alias("rep"), F.col("component").alias("least"))
    by_key = classes.join(found, "rep", "left").select("key", F.coalesce("least", "rep").alias("least"))
    least = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return sizes.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), least).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of near duplicates stays, that of least doc_id (nulls last; of ties the one read first).

    Rows are judged as rows, so different texts under one doc_id, or without one, are different documents;
    equal rows are one group. (Where doc_ids are null or repeat, rows get numbers and are written once for that.)
    Texts without words are linked with nothing and stay. An empty table stays empty; all columns are carried,
    whatever their names. Only rows that may go are shuffled with their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("rid"))
    if not docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").isEmpty():
        rows = stash(rows.select("row", F.monotonically_increasing_id().alias("rid")), "near-rows")
        found = near_duplicates(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), n, percent)
        found = found.select(F.col("doc_id").alias("rid"), F.col("component_id").alias("comp")).join(rows.select("rid", F.col("row.doc_id").alias("doc_id")), "rid")
        with Shelf(spark) as shelf:
            found = stash(found, "near-groups", shelf)
            first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m"), F.count("*").alias("c")).where("c > 1")
            gone = stash(found.join(first.select("comp", F.col("m.rid").alias("keep")), "comp").where("rid <> keep").select("rid"), "near-gone")
    else:
        gone = stash(near_duplicates(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("rid")), "near-gone")
    bits = marks(gone, "rid")
    kept = marked(rows, bits, "rid", hit=False).unionByName(marked(rows, bits, "rid").join(gone, "rid", "left_anti"))
    return kept.select("row.*")
