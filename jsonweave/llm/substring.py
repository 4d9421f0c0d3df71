"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and
located in every text.

A window is ``width`` consecutive words. A word goes if a window covers it whose words also start in a
document with a smaller doc_id, judged on the input. Steps:

1. Documents of equal word sequences are one class (by a 128-bit digest); its least doc_id stands for it. In
   the others every window recurs, so nothing more is needed to know of them.
2. *Anchors.* In every window, the 6-word gram of least hash is its anchor: equal windows have equal
   anchors, and an anchor serves some four windows. Anchors are dealt out by hash and read as a
   stream; those that come twice or more are kept. (About a fifth of the words' number is shuffled.)
3. *Streams.* All of a text that can recur, the words around a kept anchor as far as its windows reach, goes on
   as segments. Equal segments of a task are summed to one with the least and greatest doc_id before they move.
4. *Automata.* Segments of one anchor meet in one shard, some thousand to a shard. Windows of two
   documents or more are confirmed there word by word, with their least doc_id, and become the phrases
   of an Aho-Corasick automaton over the shard's words; the shard's segments stream through it, and its matches
   tell each window's first document. A phrase has all its occurrences in its shard, so the number
   of shards grows with the corpus and the work for a text does not: a whole text would have to pass every shard.
5. *Removal.* What was found goes back to the occurrences of each segment (by its two 64-bit hashes, anchor and
   text), and to the texts.

Anchors in crowded hash buckets (2**18 counters over all documents; 16 times the mean, or more than a
task should hold) are kept without being counted, so they are dealt out by anything; each of their windows is a
segment of its own, dealt out by its own hash, so no anchor gathers an unbounded group.

Defined cases: null and empty texts have no words and stay as they are; rows of one doc_id don't remove
words from each other; a null doc_id counts as greater than any other; repeated rows are treated
alike; texts with fewer words than ``width`` are kept whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, arrow_batches, by_arrow, marked, marks, release, shuffle_partitions, stash
from .ngram_join import BUCKET_BITS, _bucket
from .textnum import U, Words, column_words, mix

GRAM = 6
HELD = 50_000
SHARD = 1000
#: Rows of an Arrow batch, of whole texts and of texts with what was found in them.
ROWS, FOUND_ROWS = 2500, 500
NONE = 2**63 - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _order(batch) -> list[int]:
    """doc_id as an order; null is the greatest."""
    return [NONE if x is None else x for x in batch.column("doc_id").to_pylist()]


def _summaries(batches):
    for batch in batches:
        n, cls, sha = [], [], []
        for t in batch.column("text").to_pylist():
            words = t.encode().split() if t else []
            joined = b" ".join(words)
            n.append(len(words))
            cls.append(xxhash.xxh3_128_digest(joined))
            sha.append(hashlib.sha256(joined).hexdigest())
        yield pa.record_batch([batch.column("doc_id"), pa.array(_order(batch), pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "o", "n_words", "cls", "sha"])


def anchors(w: Words, width: int) -> tuple[np.ndarray, ...]:
    """(document, anchor's word, first and last window start with that anchor), words counted in the slice."""
    none = np.zeros(0, np.int64)
    if len(w.hash) < width:
        return none, none, none, none, np.zeros(0, U)
    grams = w.grams(GRAM)
    reach = width - GRAM + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + np.arange(len(grams) - reach + 1)
    doc = np.repeat(np.arange(len(w.cut) - 1), np.diff(w.cut))
    starts = np.flatnonzero(doc[: len(least)] == doc[width - 1 :])
    if not len(starts):
        return none, none, none, none, np.zeros(0, U)
    at, own = least[starts], doc[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]))))
    last = np.append(new[1:], len(starts)) - 1
    # least hashes are small numbers: scrambled again, they spread over all buckets
    return own[new], at[new], starts[new], starts[last], mix(grams[at[new]])


def crowded_buckets(counts: np.ndarray) -> np.ndarray:
    mean = counts.sum() / len(counts)
    return ((counts >= mean + 6 * np.sqrt(mean) + 8) & (counts >= min(16 * mean, HELD))).astype(np.uint8)


def _crowding(width: int):
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for w in column_words(batch.column("text")):
                counts += np.bincount(_bucket(anchors(w, width)[4]), minlength=len(counts))
        b = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(b, pa.int64()), pa.array(counts[b], pa.int64())], ["bucket", "c"])

    return run


def _anchor_rows(width: int, levels: np.ndarray):
    """(h, o, word): crowded anchors have any h and a negative word, -1 - word."""

    def run(batches):
        for batch in batches:
            order = np.array(_order(batch), np.int64)
            for w in column_words(batch.column("text")):
                doc, at, _, _, h = anchors(w, width)
                if not len(doc):
                    continue
                o = order[w.first + doc]
                crowded, word = levels[_bucket(h)] > 0, at - w.cut[doc]
                h = np.where(crowded, mix(h + mix(o.astype(U) + U(64) * word.astype(U))), h)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(o), pa.array(np.where(crowded, -1 - word, word))], ["h", "o", "word"])

    return run


def _recurring(batches):
    """From rows in order of h: (o, word) of anchors that come twice or more, or are crowded."""
    last_h, waiting = None, None
    for batch in batches:
        h, o, word = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(h):
            continue
        crowded = word < 0
        same = h[1:] == h[:-1]
        keep = np.concatenate(([last_h is not None and h[0] == last_h], same)) | np.concatenate((same, [False])) | crowded
        out = [(o[keep], np.where(crowded, -1 - word, word)[keep])]
        if waiting is not None and h[0] == last_h:
            out.append(waiting)
        waiting = None if keep[-1] else (o[-1:], word[-1:])
        last_h = h[-1]
        yield pa.record_batch([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], ["o", "word"])


def _cut(batches, width: int, levels: np.ndarray):
    """The words around kept anchors, of the rows whose class is theirs: lists of (a, rid, o, start, seg)."""
    for batch in batches:
        texts, cls, order, kept, rids = (batch.column(c) for c in ("text", "cls", "o", "words", "rid"))
        for w in column_words(texts):
            raw = w.data.tobytes()
            rows: list[tuple] = []
            _, at, lo, hi, h = found = anchors(w, width)
            cuts = np.searchsorted(found[0], np.arange(len(w.cut)))
            crowded = levels[_bucket(h)] > 0
            for i in range(len(w.cut) - 1):
                a, b, r = int(cuts[i]), int(cuts[i + 1]), w.first + i
                if a == b or xxhash.xxh3_128_digest(b" ".join(raw[w.doc_at[i] : w.doc_at[i + 1]].split())) != cls[r].as_py():
                    continue  # without windows, or another text under the same doc_id
                first, o, rid = int(w.cut[i]), order[r].as_py(), rids[r].as_py()
                for k in (np.flatnonzero(np.isin(at[a:b] - first, kept[r].values.to_numpy())) + a).tolist():
                    s, e = int(lo[k]), int(hi[k])
                    if crowded[k]:
                        for x in range(s, e + 1):
                            seg = b" ".join(raw[w.start[x] : w.end[x + width - 1]].split())
                            rows.append((xxhash.xxh3_64_intdigest(seg, 1), rid, o, x - first, seg))
                    else:
                        rows.append((int(h[k]), rid, o, s - first, b" ".join(raw[w.start[s] : w.end[e + width - 1]].split())))
            if rows:
                yield rows


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, U).view(np.int64))


def _segments(width: int, levels: np.ndarray, hold: int = 25_000):
    """(a, seg, lo, hi): distinct segments with their least and greatest document, summed before they are shuffled."""

    def run(batches):
        seen: dict[tuple, list[int]] = {}

        def out():
            a, seg = zip(*seen)
            lo, hi = zip(*seen.values())
            return pa.record_batch([_signed(a), pa.array(seg, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "seg", "lo", "hi"])

        for rows in _cut(batches, width, levels):
            for a, _, o, _, seg in rows:
                old = seen.get((a, seg))
                if old is None:
                    seen[a, seg] = [o, o]
                elif o < old[0]:
                    old[0] = o
                elif o > old[1]:
                    old[1] = o
            if len(seen) > hold:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return run


def _occurrences(width: int, levels: np.ndarray):
    """(a, rid, o, start, sh): where segments stand, by their hash."""

    def run(batches):
        for rows in _cut(batches, width, levels):
            a, rid, o, start, seg = zip(*rows)
            yield pa.record_batch([_signed(a), pa.array(rid, pa.int64()), pa.array(o, pa.int64()), pa.array(start, pa.int64()), _signed([xxhash.xxh3_64_intdigest(x) for x in seg])], ["a", "rid", "o", "start", "sh"])

    return run


#: Characters that may stand in a string, less one; with more words, phrases are sequences of numbers.
SIGNS = 0x110000 - 0x800 - 1


def _sign(i: int) -> str:
    """The i-th character that may stand in a string."""
    return chr(i if i < 0xD800 else i + 0x800)


def confirm(lines: list, segments: list[tuple[bytes, int, int]], width: int) -> dict:
    """The windows of two documents or more among the lines of coded words, with the least."""
    ends: dict = {}
    for line, (_, lo, hi) in zip(lines, segments):
        for i in range(len(line) - width + 1):
            x = line[i : i + width]
            old = ends.get(x)
            ends[x] = (lo, hi) if old is None else (min(lo, old[0]), max(hi, old[1]))
    return {x: lo for x, (lo, hi) in ends.items() if lo < hi}


def compile_phrases(phrases: dict, numbers: bool):
    """The automaton of confirmed phrases; a match tells the phrase's first document. None if there is no phrase."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if numbers else ahocorasick.Automaton()
    for x, lo in phrases.items():
        automaton.add_word(x, lo)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def locate(segments: list[tuple[bytes, int, int]], width: int, signs: int = SIGNS) -> list[list[int] | None]:
    """For each segment (words, least and greatest document), per window its first document, if it is of two or more."""
    codes: dict[bytes, int] = {}
    coded = [[codes.setdefault(x, len(codes) + 1) for x in seg.split(b" ")] for seg, _, _ in segments]
    numbers = len(codes) >= signs
    lines = [tuple(x) if numbers else "".join(map(_sign, x)) for x in coded]
    automaton = compile_phrases(confirm(lines, segments, width), numbers)
    out: list[list[int] | None] = []
    for line in lines:
        firsts = None
        for end, lo in automaton.iter(line) if automaton else ():
            if firsts is None:
                firsts = [NONE] * (len(line) - width + 1)
            firsts[end - width + 1] = lo
        out.append(firsts)
    return out


def _automata(width: int):
    """From segments in order of their anchors: (a, sh, firsts) of those with confirmed phrases."""

    def run(batches):
        shard: list[tuple] = []

        def flush(part):
            merged: dict[tuple, tuple] = {}  # a segment comes from several tasks
            for a, seg, lo, hi in part:
                old = merged.get((a, seg), (lo, hi))
                merged[a, seg] = (min(lo, old[0]), max(hi, old[1]))
            firsts = locate([(seg, *ends) for (_, seg), ends in merged.items()], width)
            found = [(a, xxhash.xxh3_64_intdigest(seg), f) for (a, seg), f in zip(merged, firsts) if f]
            if found:
                a, sh, f = zip(*found)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(np.array(sh, U).view(np.int64)), pa.array(f, pa.list_(pa.int64()))], ["a", "sh", "firsts"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "seg", "lo", "hi"))):
                if len(shard) >= SHARD and row[0] != shard[-1][0]:
                    yield from flush(shard)
                    shard = []
                shard.append(row)
        yield from flush(shard)

    return run


def _removals(width: int):
    """(o, cls, n_removed, kept_sha256, cleaned) of rows (o, cls, text, found)."""

    def run(batches):
        for batch in batches:
            texts, found = batch.column("text"), batch.column("found")
            order, cls = batch.column("o").to_numpy(), batch.column("cls").to_pylist()
            upto, each = found.offsets.to_numpy(), found.values
            start, firsts = each.field("start").to_numpy(), each.field("firsts")
            cut, first = firsts.offsets.to_numpy(), firsts.values.to_numpy()
            rows = []
            for w in column_words(texts):
                raw = w.data.tobytes()
                for i in range(len(w.cut) - 1):
                    r, a, b = w.first + i, int(w.cut[i]), int(w.cut[i + 1])
                    begin, close = raw[w.doc_at[i] : w.doc_at[i + 1]], int(w.doc_at[i])
                    if xxhash.xxh3_128_digest(b" ".join(begin.split())) != cls[r]:
                        continue  # another text under the same doc_id
                    s, e = upto[r], upto[r + 1]
                    long = np.diff(cut[s : e + 1])
                    at = np.repeat(start[s:e] - cut[s:e], long) + np.arange(cut[s], cut[e])
                    at = at[first[cut[s] : cut[e]] < order[r]]
                    steps = np.bincount(at, minlength=b - a + width + 1) - np.bincount(at + width, minlength=b - a + width + 1)
                    gone = np.cumsum(steps)[: b - a] > 0
                    first_at, end = w.start[a:b] - close, w.end[a:b] - close
                    kept = b" ".join([begin[s:e] for s, e in zip(first_at[~gone].tolist(), end[~gone].tolist())])
                    # runs of kept words keep the white space between them; a removed run leaves what stood before it
                    edge = np.diff(np.concatenate(([True], gone, [True])).astype(np.int8))
                    runs = [begin[s:e] for s, e in zip(first_at[np.flatnonzero(edge[:-1] == -1)].tolist(), end[np.flatnonzero(edge[1:] == 1)].tolist())]
                    rows.append((int(order[r]), cls[r], int(gone.sum()), hashlib.sha256(kept).hexdigest(), b"\n".join(runs).decode()))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["o", "cls", "n_removed", "kept_sha256", "cleaned"])

    return run


def repeated_words(docs: DataFrame, width: int = 13) -> tuple[DataFrame, DataFrame]:
    """Two frames. One row per input row: doc_id, o (its order), n_words, cls, sha, rep (its class's least o).
    One row per (o, cls) that loses words though it is its class's first: n_removed, kept_sha256, cleaned."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = 2 * shuffle_partitions(spark)
    own = stash(by_arrow(docs, _summaries, "doc_id bigint, o bigint, n_words bigint, cls binary, sha string"), "sub-own", batch=ROWS)
    reps = own.groupBy("cls").agg(F.min("o").alias("rep"))
    with arrow_batches(spark, ROWS):
        crowding = by_arrow(docs, _crowding(width), "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # 2**18 rows at most
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[crowding.column("bucket").to_numpy()] = crowding.column("c").to_numpy()
    levels = crowded_buckets(counts)

    with Shelf(spark) as shelf:
        cells = by_arrow(docs, _anchor_rows(width, levels), "h bigint, o bigint, word bigint").repartition(parts, "h").sortWithinPartitions("h")
        kept = by_arrow(cells, _recurring, "o bigint, word bigint")
        firsts = own.where(f"n_words >= {width}").select("o", "cls").distinct().join(reps, "cls").where("o = rep").select("o", "cls")
        kept = kept.groupBy("o").agg(F.collect_set("word").alias("words")).join(firsts, "o").withColumn("rid", F.monotonically_increasing_id())
        kept = stash(kept, "sub-anchors", shelf, batch=ROWS)
        del cells
        release(spark)

        texts = docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("o"), "text")
        near = stash(marked(texts, marks(kept, "o"), "o").join(kept, "o").select("rid", "o", "cls", "text", "words"), "sub-texts", shelf)
        release(spark)
        segments = by_arrow(near, _segments(width, levels), "a bigint, seg binary, lo bigint, hi bigint").repartition(parts, "a").sortWithinPartitions("a")
        phrases = stash(by_arrow(segments, _automata(width), "a bigint, sh bigint, firsts array<bigint>"), "sub-phrases", shelf, batch=ROWS)
        del segments
        release(spark)

        hits = by_arrow(near, _occurrences(width, levels), "a bigint, rid bigint, o bigint, start bigint, sh bigint").join(phrases, ["a", "sh"])
        hits = hits.where(F.array_min("firsts") < F.col("o")).groupBy("rid").agg(F.collect_list(F.struct("start", "firsts")).alias("found"))
        hits = stash(hits, "sub-hits", shelf)
        release(spark)
        lost = marked(near.select("rid", "o", "cls", "text"), marks(hits, "rid"), "rid").join(hits, "rid").select("o", "cls", "text", "found")
        lost = by_arrow(lost, _removals(width), "o bigint, cls binary, n_removed bigint, kept_sha256 string, cleaned string")
        lost = stash(lost.where("n_removed > 0"), "sub-lost", batch=FOUND_ROWS)
        del near, phrases, hits, kept
    return own.join(reps, "cls"), lost


def substring_report(docs: DataFrame, width: int = 13) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    own, lost = repeated_words(docs, width)
    lost = lost.drop("cleaned").dropDuplicates(["o", "cls"])
    copy = (F.col("o") > F.col("rep")) & (F.col("n_words") >= width)
    return own.join(lost, ["o", "cls"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _classes(batches):
    """(row, o, cls) of rows as structs."""
    for batch in batches:
        rows = batch.column("row")
        cls = [xxhash.xxh3_128_digest(b" ".join(t.encode().split()) if t else b"") for t in rows.field("text").to_pylist()]
        o = [NONE if x is None else x for x in rows.field("doc_id").to_pylist()]
        yield pa.record_batch([rows, pa.array(o, pa.int64()), pa.array(cls, pa.binary())], ["row", "o", "cls"])


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """``docs`` with recurring passages taken out of the texts; rows of which nothing is left go. All columns are
    carried, whatever their names; ``n_chars``, if there, is counted anew."""
    own, lost = repeated_words(docs, width)
    lost = lost.select("o", "cls", "cleaned").dropDuplicates(["o", "cls"])
    state = own.groupBy("o", "cls").agg(F.max((F.col("o") > F.col("rep")) & (F.col("n_words") >= width)).alias("copy"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NONE)).alias("o"))
    touched = stash(state.where("copy").select("o").unionByName(lost.select("o")).distinct(), "sub-touched")
    bits = marks(touched, "o")  # rows that aren't in it stay as and where they are
    kinds = T.StructType([T.StructField("row", docs.schema, False), T.StructField("o", T.LongType()), T.StructField("cls", T.BinaryType())])
    state = state.join(touched, "o", "left_semi").where("not copy").join(lost, ["o", "cls"], "left").select("o", "cls", "cleaned", F.lit(True).alias("there"))
    maybe = by_arrow(marked(rows, bits, "o").select("row"), _classes, kinds).join(touched.withColumn("hit", F.lit(True)), "o", "left")
    changed = maybe.join(state, ["o", "cls"], "left").where("hit is null or there")
    was = F.col("row").getField("text")
    text = F.coalesce("cleaned", was)
    columns = {"text": text.alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    changed = changed.where((text != "") | was.isNull() | (was == "")).select(*(columns.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))
    same = marked(rows, bits, "o", hit=False)
    columns = {"n_chars": F.length(was).cast("bigint").alias("n_chars")}
    return same.select(*(columns.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns)).unionByName(changed)
