"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Documents become ids (then an end id); only those longer than a sequence are cut, the first piece
taking the remainder. Packing needs piece lengths only, and there are at most ``capacity`` of them:
the driver gets a histogram (``capacity`` rows at most, whatever the input) and packs it with counts.
A bin is filled greedily with the largest length that fits; then its smallest piece is replaced by
the two unpacked pieces that fill the widened gap best, if they fill it better. Bins of one make are
laid at once, as often as their pieces last, so planning takes steps in proportion to the makes.

Pieces then find their place by rank within their length: ranks are given in parallel, over blocks of
a length's pieces, as many as it takes for some 2**17 pieces each, so a length that a third of all pieces have is
no hot group. What is broadcast has a row for each of ``capacity`` lengths, for each block, and for each run of
equal bins (some thousands, for they are as few as the ways lengths run out). Texts are never shuffled; a piece is a
row of seven numbers.

Defined cases: null text counts as empty (one end id); repeated rows are packed one by one; an empty
table gives an empty result; very long texts are cut into as many pieces as it takes.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_arrow, stash
from .tokens import pieces

#: Pieces of one length that are ranked in one group, about.
RANKED = 1 << 17
STEP = 256


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Makes of bins (lengths in the order of their places) and how many bins are of each."""
    left = {k: v for k, v in counts.items() if v > 0}
    there = sorted(left)
    makes = []

    def largest(limit: int, c: dict[int, int]) -> int | None:
        i = bisect.bisect_right(there, limit) - 1
        while i >= 0 and c[there[i]] <= 0:
            i -= 1
        return there[i] if i >= 0 else None

    while there:
        c, gap, bin_ = dict(left), capacity, []
        while gap and (x := largest(gap, c)) is not None:
            n = min(c[x], gap // x)
            bin_ += [x] * n
            c[x] -= n
            gap -= n * x
        greedy = Counter(bin_)
        if gap:
            small = bin_[-1]
            room, best = gap + small, (small, None)
            for a in reversed(there[: bisect.bisect_right(there, room - 1)]):
                if 2 * a <= best[0]:
                    break
                if c[a] <= 0:
                    continue
                c[a] -= 1
                b = largest(min(a, room - a), c)
                c[a] += 1
                if b is not None and a + b > best[0]:
                    best = (a + b, (a, b))
                    if best[0] == room:
                        break
            if best[1]:
                bin_ = [*bin_[:-1], *best[1]]
        used = Counter(bin_)
        times = min(left[x] // n for x, n in used.items())
        for x, n in greedy.items():
            if used[x]:
                times = min(times, (left[x] - n) // used[x] + 1)
        makes.append((bin_, times))
        for x, n in used.items():
            left[x] -= n * times
        there = [x for x in there if left[x] > 0]
    return makes


def places(makes: list[tuple[list[int], int]]) -> list[dict]:
    """For each length, which ranks go to which run of sequences, at which offset."""
    out, rank, sequence = [], Counter(), 0
    for bin_, times in makes:
        at = 0
        for x in bin_:
            out.append({"length": x, "lo": rank[x], "hi": rank[x] + times, "base": sequence - rank[x], "offset": at})
            rank[x] += times
            at += x
        sequence += times
    return out


def cut_documents(path: str, capacity: int, end_id: int, plain: bool = True):
    tail = int(end_id).to_bytes(4, "little")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                rows: list[tuple] = []
                ids = pieces(path, plain).encode([t or "" for t in batch.column("text").to_pylist()])
                for doc, x in zip(batch.column("doc_id").to_pylist(), ids):
                    x += tail
                    n = len(x) // 4
                    start, k, size = 0, 0, (n - 1) % capacity + 1
                    while start < n:
                        rows.append((doc, k, start, size, zlib.crc32(x[4 * start : 4 * (start + size)])))
                        start, k, size = start + size, k + 1, capacity
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        pieces(path, plain).forget()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, plain: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``plain``: a special token written out in a text is ordinary text; else it is the token, as by the
    library's default (the registered queries).
    """
    spark = docs.sparkSession
    rows = stash(
        by_arrow(docs.select("doc_id", "text"), cut_documents(tokenizer, capacity, end_id, plain), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"),
        "pack-pieces",
    )
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    blocks = F.array(*(F.lit(-(-histogram.get(i, 1) // RANKED)) for i in range(capacity + 1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(blocks, F.col("length").cast("int")).cast("bigint")).cast("int"))
    counts = rows.groupBy("length", "block").agg(F.count("*").alias("n"))  # capacity + pieces / RANKED rows at most
    plan = places(plan_bins(histogram, capacity))
    kind = "array<struct<length:bigint,lo:bigint,hi:bigint,base:bigint,offset:bigint>>"
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), kind)).alias("p")).select("p.*")
    upto = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    first = counts.select("length", "block", (F.sum("n").over(upto) - F.col("n")).alias("first"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("k", F.row_number().over(within)).join(F.broadcast(first), ["length", "block"]).withColumn("rank", F.col("first") + F.col("k") - 1)
    r, p = ranked.alias("r"), plan.alias("p")
    return r.join(F.broadcast(p), (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.lo")) & (F.col("r.rank") < F.col("p.hi"))).select(
        "r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32", (F.col("p.base") + F.col("r.rank")).alias("sequence_id"), "p.offset"
    )
