"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The law is ``rows``: shard sizes differ by one row at most. Three steps, all native:

1. Count the rows of every (virtual) partition; on the driver, draw how many rows each partition
   sends to each shard from the multivariate hypergeometric law, so that every shard gets its exact
   size and every assignment of rows to shards is equally likely. The matrix has at most
   ``MAX_PARTS`` rows whatever the input.
2. Permute within each partition by a seeded hash and cut the permutation by the matrix.
3. Exchange, and permute again within each shard. The second permutation is split into sub-buckets
   of about ``BUCKET_ROWS`` rows, drawn at random, so no task holds a whole shard; a row's slot is
   its bucket's offset plus its rank there.

Only (doc_id, size, crc, row number) move; texts never leave the scan. Keys don't steer anything, so
hot ids, sources or copies can't skew it. Defined cases: null text counts as empty (size 8), null and
repeated ids and repeated rows are rows as any other; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, text_of

MAX_PARTS = 4096
LANES = 16
BUCKET_ROWS = 200_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from good + bad without replacement: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - p_mode
    up = down = mode
    p_up = p_down = p_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(parts: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Rows that each partition sends to each shard; column sums are exact, at most one apart."""
    rng, total = random.Random(seed), sum(parts.values())
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = {}
    for p in sorted(parts):
        need, rest, row = parts[p], sum(left), []
        for s in range(shards):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, need)
            row.append(k)
            need -= k
        left = [a - b for a, b in zip(left, row, strict=True)]
        out[p] = row
    return out


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    number = F.monotonically_increasing_id()
    rows = stash(
        docs.select("doc_id", text_of().alias("t"), number.alias("row")).select(
            "doc_id",
            (F.octet_length("t") + 8).cast("bigint").alias("size"),
            F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
            "row",
        ),
        "shard-rows",
    )
    part = F.pmod(F.shiftright("row", 33) * LANES + F.pmod(F.col("row"), F.lit(LANES)), F.lit(MAX_PARTS)).cast("int")
    rows = rows.withColumn("part", part)
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # MAX_PARTS at most
    sent = []
    for p, row in communication_matrix(counts, shards, seed).items():
        upto, total = [], 0
        for k in row:
            total += k
            upto.append(total)
        sent.append({"part": p, "upto": upto})
    matrix = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sent)), "array<struct<part:int,upto:array<bigint>>>")).alias("m")).select("m.*")
    buckets = max(1, -(-sum(counts.values()) // (shards * BUCKET_ROWS)), min(8, sum(counts.values()) // (shards * 500)))

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "row"), "row")
    dealt = (
        rows.withColumn("r", F.row_number().over(local))
        .join(F.broadcast(matrix), "part")
        .withColumn("shard", F.size(F.filter("upto", lambda c: c < F.col("r"))))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.lit(buckets)).cast("int"))
        .select("doc_id", "size", "text_crc32", "row", "shard", "bucket")
    )
    dealt = stash(dealt, "shard-dealt")
    filled = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards * buckets rows
    start = filled.select(
        "shard", "bucket",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
    )
    again = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64(F.lit(seed + 2), "row"), "row")
    return (
        dealt.withColumn("k", F.row_number().over(again))
        .join(F.broadcast(start), ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("start") + F.col("k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
