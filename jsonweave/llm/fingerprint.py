"""Document fingerprints: a homomorphic multiset hash over paragraphs, in native columns.

Every paragraph (a non-empty line) is hashed to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane, modulo powers of two. Sums commute, so the fingerprint doesn't
depend on the order of paragraphs, and inserting or deleting one adds or subtracts its vector
(:func:`combine`). A vector has two parts:

* 16 lanes modulo 2**32, hashed from the whole paragraph: they tell equal multisets of paragraphs;
* 64 lanes modulo 2**16, read as signed: each 3-word run of the paragraph adds +1 or -1 to each lane,
  by the bits of its hash. Sums of such vectors keep angles, so the cosine of two documents' lanes
  estimates the likeness of their contents (standard error about 1/8).

Defined cases: null and empty texts have the zero vector; two zero vectors are alike (1), a zero and
another vector are not (0). The row after a document, by descending doc_id (nulls last), is found
with one exchange of the texts over ordered buckets; repeated ids are ordered by text hash.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, let, release, shuffle_partitions, stash, text_of, words_of

EXACT, SKETCH = 16, 64
MAX_BUCKETS = 4096


def elements(text: Column) -> Column:
    """Hashes of the paragraphs (odd) and of their 3-word runs (even)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of_line(line: Column) -> Column:
        runs = let(
            words_of(line),
            lambda w: F.when(
                F.size(w) >= 3,
                F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(-2))),
            ).otherwise(F.array(F.xxhash64(F.concat_ws(" ", w)).bitwiseAND(F.lit(-2)))),
        )
        return F.concat(F.array(F.xxhash64(line).bitwiseOR(F.lit(1))), runs)

    return F.flatten(F.transform(lines, of_line))


def lanes_of(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per row (``keys`` name a row): ``lanes array<bigint>``, the EXACT lanes and then the SKETCH lanes.

    The map side sums each row's elements at once; what is shuffled is one vector a row.
    """
    h, m, pair = F.col("_h"), F.col("_m"), F.lit(0x100000001)
    own = rows.select(*keys, F.explode_outer(elements(F.col(text))).alias("_h"))
    own = own.select(*keys, "_h", F.xxhash64("_h").alias("_m"))
    para = h.bitwiseAND(F.lit(1)) == 1
    sums = [F.sum(F.when(para, F.xxhash64(h, F.lit(j)).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0))).alias(f"e{j}") for j in range(EXACT)]
    sums += [F.sum(F.when(~para, F.shiftrightunsigned(m, j).bitwiseAND(pair)).otherwise(F.lit(0))).alias(f"s{j}") for j in range(SKETCH // 2)]
    got = own.groupBy(*keys).agg(F.sum(F.when(~para, F.lit(1)).otherwise(F.lit(0))).alias("n"), *sums)
    n, whole = F.coalesce("n", F.lit(0)), lambda c: F.coalesce(F.col(c), F.lit(0))
    signed = lambda x: F.pmod(n - 2 * x + 32768, F.lit(65536)) - 32768
    lanes = [F.pmod(whole(f"e{j}"), F.lit(1 << 32)) for j in range(EXACT)]
    lanes += [signed(whole(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))) for j in range(SKETCH // 2)]
    lanes += [signed(F.shiftrightunsigned(whole(f"s{j}"), 32)) for j in range(SKETCH // 2)]
    return got.select(*keys, F.array(*(x.cast("bigint") for x in lanes)).alias("lanes"))


def packed(lanes: Column) -> Column:
    """Lanes in their own widths, 32 and 16 bits, for tables and shuffles."""
    whole = F.transform(F.slice(lanes, 1, EXACT), lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int"))
    return F.struct(whole.alias("e"), F.transform(F.slice(lanes, EXACT + 1, SKETCH), lambda x: x.cast("smallint")).alias("s"))


def unpacked(p: Column) -> Column:
    whole = F.transform(p["e"], lambda x: F.pmod(x.cast("bigint"), F.lit(1 << 32)))
    return F.concat(whole, F.transform(p["s"], lambda x: x.cast("bigint")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of ``a`` with the paragraphs of ``b`` inserted (sign 1) or deleted (sign -1)."""
    def add(x: Column, i: Column) -> Column:
        y = x + sign * F.get(b, i)
        return F.when(i < EXACT, F.pmod(y, F.lit(1 << 32))).otherwise(F.pmod(y + 32768, F.lit(65536)) - 32768)

    return F.transform(a, add)


def as_text(lanes: Column) -> Column:
    exact = F.transform(F.slice(lanes, 1, EXACT), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    sketch = F.transform(F.slice(lanes, EXACT + 1, SKETCH), lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(65536)))), 4, "0"))
    return F.concat(F.array_join(exact, ""), F.array_join(sketch, ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the SKETCH lanes, from 0 to 1; 1 for equal lanes, 0 where just one is zero."""
    x, y = F.slice(a, EXACT + 1, SKETCH), F.slice(b, EXACT + 1, SKETCH)
    add = lambda acc, v: acc + v
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u * v).cast("double")), F.lit(0.0), add)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (uid, doc_id, text, next_text, next_uid); the next row by descending doc_id, the last's is the first.

    Rows go to ordered buckets of about equal size (quantiles of doc_id; a doc_id that fills several of them, and rows
    without one, are cut by text hash); within one, a window finds the next row. Each bucket also gets the first
    row of the bucket after it, so texts move once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("xx", F.xxhash64("text"))
    wanted = min(MAX_BUCKETS, max(8, 2 * shuffle_partitions(spark)))
    found = rows.agg(
        F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 100 * wanted).alias("cuts"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.count("*").alias("n")
    ).head()
    often = Counter(found["cuts"] or [])
    values = sorted(often, reverse=True)  # a bucket ends with its value: v[k] <= doc_id < v[k - 1]
    parts = [often[v] if often[v] > 1 else 0 for v in values] + [0]
    starts = list(accumulate((1 + m for m in parts), initial=0))
    of_nulls = max(1, -(-found["nulls"] * wanted // max(1, found["n"])))
    number = starts[-1] + of_nulls
    at = lambda xs: F.element_at(F.array(*(F.lit(x).cast("bigint") for x in xs)), F.size(F.filter(bounds, lambda b: b > F.col("doc_id"))) + 1)
    bounds = F.array(*(F.lit(v) for v in values)).cast("array<bigint>")
    share = (F.shiftright("xx", 1) + F.lit(1 << 62)) / F.lit(float(1 << 63))  # of the order by hash, from 0 to 1
    part = lambda m: F.least(F.floor(share * m), m - 1).cast("bigint")
    own = at(starts[:-1]) + F.when((at(parts) > 0) & (F.col("doc_id") == at([*values, None])), 1 + part(at(parts))).otherwise(F.lit(0))
    bucket = F.when(F.col("doc_id").isNull(), starts[-1] + part(F.lit(of_nulls))).otherwise(own).cast("int")
    rows = rows.withColumn("bucket", bucket)
    # one row a bucket, 3 * MAX_BUCKETS at most: its first row by the order
    heads = sorted(
        rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), (-F.shiftright("xx", 1)).alias("x"))).alias("top")).select("bucket", "top.*").collect(),
        key=lambda r: r["bucket"],
    )
    if not heads:
        return rows.select(F.lit(0).cast("bigint").alias("uid"), "doc_id", "text", F.col("text").alias("next_text"), F.lit(0).cast("bigint").alias("next_uid"))
    top = [[None, None, None] for _ in range(number)]
    for i, r in enumerate(heads):
        top[r["bucket"]] = [r["doc_id"], r["x"], heads[i - 1]["bucket"]]
    column = lambda k: F.element_at(F.array(*(F.lit(x[k]).cast("bigint") for x in top)), F.col("bucket") + 1)
    is_head = F.col("doc_id").eqNullSafe(column(0)) & (-F.shiftright("xx", 1) == column(1))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    spread = rows.withColumn(
        "at",
        F.explode(
            F.when(is_head, F.array(F.struct(F.col("bucket").cast("bigint").alias("b"), F.lit(False).alias("ghost")), F.struct(column(2).alias("b"), F.lit(True).alias("ghost")))).otherwise(
                F.array(F.struct(F.col("bucket").cast("bigint").alias("b"), F.lit(False).alias("ghost")))
            )
        ),
    ).select("uid", "doc_id", "text", F.shiftright("xx", 1).alias("x"), F.col("at.b").alias("b"), F.col("at.ghost").alias("ghost"))
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "x", "uid")
    return (
        spread.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_uid", F.lead("uid").over(order))
        .where(~F.col("ghost"))
        .select("uid", "doc_id", "text", "next_text", "next_uid")
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).select("uid", "next_uid", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["uid", "next_uid", "doc_id", "n_chars", "edited_sha256", "edited_text"]
    both = rows.select(
        *keys[:5],
        F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("text").alias("t")), F.struct(F.lit(True).alias("e"), F.col("edited").alias("t")))).alias("v"),
    ).select(*keys[:5], F.col("v.e").alias("edited_text"), F.col("v.t").alias("t"))
    got = stash(lanes_of(both, keys, "t").withColumn("lanes", packed(F.col("lanes"))), "fingerprints")
    spark = docs.sparkSession
    del rows, both
    release(spark)  # the texts' shuffle files go before the last joins write theirs
    own = got.where(~F.col("edited_text")).select(*keys[:5], "lanes")
    other = got.where("edited_text").select("uid", F.col("lanes").alias("edited_lanes"))
    following = got.where(~F.col("edited_text")).select(F.col("uid").alias("next_uid"), F.col("lanes").alias("next_lanes"))
    return (
        own.join(other, "uid")
        .join(following, "next_uid")
        .select(*keys[2:5], *(unpacked(F.col(c)).alias(c) for c in ("lanes", "edited_lanes", "next_lanes")))
        .select(
            "doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
            likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
        )
    )
