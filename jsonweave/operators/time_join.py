"""As-of and interval joins from native operators: one shuffle by key, no pair that isn't asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _named(df: DataFrame, prefix: str) -> Column:
    return F.struct("*") if not prefix else F.struct(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, within: str | None = None, prefix: str = "right_") -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of equal ``by`` that isn't later (null without one, or if it is
    more than ``within``, an interval, before). Right columns get ``prefix``. Of right rows of one time, one is taken.

    Both sides are one stream in order of time in each key; the last right row seen is carried along. So a key's rows
    are read once, and no pairs are made.
    """
    key = F.struct(*(F.col(f"`{c}`") for c in by)) if by else F.lit(0)
    kind = F.struct(F.lit(None).cast(right.select(_named(right, prefix).alias("r")).schema["r"].dataType).alias("r"))["r"]
    none = F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType)
    rows = left.select(key.alias("k"), F.col(f"`{left_time}`").alias("t"), F.lit(1).alias("o"), F.struct("*").alias("l"), kind.alias("r")).unionByName(
        right.select(key.alias("k"), F.col(f"`{right_time}`").alias("t"), F.lit(0).alias("o"), none.alias("l"), _named(right, prefix).alias("r"))
    )
    upto = Window.partitionBy("k").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("seen", F.last(F.when(F.col("t").isNotNull(), F.col("r")), ignorenulls=True).over(upto)).where("l is not null")
    found = F.col("seen")
    if within is not None:
        found = F.when(F.col("t") - F.expr(f"interval {within}") <= F.col("seen").getField(f"{prefix}{right_time}"), found)
    found = F.when(F.col("t").isNotNull(), found)
    seen = seen.select("l", found.alias("seen"))
    return seen.select("l.*", "seen.*")


def interval_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with the rows of ``spans`` in which ``low <= point < high`` (numbers). Columns must differ.

    A span is put into the cells of ``width`` that it touches, and cells are joined by equality; with a width near that
    of the spans, each is in two or so. Very long spans cost a row for each cell.
    """
    p, lo, hi = (F.col(f"`{c}`") for c in (point, low, high))
    cell = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    spread = spans.where(lo < hi).withColumn("__cell", F.explode(F.sequence(cell(lo), cell(hi))))
    return points.withColumn("__cell", cell(p)).join(spread, "__cell").where((p >= lo) & (p < hi)).drop("__cell")
