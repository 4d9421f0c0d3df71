"""What the operators of this subpackage share: tables, the shared folder, words as native columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and all run on this machine (tests)."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="jsonweave-")
        spark.sparkContext.setCheckpointDir(got)
    return got


class Shelf(list):
    """Paths of tables that are deleted at the end of a ``with`` block, whether or not it succeeds."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int | None):
    """Arrow batches of ``rows`` rows in what runs meanwhile; None leaves the session's setting."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if rows:
        spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        if rows:
            spark.conf.set(setting, before)


def drop(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def stash(df: DataFrame, name: str, shelf: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and a lost
    executor costs a re-read only. Paths of tables that their maker can drop earlier go to ``shelf``; all
    go when the session's JVM ends. ``batch``: rows of an Arrow batch while it is made, for rows with long values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if shelf is not None:
        shelf.append(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    with arrow_batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, shelf: list[str]) -> None:
    """Delete the tables on a shelf, which nothing reads any more, and free finished shuffles."""
    while shelf:
        drop(spark, shelf.pop())
    release(spark)


MARK_BITS = 23


def marks(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """A bitmap of 2**23 hash places as rows (``_at``, ``_bits``), 131,072 rows at most whatever the input, for :func:`marked`."""
    place = F.shiftrightunsigned(F.xxhash64(column), 64 - MARK_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    return ids.select(F.shiftright(place, 6).alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))


def marked(docs: DataFrame, bitmap: DataFrame, column: str = "doc_id", hit: bool = True) -> DataFrame:
    """The rows of ``docs`` whose id may be among those of the bitmap (``hit``), or surely isn't. Texts of the
    others stay where they are; where ids fill the bitmap, the join that follows alone decides."""
    place = F.shiftrightunsigned(F.xxhash64(column), 64 - MARK_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = docs.withColumn("_place", F.shiftright(place, 6)).join(F.broadcast(bitmap), F.col("_place") == F.col("_at"), "left")
    there = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return found.where(there if hit else ~there).drop("_place", "_at", "_bits")


def give_back() -> None:
    """Let a Python worker, which waits for its next task, return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` that leaves a lean worker behind."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def text_of(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
