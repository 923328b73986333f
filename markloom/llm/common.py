"""What the operators of this subpackage share: tables, the shared folder, written intermediate tables, memory of workers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="markloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written to the shared folder, to cut lineage: they outlive executors. ``drop`` removes them early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._markloom_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(t._markloom_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Seconds between releases inside a task; bytes of a group above which one follows it.
EVERY, LARGE = 1.0, 1 << 23


def release() -> None:
    """Gives freed memory, which Arrow's pool and the C library keep for later use, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """``run`` over batches, with releases on the way and at its end: Spark keeps idle workers beside the stages that follow."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for out in run(batches):
                yield out
                del out
                if time.monotonic() - last > EVERY:
                    release()
                    last = time.monotonic()
        finally:
            release()

    return whole


def released_group(run: Callable) -> Callable:
    """``run`` over one group, with a release after a large one."""

    @wraps(run)
    def whole(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes > LARGE:
                release()

    return whole


#: A key with more rows than PART is split; so is at most every key with a HOT-th of all rows, which bounds their number.
PART, HOT = 1000, 100_000


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, scratch: Scratch, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` where one key may hold any share of ``left``'s rows; ``right`` has few rows a key.

    The keys with more than max(PART, rows / HOT) rows, fewer than HOT by construction, are counted with partial sums and
    broadcast with their number of parts. Rows of such a key go to a part by the hash of ``spread``, and the key's rows on
    the right are repeated for each part. ``left`` should be cheap to read again: a written table.
    """
    least = max(PART, left.count() // HOT)
    many = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > least)
    hot = scratch.write(many.select(key, F.ceil(F.col("__n") / least).cast("int").alias("__parts")), "hot")
    if not hot.count():
        return left.join(right, key, how)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"], how).drop("__part")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def fold(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
