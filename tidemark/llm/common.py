"""Shared helpers of the training-data operators: table reads, shared storage, word pattern."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import new_path, shared_dir  # noqa: F401

#: One word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"
#: The same characters as text, for str.split-free counting with translate().
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of rows that go to a Python worker at a time, a row at least; results don't depend on it.
BATCH_BYTES = 8 << 20
#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run within send BATCH_BYTES to Python workers at most, or what the session allows if less: a batch is
    held by the JVM outside its heap and by the worker, in each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    allowed = int(before.rstrip("b")) if before.rstrip("b").lstrip("-").isdigit() else -1
    if 0 < allowed <= BATCH_BYTES:
        yield
        return
    spark.conf.set(key, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(batches: Iterator) -> Iterator:
    """The batches; after each, a Python worker gives back the memory that it has freed, which Arrow's pool and the
    allocator would keep for a worker that outlives its tasks."""
    import pyarrow as pa

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def cut(df: DataFrame) -> DataFrame:
    """storage.cut in small batches."""
    with small_batches(df.sparkSession):
        return storage.cut(df)


def cut_in_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """cut(), dealt by the keys into buckets: joins on these keys then move the other side only."""
    spark = df.sparkSession
    n, name = shuffle_partitions(spark), f"tidemark_{uuid.uuid4().hex}"
    with small_batches(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", new_path(spark)).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay where they are, and the plan knows them
    return written


def words_col(text):
    """The words of a text column as an array (null: no words), with JVM functions only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def count_words(text):
    """The number of words of a text column (null: 0), with JVM functions only."""
    return F.size(words_col(text)).cast("long")


class Recent(dict):
    """A memory of compute(key) in two generations of at most `size` keys each; keys in use stay
    when the older generation goes. Longer keys are computed each time."""

    def __init__(self, compute, size: int = 800_000, longest: int = 48):
        super().__init__()
        self.compute, self.size, self.longest, self.older = compute, size, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
