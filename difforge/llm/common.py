"""Shared plumbing of the training-data operators.

Intermediate tables are Parquet files in the shared folder that the session names in
``spark.checkpoint.dir``, so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: A maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Texts that a Python worker gets at once.
BATCH_ROWS = 2000


class Scratch:
    """Tables written once by an operator and read by its later steps.

    ``keep`` writes and rereads a frame; ``drop`` removes tables that no later step reads; ``finish`` writes the result and
    removes all others. What is left of a result goes when the application ends. Python workers get BATCH_ROWS texts at
    once while a table is written, so that neither they nor the JVM hold large Arrow buffers.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/difforge-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        if self.count == 0:
            fs, where = self._path(self.root)
            fs.mkdirs(where)
            fs.deleteOnExit(where)
        self.count += 1
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def settle(self) -> None:
        """Let Spark remove the shuffle files of finished queries: it does so when the driver's JVM collects their plans, in two rounds."""
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *tables: DataFrame) -> None:
        for df, path in self.tables:
            if any(df is t for t in tables):
                fs, where = self._path(path)
                fs.delete(where, True)
        self.tables = [t for t in self.tables if not any(t[0] is x for x in tables)]

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that is all that stays of this operator's."""
        out = self.keep(df)
        self.drop(*(t for t, _ in self.tables if t is not out))
        return out


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """At most BATCH_ROWS rows go to a Python worker at once, unless the session asks for fewer."""
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(was)) if int(was) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't use, in any case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def sent_if_small(scratch: Scratch, df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``df`` as a table, to be broadcast if it has at most ``most`` rows, which has to be few bytes each."""
    df = scratch.keep(df)
    return F.broadcast(df) if df.count() <= most else df


def number_rows(scratch: Scratch, df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: gapless positions from 0 in each ``group``, by ``order``; no task holds a whole group.

    Rows are dealt by range of (group, order) and sorted; each partition numbers its own stretch, and
    the stretches' lengths, at most one per partition and group boundary, give the offsets. The numbered
    rows are written once, so that a retried task can't see other range bounds.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = scratch.keep(dealt.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    runs = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_len"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_len").over(before), F.lit(0))).drop("_len")
    # A partition holds one contiguous range, so there are at most partitions + groups runs.
    runs = sent_if_small(scratch, runs)
    same = dealt[group].eqNullSafe(runs[group]) & (dealt["_part"] == runs["_part"])
    joined = dealt.join(runs, same).drop(runs[group], runs["_part"])
    return joined.withColumn(out, F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_part", "_from", "_before")


def word_count(text: Column) -> Column:
    """Number of ASCII-white-space-separated words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_crc(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def over_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on each partition's Arrow batches."""
    return df.mapInArrow(fn, schema)


def giving_back(fn: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """``fn``, after which its Python worker, which waits for the next task, gives freed memory back to the system where that can be asked for."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def bloom(ids: DataFrame, column: str, spark: SparkSession, bits_per_id: int = 16, most_bits: int = 1 << 26) -> np.ndarray:
    """A bit table of all ids, at most ``most_bits`` (8 MB), made by distributed bitwise or.

    It only saves work: rows that pass by chance are removed by the join that follows.
    """
    n = ids.count()
    size = 1 << 16
    while size < min(most_bits, n * bits_per_id):
        size *= 2

    def words(batches):
        for b in batches:
            for at in bloom_bits(b.column(0).to_numpy(zero_copy_only=False), size):
                yield pa.record_batch({"word": at >> np.int64(6), "bits": np.left_shift(np.int64(1), at & np.int64(63))})

    got = over_batches(ids.select(column), words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id is not among ``ids``, rows whose doc_id may be), told apart by a bit table of bounded size.

    Only the latter have to be joined, so most texts aren't shuffled. ``ids`` has one long column.
    """
    (name,) = ids.columns
    table = docs.sparkSession.sparkContext.broadcast(bloom(ids.where(F.col(name).isNotNull()), name, docs.sparkSession))

    @F.pandas_udf("boolean")
    def may_be(found: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(table.value, found.to_numpy(np.int64)))

    hit = F.col("doc_id").isNull() | may_be(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    return docs.where(~hit), docs.where(hit)


def bloom_bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64))
    mask = np.uint64(size - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)]


def bloom_has(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for at in bloom_bits(ids, len(table) * 64):
        ok &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return ok
