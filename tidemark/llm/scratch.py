"""Intermediate tables in the folder that all executors share, and small Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Bytes of an Arrow batch on its way to Python, where the session has Spark's own limit; texts aren't cut for it.
BATCH_SETTING, SPARKS_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
#: Bytes of a row group that a writer holds.
GROUP_BYTES = 16 << 20
#: Text handled at once inside a Python worker, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only where none is set and all runs in one process."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set(SETTING, folder)
    return folder


class Scratch:
    """Tables of one operator call, written as Parquet so that a lost executor costs no recomputation.

    ``keep`` writes and rereads; ``drop`` deletes a table that no later plan reads. Tables that the
    returned DataFrame reads stay until the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        if spark.conf.get(BATCH_SETTING) == SPARKS_LIMIT:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def keep(self, df: DataFrame, table: str, partitions: int | None = None) -> DataFrame:
        path = f"{self.root}/{table}"
        (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


    def only(self, *tables: str) -> None:
        """Delete all tables but these: what made the result isn't needed behind it."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.root)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(root):
            if status.getPath().getName() not in tables:
                system.delete(status.getPath(), True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]] if len(at) else held[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def release() -> None:
    """Give memory that this worker no longer uses back to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def slices(batches, text: str, most: int = SLICE_BYTES):
    """Cut record batches so that each has at most ``most`` bytes of text, or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = flat(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    release()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[1:-1][at[1:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] |= inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, side="right") - 1


def word_counts(column: pa.Array) -> np.ndarray:
    data, at = flat(column)
    if not len(data):
        return np.zeros(len(at) - 1, np.int64)
    return np.bincount(words(data, at)[2], minlength=len(at) - 1).astype(np.int64)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", salts: int = 1024) -> DataFrame:
    """Number the rows of each group of ``keys`` from 0 without gaps, in hash order of ``order``.

    Groups are split by hash into ``salts`` parts that are numbered on their own; only counts of parts
    meet, so that a group of any size is spread over many tasks. ``keys`` must not be null.
    """
    parted = df.withColumn("_h", F.xxhash64(*order)).withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)).cast("int"))
    counts = parted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_salt").orderBy("_h", *order)
    return (
        parted.withColumn("_rn", F.row_number().over(inside))
        .join(starts, [*keys, "_salt"])
        .withColumn(name, F.col("_off") + F.col("_rn") - 1)
        .drop("_h", "_salt", "_rn", "_off")
    )
