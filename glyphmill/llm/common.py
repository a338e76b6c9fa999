"""What the operators share: reading, durable cuts of lineage, partition counts, blobs.

Wide row exchanges are replaced by *blobs*: a map task packs fixed-width numpy
records by bucket, and the exchange carries a few binary rows for each bucket
instead of one row a record. The bucket of a record is a function of its key only,
so results don't depend on how the input was split.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.spread import input_bytes

M64 = (1 << 64) - 1
#: Whether exchanges' files go when what was run has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset and the
    master is local (tests), a temporary folder of this process. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share.")
        keep = tempfile.TemporaryDirectory(prefix="glyphmill-")
        atexit.register(keep.cleanup)
        shared_dir.own = found = f"file://{keep.name}"
    return found.rstrip("/")


def col(name: str) -> Column:
    """The column of that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: its lineage ends
    there, and a lost executor costs no more than reading the files again. The files of
    its exchanges, which nothing reads any more, go at once, not when the driver happens
    to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def buckets(df: DataFrame, factor: float = 1.0, each: int = 16 << 20) -> int:
    """Buckets of about `each` bytes for factor times df's size, at least the
    session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(input_bytes(df) * factor / each))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) of a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def split_blobs(records: np.ndarray, bucket: np.ndarray, most: int = 1 << 20):
    """Yields (bucket, bytes) of structured `records`, none over about `most` bytes."""
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    step = max(1, most // records.dtype.itemsize)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for at in range(a, b, step):
            yield int(bucket[a]), records[at : min(b, at + step)].tobytes()


def blob_batch(rows: list[tuple], names=("bucket", "blob")) -> pa.RecordBatch:
    """A batch of (int, ..., bytes) rows."""
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    kinds = [pa.binary() if n == "blob" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))


def read_blobs(column, dtype) -> np.ndarray:
    """The records of a column of blobs."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def text_buffers(column):
    """(bytes of all texts, offsets) of an Arrow string column, as numpy views; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data, offsets


def release() -> None:
    """Gives a worker's unused memory back: workers outlive their tasks, and several of
    them share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy_map(run):
    """run (an iterator of batches -> another), with release() at its end."""

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # others keep what they freed
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run):
    """run (a table -> a table), with release() after each group."""

    def wrapped(table):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return run(table)
        finally:
            release()

    return wrapped


def tidy_groups(run):
    """run (an iterator of a group's batches -> another), with release() after each group."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(batches, rows: int = 1000):
    """Batches of at most `rows` rows: what is made of a batch is held all at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """df with `nth` (a name that df must not have), its rows' numbers from 0 in the given
    order: ranges are sorted apart, and only their row counts meet on the driver."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # names by place: those of df may hold dots
    safe = [f"c{i}" for i in range(len(df.columns))]
    keyed = df.select(*(col(c).alias(s) for c, s in zip(df.columns, safe)), order.alias("key"))

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*b.schema.names, "part", "at"])
            at += n

    fields = T.StructType([*keyed.drop("key").schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    rows = cut(keyed.repartitionByRange(parts, "key").sortWithinPartitions("key").drop("key").mapInArrow(tidy_map(number), fields))
    starts, total = [], 0
    for r in sorted(rows.groupBy("part").count().collect()):
        starts += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    first = F.create_map(*starts)[F.col("part")] if starts else F.lit(0).cast("long")
    return rows.select(*(F.col(s).alias(c) for c, s in zip(df.columns, safe)), (F.col("at") + first).alias("nth"))
