"""Shared folders, partition counts and block packing used by the operators.

Executors can be lost at any time, so whatever one job hands to the next goes
through a shuffle or through a table in the folder that ``spark.checkpoint.dir``
names, never through a machine-local folder of a cluster.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one packed block or one vectorised step holds, about.
BLOCK_BYTES = 4 << 20

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or in local mode without one a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="lanternfish-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_LOCAL["dir"])
    return _LOCAL["dir"]


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses; the JVM removes it when it ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and returns them as read from there: the lineage ends here."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished jobs now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows; of a few numbers each, they take some tens of MB. Else it is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle has; the cluster's setting, which must follow the size of its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded by rows and bytes, so that long texts don't pile up in one batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000 or int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return spark


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, a null text as an empty one, and the named columns; others, whatever their names, stay out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def steps(batches: Iterable[pa.RecordBatch], size: int = BLOCK_BYTES, rows: int = 65_536) -> Iterator[pa.Table]:
    """The rows of the batches in order, in tables of about ``size`` bytes and at most ``rows`` rows: small batches joined, large ones cut."""
    lean()
    held: list[pa.RecordBatch] = []
    total = count = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cut = max(1, min(n, rows, int(n * size / max(1, batch.nbytes))))
        for at in range(0, n, cut):
            piece = batch.slice(at, cut)
            if held and count + piece.num_rows > rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total, count = [], 0, 0
            held.append(piece)
            total += piece.nbytes
            count += piece.num_rows
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total, count = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        held = []
    trim()


@lru_cache(maxsize=1)
def lean() -> Callable | None:
    """Makes this worker give back at once what it frees: workers live on between stages and share an executor's memory with the JVM.

    Arrow allocates by malloc from here on; blocks over 128 kB are mapped, and unmapped when freed, however large they get (by
    default the bound rises with what has been freed), and all threads share one heap. Returns malloc_trim.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 128 << 10)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 128 << 10)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 1)  # M_ARENA_MAX
        trim_ = libc.malloc_trim
    except (AttributeError, OSError):  # not a C library with these
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return trim_


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = lean()
    if give_back:
        give_back(0)


def to_blob(table: pa.Table, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob) -> pa.Table:
    trim()
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def packed(df: DataFrame, size: int = BLOCK_BYTES, level: int = 1) -> DataFrame:
    """(_b, _p): blocks of rows in scan order, each compressed (at zstandard's level) into one binary; _b is the partition and a serial number.

    The blocks are dealt to partitions by _b. Used more than once in a plan, this shuffle is computed once and reused.
    """

    def pack(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(steps(batches, size)):
            yield pa.RecordBatch.from_pydict({"_b": pa.array([first + k], pa.int64()), "_p": pa.array([to_blob(table, level)], pa.binary())})

    spark = tuned(df.sparkSession)
    return df.mapInArrow(pack, "_b long, _p binary").repartition(parts(spark), "_b")


def null_safe_crc(col: Column) -> Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def grouped(df: DataFrame, key: str, fn: Callable, schema: str | T.StructType) -> DataFrame:
    return df.groupBy(key).applyInArrow(fn, schema)
