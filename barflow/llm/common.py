"""Shared plumbing of the text operators: scratch tables and zero-copy Arrow access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.batches import BYTES as _BYTES
from barflow.functions.batches import ROWS as _ROWS
from barflow.functions.batches import small_batches as small_batches

pa.set_memory_pool(pa.system_memory_pool())  # an own pool keeps what it has had
_TRIM = [ctypes.CDLL(None).malloc_trim] if hasattr(ctypes.CDLL(None), "malloc_trim") else []
if hasattr(ctypes.CDLL(None), "mallopt"):  # else the C library keeps arrays of up to 32 MB, and twice that of free memory, once it has had them
    ctypes.CDLL(None).mallopt(-3, 4 << 20)  # larger ones are mapped, and go back when they are freed
    ctypes.CDLL(None).mallopt(-1, 16 << 20)  # so much free memory is kept
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the context); without one only a local master goes on, in a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barflow-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python so many rows at once: for rows of a few numbers, where small batches cost more than they hold."""
    before, size = spark.conf.get(_ROWS), spark.conf.get(_BYTES)
    spark.conf.set(_ROWS, str(rows))
    spark.conf.unset(_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
        spark.conf.set(_BYTES, size)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        small_batches(spark)
        self.spark, self.root, self.n, self.shared = spark, f"{scratch_root(spark)}/barflow-{name}-{uuid.uuid4().hex}", 0, []

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._barflow_path = path
        return out

    def share(self, value):
        """Broadcast a value; ``release`` frees all of them on the executors once nothing lazy uses them."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def release(self) -> None:
        while self.shared:
            self.shared.pop().unpersist()

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of keep() that nothing lazy still reads."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if path := getattr(df, "_barflow_path", None):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(hadoop).delete(at, True)


HOT = 1024  # a key with at least this part of all rows is a hot one: there are never more such keys than that


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys that hold at least 1/HOT of ``total`` rows; counts are summed on the map side first."""
    return rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= max(2, -(-total // HOT))).select(key)


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, left: bool = False) -> DataFrame:
    """rows joined with ``table`` (one row a key, a long) without a task for a hot key.

    The at most HOT hot keys are broadcast with what ``table`` has for them; their rows are dealt by chance in the
    exchange for all others, and every other key holds less than 1/HOT of the rows.
    """
    added = [c for c in table.columns if c != key]
    there = table.select(F.col(key).alias("__k"), F.struct(*added).alias("__far"))
    near = hot.select(F.col(key).alias("__h")).join(there, F.col("__h") == F.col("__k"), "left").select("__h", F.col("__far").alias("__near"))
    met = rows.join(F.broadcast(near), F.col(key) == F.col("__h"), "left")
    met = met.withColumn("__d", F.when(F.col("__h").isNull(), F.col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    met = met.join(there, F.col("__d") == F.col("__k"), "left").withColumn("__both", F.when(F.col("__h").isNull(), F.col("__far")).otherwise(F.col("__near")))
    met = met if left else met.filter("__both IS NOT NULL")
    return met.select(*rows.columns, *[F.col(f"__both.{c}").alias(c) for c in added])


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on, and its next task may be another operator's."""
    if any(len(x) > LARGEST_KEPT for x in _POWERS.values()):  # a very long text's
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM[0](0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null texts have no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``most`` bytes of text; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    give_back()


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
POWERS_STEP, LARGEST_KEPT = 1 << 18, 1 << 21  # entries: tables grow by so many; larger ones go at a task's end


def _powers(n: int, inverse: bool) -> np.ndarray:
    key = "i" if inverse else "p"
    if key not in _POWERS or len(_POWERS[key]) < n:
        base = pow(_P, -1, 1 << 64) if inverse else _P
        table = np.full((n // POWERS_STEP + 1) * POWERS_STEP, base, np.uint64)
        table[0] = 1
        _POWERS[key] = np.cumprod(table, out=table)
    return _POWERS[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (public splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [start, end): equal bytes, equal hashes, wherever they stand."""
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(n, False), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(n + 1, True)[starts])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every maximal run of bytes other than ASCII white space; a run never crosses texts."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~WHITE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text begins here
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


CHUNKS = 64


def chunked(dense: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A dense array as rows (chunk, data)."""
    for k, part in enumerate(np.split(dense, CHUNKS)):
        if part.any():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "data"])


def dense_total(rows: DataFrame, dtype: str, size: int, into: str, union: bool = False, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The sum (or bitwise or) of arrays of a fixed size that tasks have sent as chunks: streamed, never grouped in memory.

    finish: applied to each summed chunk before it is sent to the driver, to bytes."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(data.as_buffer(), dtype).astype(into)
                held[k] = part if k not in held else held[k] | part if union else held[k] + part
        for k, part in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([(part if finish is None else finish(part)).tobytes()], pa.binary())], names=["chunk", "data"])

    out = np.zeros(size, into if finish is None else np.uint8)
    step = size // CHUNKS
    got = rows.repartition(8, "chunk").mapInArrow(add, "chunk int, data binary").toArrow()
    for k, data in zip(got["chunk"].to_pylist(), got["data"], strict=True):
        out[k * step : (k + 1) * step] = np.frombuffer(data.as_buffer(), out.dtype)
    del got
    give_back()
    return out
