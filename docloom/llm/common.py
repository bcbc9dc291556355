"""What the training-data operators share: scratch tables, text buffers, word hashes and ranks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_TABLES: list[tuple[SparkSession, str]] = []

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode alone an own one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="docloom-")
    return _OWN_DIR["dir"]


def delete_table(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


@atexit.register
def drop_scratch_tables() -> None:
    """Deletes the tables that materialize() wrote; frames over them end with this."""
    while _TABLES:
        delete_table(*_TABLES.pop())


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes at its end the tables that materialize() wrote within it. What is made of them must have been written by then."""
    before = len(_TABLES)
    try:
        yield
    finally:
        while len(_TABLES) > before:
            delete_table(*_TABLES.pop())


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no job needs any more: it does so once the driver has collected what refers to them."""
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)  # events refer to plans
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    except Exception:  # a busy listener bus, or no such method: the files stay until the driver's own next collection
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that may be broadcast where they have been counted; in memory they take about twice that.
MAX_BROADCAST_BYTES = 64 << 20


def maybe_broadcast(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """df, to be broadcast if its counted rows of about `width` bytes are few enough, else left to a shuffle join."""
    return F.broadcast(df) if rows * width <= MAX_BROADCAST_BYTES else df


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on for other tasks, and malloc and Arrow would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Says how to drop what a module keeps in a worker from task to task; tasks of other operators drop it."""
    _HELD[name] = drop


def drop_held(but: str | None) -> None:
    for name, drop in _HELD.items():
        if name != but:
            drop()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that keeps from other tasks only what `holds` names, and gives memory back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(holds)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the len(column) + 1 offsets of the rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return bytes_, offsets


def row_slices(offsets: np.ndarray, target: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about target bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def column_slices(column: pa.Array, target: int, rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about target bytes and `rows` rows at most, without a copy of the column."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, stop in row_slices(np.concatenate(([0], np.cumsum(sizes))), target):
        for lo in range(start, stop, rows):
            yield lo, min(stop, lo + rows)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("p", _P), ("q", _P_INVERSE)):
            out = np.ones(size, dtype=np.uint64)
            out[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer; uint64 in, uint64 out."""
    h = h ^ np.uint64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of units[s:e] for every s, e, that depends on those units alone. units: uint64."""
    p, q = powers(len(units) + 1)
    prefix = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * p[: len(units)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without SEPARATOR) of the rows: hashes, first and end byte in data, and per row the offset of its first word.

    Bytes are taken chunk by chunk, parted at row ends and separators, so that the memory for intermediate arrays
    doesn't grow with a row.
    """
    hashes, firsts, lasts = [], [], []
    at, end = int(offsets[0]), int(offsets[-1])
    row_starts = np.zeros(0, dtype=np.int64)
    while at < end:
        stop = min(end, at + chunk)
        while stop < end and not SEPARATOR[data[stop - 1]]:
            window = np.flatnonzero(SEPARATOR[data[stop : min(end, stop + 65536)]])
            stop = stop + int(window[0]) + 1 if len(window) else min(end, stop + 65536)
        part = data[at:stop]
        inside = ~SEPARATOR[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        row_starts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        row_starts = row_starts[row_starts < len(part)]
        begins[row_starts] = inside[row_starts]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | begins[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        hashes.append(gram_hashes(part.astype(np.uint64) + np.uint64(1), s, e))
        firsts.append(s + at)
        lasts.append(e + at)
        at = stop
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, offsets, side="left").astype(np.int64)


def with_gapless_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, rows: int, per_bucket: int = 500_000) -> DataFrame:
    """Adds rank: 0, 1, 2, ... within keys, though one key may hold most rows.

    Rows of a key are spread over hash buckets; each bucket is numbered by itself and moved up by the sizes of the
    buckets before it, which are summed over a table of one row per key and bucket. Rows alike in all order columns may
    change places.
    """
    buckets = max(1, -(-rows // per_bucket))
    b, local, base = "__dl_bucket", "__dl_local", "__dl_base"
    spread = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = spread.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__dl_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, b, F.coalesce(F.sum("__dl_n").over(before), F.lit(0)).alias(base))
    numbered = spread.withColumn(local, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1)
    return numbered.join(sizes, [*keys, b]).withColumn(rank, (F.col(local) + F.col(base)).cast("long")).drop(b, local, base)
