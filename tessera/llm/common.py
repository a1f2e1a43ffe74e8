"""Shared plumbing: durable intermediate tables, row packing and text buffers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: Bytes of text that one packed row aims at; a longer document has a row of its own. Work on a packed row takes some 75
#: times as much memory, twice an executor of two cores.
PACK_BYTES = 1 << 20


#: Rows that a Python worker is sent at once: whole texts, of which many make a batch that both sides hold.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where that is unset, a new local one, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone, and its folder with it
        pass


_lists: list[list[Saved]] = []


@contextmanager
def saved_here() -> Iterator[list[Saved]]:
    """Collects the tables that are saved inside, for whoever knows when they have been used."""
    _lists.append([])
    try:
        yield _lists[-1]
    finally:
        _lists.pop()


class Saved:
    """A table written to the shared folder: cuts lineage and outlives lost executors. Goes with drop() or at exit."""

    def __init__(self, df: DataFrame, compression: str = "zstd"):
        for x in _lists:
            x.append(self)
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tessera/{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self._end = atexit.register(_delete, self.spark, self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def lean(f):
    """For functions that make batches out of batches: a worker gives memory back when its task ends, and does not keep
    what the largest step took, as workers are used again by other tasks and stages."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs only have equal outputs."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = splitmix(np.arange(1000, 1256, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Spans:
    """Hashes of any stretches of some bytes, out of one running sum: equal stretches have equal ones wherever they lie."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            if len(_powers[0]) <= n:
                size = max(n, 1 << 20) + 1
                _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x)])) for x in (_BASE, _BACK)]
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * _powers[0][:n], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return splitmix((self.sums[b] - self.sums[a]) * _powers[1][a] + (b - a).astype(np.uint64))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty: (all bytes, n + 1 offsets)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = PACK_BYTES) -> Iterator[pa.Table]:
    """Tables of at most ``limit`` bytes of text each (or one row), out of any batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = buffers(b.column(text))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit - size, "right")) - 1
            if to <= at and size:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            to = min(max(to, at + 1), b.num_rows)
            held.append(b.slice(at, to - at))
            size += int(offs[to] - offs[at])
            at = to
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


PACKED = "batch long, n_rows long, n_bytes long, body binary"


def pack(docs: DataFrame, text: str = "text") -> Saved:
    """Every row of ``docs``, many to a row, as compressed Arrow streams. ``batch`` names a packed row for good."""
    at = docs.columns.index(text)

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))
        for i, t in enumerate(slices(batches, at)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=options) as w:
                w.write_table(t.combine_chunks())
            size = int(buffers(t.column(at))[1][-1])
            yield pa.RecordBatch.from_pydict({"batch": [base + i], "n_rows": [t.num_rows], "n_bytes": [size], "body": [sink.getvalue().to_pybytes()]}, schema=pa.schema([("batch", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("body", pa.binary())]))

    return Saved(docs.mapInArrow(run, PACKED), "uncompressed")


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def partitions_for(n_bytes: int, each: int, least: int = 16, most: int = 1 << 20) -> int:
    """How many pieces to deal work into: in proportion to the input."""
    return int(max(least, min(most, -(-n_bytes // each))))


def total(df: DataFrame, col: str) -> int:
    return int(df.agg(F.sum(col)).first()[0] or 0)
