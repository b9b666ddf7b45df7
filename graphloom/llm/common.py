"""What the operators share: tables, the shared folder, checked broadcasts, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are split at these six characters only; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a local one, in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(got)
    return got


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all tables and archives that this process wrote to the shared folder; for after a result has been written."""
    while _MADE:
        _delete(spark, _MADE.pop())


def free_name(df: DataFrame, name: str, prefix: bool = False) -> str:
    """``name`` with as many underscores before it as needed to be no column of ``df`` (or the start of none)."""
    while any(c.lower().startswith(name.lower()) if prefix else c.lower() == name.lower() for c in df.columns):
        name = "_" + name
    return name


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage is cut, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete a table that ``stash`` wrote, once nothing reads it any more."""
    for path in {os.path.dirname(x) for x in df.inputFiles()}:
        _delete(df.sparkSession, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stashed or cheap table), to be broadcast if it has at most ``rows`` rows, else as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- memory of Python workers, which Spark uses again for the tasks of any operator ---------------------------------

_KEPT: dict[str, dict] = {}
#: Bytes of text that a task turns into Python objects at a time.
_SLICE = 1 << 19


def kept(operator: str) -> dict:
    """For the start of a task: what this worker keeps between the tasks of ``operator``.  What it kept for others is dropped, and free memory goes back to the system."""
    others = [t for name, t in _KEPT.items() if name != operator and t]
    for t in others:
        t.clear()
    if others:
        gc.collect()  # what was kept may hold itself, as an encoder and its tables do
    for p in _POWERS:
        p.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
    return _KEPT.setdefault(operator, {})


_LIBC = ctypes.CDLL(None)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices without a copy, of at most ``most`` bytes in ``column`` (text or binary) or one row; Spark's batches have up to 10,000 rows of any length."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


# --- vectorised hashing of words: a polynomial modulo 2**64 over bytes, then a finaliser -----------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA3B195354A39B70D)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(n, 2 * self.n, 1024)
            both = []
            for b in (self.base, self.inverse):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
            (self.up, self.down), self.n = both, size
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in _BASES]


def window_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair of bounds, in constant time each."""
    up, down = _POWERS[which].upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    a = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[a]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buffer: bytes, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word, in order."""
    start, end = word_bounds(buffer)
    out = np.empty(len(start), np.uint64)
    a = np.frombuffer(buffer, np.uint8)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _CHUNK)))
        low, high = start[at], end[to - 1]
        out[at:to] = window_hash(a[low:high].astype(np.uint64) + np.uint64(1), start[at:to] - low, end[at:to] - low, which)
        at = to
    return out, start, end


def blocks(texts: list[bytes], most: int = 4 << 20):
    """Consecutive texts in blocks of about ``most`` bytes (a longer text alone): yields (first, past last)."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def hashed_docs(texts: list[bytes], which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` and the word offsets of each text (one more than texts)."""
    joined = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    h, start, _ = word_hashes(joined, which)
    return h, np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
