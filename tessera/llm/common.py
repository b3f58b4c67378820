"""What the corpus operators share: reading, cutting lineage, Arrow text buffers, row keys."""

from __future__ import annotations

import ctypes
import sys
import types
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lineage import cut, drop, shared_path

__all__ = ["cut", "drop", "shared_path"]

#: Rows in one Arrow batch; whole texts travel in it, so it is far below Spark's own 10,000.
BATCH_ROWS = 1000
#: Text bytes that one numpy pass works on; bounds a worker's memory at any batch size. A pass needs about 100 times
#: as much, since most of its arrays have 8 bytes for each byte or word.
CHUNK_BYTES = 1 << 20
#: Where a pass has a large fixed cost.
WIDE_CHUNK_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; Arrow batches are kept small from here on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Arrow batches of n narrow rows for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def worker_state() -> types.ModuleType:
    """What a Python worker process keeps between tasks: a module, so that it is never sent along with a function."""
    return sys.modules.setdefault("tessera_worker_state", types.ModuleType("tessera_worker_state"))


def lean(run):
    """run, after which the worker gives its free memory back: idle workers otherwise keep what their largest chunk took."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return task


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies per row; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES):
    """Slices of a batch of about `size` text bytes (always whole texts), each with its bytes and offsets."""
    data, off = text_view(batch.column(column))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1))
        yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), concatenated."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def others(docs: DataFrame, text_col: str):
    """All columns of a row but the text as one, so that none can clash with an operator's own."""
    names = [c for c in docs.columns if c != text_col]
    return F.struct(*([F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")]))


def layout(rows: DataFrame, carried: list[str], ddl: str) -> T.StructType:
    """The fields of rows that are carried through, whatever their inner names, then those of a DDL text."""
    return T.StructType([T.StructField(c, rows.schema[c].dataType) for c in carried] + T.StructType.fromDDL(ddl).fields)


def restored(rows: DataFrame, docs: DataFrame, text_col: str, **new) -> DataFrame:
    """The columns of docs again from `doc` (others()) and `text`; `new` replaces some."""
    return rows.select(*[new.get(c, F.col("text") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def crc_mod(column, k: int):
    """crc32 of a value as text, modulo k; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % k


_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverses modulo 2 ** 64, kept for chunks of the usual size."""
    kept = getattr(worker_state(), "powers", None)
    if kept is not None and len(kept[0]) >= n:
        return kept
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        p[:1] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 2 * WIDE_CHUNK_BYTES:
        worker_state().powers = tuple(made)
    return tuple(made)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class SliceHash:
    """64-bit hashes of any slices of a byte buffer, or of given codes: prefix sums of code * base ** position."""

    def __init__(self, data: np.ndarray | None = None, codes: np.ndarray | None = None):
        codes = BYTE_CODE[data] if codes is None else codes
        up, self.down = _powers(len(codes) + 1)
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.down[start])


def words(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of True that stay inside a document."""
    n = len(inside)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


#: First bits of a key that an Index answers by table.
FILTER_BITS = 21


class Index:
    """Sorted 64-bit keys behind a bit for each of their first bits, and the place of the first key with these bits."""

    def __init__(self, keys: np.ndarray):
        first = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[first] = True
        self.place = np.searchsorted(first, np.arange(1 << FILTER_BITS)).astype(np.int32)
        self.deep = int(np.bincount(first).max()) if len(keys) else 0
        self.keys = np.append(keys, np.zeros(self.deep, np.uint64))

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in keys) of the values that both hold."""
        top = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int32)
        maybe = np.flatnonzero(self.seen[top])
        h, where = h[maybe], self.place[top[maybe]]
        hit = self.keys[where] == h
        for _ in range(1, self.deep):
            where = where + ~hit
            hit = self.keys[where] == h
        return maybe[hit], where[hit]
