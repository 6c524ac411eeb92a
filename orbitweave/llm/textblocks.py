"""Vectorised word handling over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Each word becomes one
64-bit hash; work goes in blocks of bounded bytes, so memory follows the block and not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

U64 = np.uint64
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes handled at once.
BLOCK_BYTES = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for base in (_P, _P_INV):
            t = np.empty(size, dtype=U64)
            t[0] = 1
            done = 1
            while done < size:  # doubling: t[done:2*done] = t[:done] * base**done
                step = min(done, size - done)
                t[done : done + step] = t[:step] * U64(pow(base, done, 1 << 64))
                done += step
            tables.append(t)
        if n > BLOCK_BYTES + 1:
            return tables
        _powers[:] = tables
    return _powers


@dataclass
class Words:
    """Words of some consecutive rows: a hash each, and where each row's words begin."""

    hashes: np.ndarray
    #: Row i owns hashes[first[i]:first[i + 1]].
    first: np.ndarray
    #: Byte ranges of the words within ``data``.
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    return offs - offs[0], np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]


def row_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text has a range of its own."""
    offs, _ = _buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def words(column: pa.Array) -> Words:
    """Split and hash the words of every row; a null text has none."""
    offs, raw = _buffers(column)
    data = _LOWER[raw]
    n = len(data)
    if n == 0:
        empty = np.empty(0, dtype=np.int64)
        return Words(np.empty(0, dtype=U64), np.zeros(len(offs), dtype=np.int64), empty, empty, data)
    space = _SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    start = ~space
    start[1:] &= space[:-1] | cut[1:n]
    stop = ~space
    stop[:-1] &= space[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    hashes = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):  # words of about a block at a time: a long text takes no more memory than a block
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        pw, inv = _power_tables(b - a + 1)
        sums = np.empty(b - a + 1, dtype=U64)
        sums[0] = 0
        np.cumsum((data[a:b].astype(U64) + U64(1)) * pw[: b - a], out=sums[1:])
        hashes[i:j] = mix((sums[ends[i:j] - a] - sums[starts[i:j] - a]) * inv[starts[i:j] - a])
        i = j
    return Words(hashes, np.searchsorted(starts, offs).astype(np.int64), starts, ends, data)


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept between tasks, and with them what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


Batches = Iterator[pa.RecordBatch]


#: Rows and bytes of an Arrow batch where the session has no limit of its own: Spark's 10,000 whole texts would
#: be held several times over, by the executor and by its Python workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Set the session's limits of Arrow batches, where they are unset."""
    known = spark.conf.getAll
    for key, most in BATCH.items():
        if key not in known:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: str | StructType, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over batches of bounded size, with memory given back at the end of each task."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batch.slice(lo, rows) for batch in batches for lo in range(0, max(1, batch.num_rows), rows))
        finally:
            give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(wrapped, schema)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    size = min(size, len(hashes))
    if size == 0:
        return hashes[:0]
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=U64)
    for k in range(size):
        out = out * U64(_P) + hashes[k : k + n]
        out ^= out >> U64(29)
    return mix(out)


def group_shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The shingles of each of several word sequences, ``hashes[first[k]:first[k + 1]]``, in no stated order."""
    lengths = np.diff(first)
    left = np.repeat(first[1:], lengths) - np.arange(first[0], first[-1])  # words from each one on in its sequence
    at = np.arange(first[0], first[-1])
    out = [_runs(hashes, at[left >= size], size)]
    out += [_runs(hashes, first[:-1][lengths == n], n) for n in range(1, size)]
    return np.concatenate(out)


def _runs(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(starts), size, dtype=U64)
    for k in range(size):
        out = out * U64(_P) + hashes[starts + k]
        out ^= out >> U64(29)
    return mix(out)


def crc_mod(ids: list, modulus: int) -> np.ndarray:
    """crc32 of the ids' decimal text modulo ``modulus``; -1 for a null id."""
    import zlib

    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids], dtype=np.int64)
