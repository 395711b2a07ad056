"""Vectorised work on blocks of texts.

An Arrow column of texts becomes one byte array with offsets; everything else
(words, fingerprints) is numpy over those bytes, a few MB at a time, so that a
task's memory doesn't depend on how many rows a batch has.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

pa.set_memory_pool(pa.system_memory_pool())  # gives back what it doesn't need any more
U = np.uint64
BLOCK_BYTES = 2 << 20
_PRIME = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def trim() -> None:
    """Gives freed memory back to the system, at the end of a task: workers live on."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def return_freed(size: int) -> None:
    """From now on, arrays of ``size`` bytes or more go back to the system as soon as they are freed."""
    try:
        ctypes.CDLL(None).mallopt(-3, size)  # M_MMAP_THRESHOLD, which grows by itself otherwise
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def kept(size: int) -> Iterator[None]:
    """Freed arrays stay for reuse inside, and all go back at the end, from when on ``return_freed(size)`` holds again."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 1 << 30)
        c.mallopt(-1, 1 << 30)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        c = None
    try:
        yield
    finally:
        if c is not None:
            c.mallopt(-1, 128 << 10)
            return_freed(size)
            trim()


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=U) | U(1)


BYTE = _table(7)
BYTE2 = _table(11)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the fingerprints' multiplier and of its inverse, n of each."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        size = max(n, BLOCK_BYTES + 8)
        up, down = np.full(size, _PRIME), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[0] = np.cumprod(up), np.cumprod(down)
    return _powers[0][0][:n], _powers[0][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """S with S[i] the sum of values[k] * multiplier**k for k < i, modulo 2**64."""
    s = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=s[1:])
    return s


def spans(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end] from their prefix sums, wherever they stand."""
    return (s[end] - s[start]) * powers(len(s))[1][start]


def texts(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, offsets) of at most ``most`` bytes, or of one longer text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
        raw = np.concatenate([raw[a : a + n] for a, n in zip(off, size)] + [np.zeros(0, np.uint8)])
        off = np.concatenate([[0], np.cumsum(size)])
    row = 0
    while row < len(off) - 1:
        to = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        yield row, raw[off[row] : off[to]], off[row : to + 1] - off[row]
        row = to


def words(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ``gap``, and the first word of each text (and their number)."""
    inside = ~gap[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = off[:-1][np.diff(off) > 0]
    begin[firsts] = inside[firsts]
    finish = inside.copy()
    finish[:-1] &= begin[1:] | ~inside[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(start, off)


def word_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of words."""
    return mix(spans(prefix(BYTE[raw]), start, end))


_slots: list[np.ndarray] = [np.zeros(1 << 16, np.int32)]


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the last of each distinct name stands, and which of them each name is.

    The last name that falls into a slot of a table stands for its equals; names that another one displaced, with
    all their equals, are few, and those are sorted.
    """
    n = len(names)
    bits = max(16, int(4 * n - 1).bit_length())
    if len(_slots[0]) < 1 << bits:
        _slots[0] = np.zeros(1 << bits, np.int32)
    at = np.arange(n, dtype=np.int32)
    slot = (names >> U(64 - bits)).astype(np.int32)
    _slots[0][slot] = at
    stand = _slots[0][slot]
    lost = np.flatnonzero(names[stand] != names)
    if len(lost):
        order = np.argsort(names[lost], kind="stable")
        row = lost[order]
        new = np.append(True, names[row[1:]] != names[row[:-1]])
        stand[row] = row[np.append(new[1:], True)][np.cumsum(new) - 1]
    own = stand == at
    number = np.cumsum(own) - 1
    return np.flatnonzero(own), number[stand]


def lower(raw: np.ndarray) -> np.ndarray:
    """Lower-case letters for A-Z and the capitals of the second Latin block of UTF-8."""
    out = LOWER[raw]
    latin = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    out[latin] += 32
    return out


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small even where all texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())
