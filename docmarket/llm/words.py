"""Words of many texts at once: byte classes and 64-bit word hashes over Arrow string columns.

UTF-8 bytes of one character are all below 0x80 or all at or above it, so the word classes used
here (all given by ASCII separators) are found on bytes. A word's hash is a polynomial over its
bytes modulo 2**64, taken from one running sum over the whole slice and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that are no part of a word."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
WHITESPACE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PRIME = np.uint64(2**61 - 1)
_BASE = 0x0B7E151628AED2A6 + 1  # any number below the prime that is no small root of unity
_LOW31, _LOW30, _LOW29 = (np.uint64(2**n - 1) for n in (31, 30, 29))
_S61, _S32, _S31, _S30, _S29 = (np.uint64(n) for n in (61, 32, 31, 30, 29))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Below the prime, for any 64-bit number."""
    x = (x & _PRIME) + (x >> _S61)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it: by halves, as 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    cross = a1 * b0 + a0 * b1
    return _reduced(a1 * b1 * np.uint64(2) + (cross >> _S30) + ((cross & _LOW30) << _S31) + _reduced(a0 * b0))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``size``, a power of two."""

    def of(base: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        n = 1
        while n < size:
            out[n : 2 * n] = _times(out[:n], np.uint64(pow(base, n, int(_PRIME))))
            n *= 2
        return out

    return of(_BASE), of(pow(_BASE, -1, int(_PRIME)))


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let whole texts go to Python and back in Arrow batches of ``most`` bytes (one row at least), not Spark's 64 MB.

    A batch stands in memory about five times on its way, in every task. A smaller setting stays as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > most:
        spark.conf.set(name, f"{most}b")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each (one row at least)."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, min(to, len(column))
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of the rows in them; a null is an empty text."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def split(raw: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for every row the number of words before it (rows + 1 numbers)."""
    inside = ~table[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[ends] = True
    before = np.empty(len(raw), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(column: pa.Array, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice in order, and for every row the number of words before it."""
    raw, ends = flat(column)
    if lower:
        raw = LOWER[raw]
    starts, stops, rows = split(raw, ends, table)
    return span_hashes(raw, starts, stops), rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes."""
    size = 1 << max(16, int(len(raw) - 1).bit_length())
    power, inverse = _powers(size) if size <= 4 * SLICE_BYTES else _powers.__wrapped__(size)
    # A byte times a power has less than 70 bits; its halves are summed one after the other, each sum in less than 64 bits.
    value, sums = raw.astype(np.uint64), []
    value += np.uint64(1)
    running = np.zeros(len(raw) + 1, dtype=np.uint64)
    for high in (False, True):
        half = power[: len(raw)] >> _S32 if high else power[: len(raw)] & np.uint64(2**32 - 1)
        half *= value
        np.cumsum(half, out=running[1:])
        sums.append(running[stops] - running[starts])
    low, high = _reduced(sums[0]), _reduced(sums[1])
    shifted = _reduced((high >> _S29) + ((high & _LOW29) << _S32))  # times 2**32
    return mix(_times(_reduced(low + shifted), inverse[starts]) + (stops - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words of a row, and the number of windows before each row.

    With ``short`` a row of fewer words, but not none, gives its whole sequence as one window.
    """
    counts = np.diff(rows)
    full = np.maximum(counts - size + 1, 0)
    number = np.where((full == 0) & (counts > 0), 1, full) if short else full
    out_rows = np.concatenate(([0], np.cumsum(number)))
    row = np.repeat(np.arange(len(counts)), number)
    first = np.arange(out_rows[-1]) - out_rows[row] + rows[row]
    length = np.minimum(counts[row], size)
    total = np.zeros(len(first), dtype=np.uint64)
    for i in range(size if len(words) else 0):
        salt = np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        term = mix(words[np.minimum(first + i, len(words) - 1)] + salt)
        total = total + np.where(i < length, term, np.uint64(0))
    return mix(total + length.astype(np.uint64)), out_rows
