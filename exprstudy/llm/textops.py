"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Every operator of this subpackage that looks into texts starts from the flat byte
buffer of an Arrow batch and the offsets of its rows, so no per-row Python runs.
A white space character is one of ``\\x20 \\x09-\\x0D``; those bytes never occur
inside a longer UTF-8 sequence, hence words can be cut on bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text bytes worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

#: Bytes hashed at once.
HASH_BYTES = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
#: One 64-bit value for each byte value; a space counts nothing, so it can follow a word.
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64)
_WORD_VALUES = np.where(SPACE, np.uint64(0), _BYTE_VALUES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library keeps its own rules
        return None


_LIBC = _libc()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes a slice, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = buffer(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
        give_back()


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and ``rows + 1`` offsets that start at 0; a null row is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and ``rows + 1`` offsets into them."""
    inside = ~SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begin[filled] = inside[filled]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line (cut at ``\\n``, an empty row has one empty line), and offsets into them."""
    cut = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], cut + 1])
    ends = np.concatenate([cut, offsets[1:]])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, side="right") - 1])
    order = np.lexsort((starts, row))
    starts = starts[order]
    row = row[order]
    row_end = np.concatenate([np.searchsorted(offsets, cut, side="right") - 1, np.arange(len(offsets) - 1)])
    ends = ends[np.lexsort((ends, row_end))]
    return starts, ends, np.searchsorted(row, np.arange(len(offsets)))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _MULTIPLIER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; equal words have equal hashes in every slice."""
    return _hash(_WORD_VALUES, data, starts)


def hash_spans(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span from one start to the next (the spans are not empty and cover the bytes)."""
    return _hash(_BYTE_VALUES, data, starts)


def _hash(table: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spans are hashed in runs of a bounded number of bytes, since the arrays take 40 bytes for each of them."""
    out = np.zeros(len(starts), np.uint64)
    for low, high in parts(np.append(starts, len(data)), HASH_BYTES):
        first, last = starts[low], starts[high] if high < len(starts) else len(data)
        lengths = np.diff(np.append(starts[low:high], last))
        value = table[data[first:last]]
        value *= powers(int(lengths.max()))[np.arange(last - first) - np.repeat(starts[low:high] - first, lengths)]
        out[low:high] = np.add.reduceat(value, starts[low:high] - first)
    return mix(out)


def parts(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of spans of at most ``limit`` in all, or of one span, as first and next span."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = min(max(int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1, low + 1), n)
        yield low, high
        low = high


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length`` of all rows, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, the number of each row's value, and the first row of each."""
    code, distinct = pd.factorize(hashes)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0) if len(code) else np.zeros(0, np.int64)
    return distinct, code, first


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment; empty segments give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column of consecutive spans."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    ).cast(pa.string())


def binaries(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
