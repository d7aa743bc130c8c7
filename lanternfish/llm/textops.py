"""Vectorised work on UTF-8 text: whole Arrow columns as one byte array, words and hashes as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, which is the
pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits of xxh3 for words; those of
word sequences are polynomials over the words' hashes, mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEP = np.zeros(256, bool)
SEP[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    h = h ^ (h >> np.uint64(32))
    h *= B
    h ^= h >> np.uint64(32)
    h *= B
    h ^= h >> np.uint64(32)
    return h


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Values that follow each other in data, as an Arrow array over the same bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each row the number of its first word (one more at the end)."""
    sep = SEP[data]
    start = ~sep
    end = start.copy()
    if len(data):
        cut = offsets[1:-1]
        before = np.empty_like(sep)
        before[0] = True
        before[1:] = sep[:-1]
        before[cut[cut < len(data)]] = True
        after = np.empty_like(sep)
        after[-1] = True
        after[:-1] = sep[1:]
        after[cut[cut > 0] - 1] = True
        start &= before
        end &= after
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def encoded_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words as numbers into the array of distinct words that follows."""
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=lengths[1:])
    coded = binary_array(data[~SEP[data]], lengths).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word."""
    which, distinct = encoded_words(data, starts, ends)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    return table[which] if len(table) else np.zeros(0, np.uint64)


def sequence_hashes(h: np.ndarray, k: int, base: np.uint64 = A) -> np.ndarray:
    """For each i the hash of h[i : i + k]; len(h) - k + 1 values. Doubles the length of sequences at each step."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done = None, 0
    power, length, step = h, 1, int(base)
    while True:
        if k & length:
            part = power[done : done + n] if total is None else None
            if total is None:
                total = part.copy()
            else:
                total *= np.uint64(pow(int(base), length, 1 << 64))
                total += power[done : done + n]
            done += length
        if length * 2 > k:
            break
        more = power[:-length] * np.uint64(step)
        more += power[length:]
        power, step, length = more, step * step % (1 << 64), length * 2
    return mixed(total)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each word, from the numbers of the rows' first words."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def whole(firsts: np.ndarray, k: int) -> np.ndarray:
    """For each of n - k + 1 sequences of k words whether it lies in one row."""
    rows = row_of(firsts)
    return rows[: len(rows) - k + 1] == rows[k - 1 :] if len(rows) >= k else np.zeros(0, bool)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row; len(x) - w + 1 values."""
    if len(x) < w:
        return x[:0]
    length, least = 1, x
    while length * 2 <= w:
        least = np.minimum(least[: len(least) - length], least[length:])
        length *= 2
    rest = w - length
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
