"""Vectorised word splitting and hashing of Arrow string columns, for use inside tasks.

A word is a maximal run of bytes outside a separator set. The separators are ASCII, so runs
of UTF-8 bytes and runs of characters are the same thing. A-Z are lower-cased bytewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: ``[\x20\x09-\x0D]``
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z have been lower-cased
NOT_ALPHANUMERIC = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(4096, np.uint64(0xD1342543DE82EF95)))


def byte_table(separators: bytes) -> np.ndarray:
    """A 256-entry map: separators to 0, A-Z to a-z, the rest to itself, but NUL, where it is no separator, to a byte that UTF-8 doesn't have."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    table[ord("A") : ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes behave as random numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and the offset of each; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``limit`` bytes of text, one row at least, to bound memory.

    Arrays made of a slice take some 30 times its bytes. After the last one Arrow's free memory goes back, as the worker stays.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = string_bytes(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``, and for each text the number of its first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        """The sum of a number per word, for each text."""
        total = np.concatenate(([0], np.cumsum(of_word, dtype=np.int64)))
        return total[self.first[1:]] - total[self.first[:-1]]


def split_words(column: pa.Array, table: np.ndarray) -> Words:
    raw, at = string_bytes(column)
    data = table[raw]
    inside = data != 0
    begins, finishes = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        cuts = at[(at > 0) & (at < len(data))]
        begins[cuts] = inside[cuts]
        finishes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, at))


def word_hashes(words: Words, limit: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.zeros(len(words.starts), np.uint64)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(words.ends, words.starts[lo] + limit, "right")))
        base, end = words.starts[lo], words.ends[hi - 1]
        part, starts = words.data[base:end], words.starts[lo:hi] - base
        lengths = np.diff(np.append(starts, len(part)))
        place = np.arange(len(part)) - np.repeat(starts, lengths)
        values = part.astype(np.uint64)
        values += np.uint64(0x5851F42D) * (part != 0) + (place >> 12).astype(np.uint64) * (part != 0)
        values *= _POWERS[place & 4095]
        values[part == 0] = 0
        out[lo:hi] = np.add.reduceat(values, starts)
        lo = hi
    return mix(out)


def gram_hashes(hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each word on, or from the words ``at``."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n if at is None else len(at), np.uint64(size))
    for j in range(size):
        out = out * _ODD + (hashes[j : j + n] if at is None else hashes[at + j])
    return mix(out)


def whole(words: Words, size: int) -> np.ndarray:
    """For each place that gram_hashes() gives: do all ``size`` words lie in one text?"""
    n = max(0, len(words.starts) - size + 1)
    last = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(n) + size <= last[:n]
