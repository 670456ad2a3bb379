"""Words of Arrow string columns as arrays: no Python object per word.

A column's UTF-8 bytes are classified by a 256-entry table, so a word is a maximal run of word
bytes inside one row. Each word gets a 64-bit hash from prefix sums of a polynomial over its
lower-cased (A-Z only) bytes. Null rows are empty. Work is done in windows of about WINDOW bytes
that end between words, so memory beside the input stays bounded for texts of any length (a single
word longer than the window widens it to that word).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """row: the row of each word; start, end: its byte range in data; hash: uint64; data: the bytes;
    offsets: of the rows in data."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.offsets) - 1)

    def firsts(self) -> np.ndarray:
        """For each row the index of its first word, and at the end the number of words."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def _power(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(20, (n - 1).bit_length())
        table = np.empty(size, dtype=np.uint64)
        table[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 2**64))
            more = min(done, size - done)
            np.multiply(table[:more], step, out=table[done : done + more])
            done += more
        _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them, from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text; a longer text is a piece of its own."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def tokenize(column: pa.Array, is_word: np.ndarray) -> Words:
    data, offsets = buffers(column)
    n = len(data)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bounds = np.unique(offsets[offsets < n])
    lo = 0
    while lo < n:
        hi = min(lo + WINDOW, n)
        while hi < n:  # on to the end of a word
            block = is_word[data[hi : hi + WINDOW]]
            gap = int(np.argmin(block)) if not block.all() else len(block)
            row = int(np.searchsorted(bounds, hi))
            edge = int(bounds[row]) - hi if row < len(bounds) else n - hi
            if min(gap, edge) < len(block) or hi + len(block) >= n:
                hi += min(gap, edge, len(block))
                break
            hi += len(block)
        part = data[lo:hi]
        mask = is_word[part]
        inside = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo
        before = np.empty_like(mask)
        before[0] = False
        before[1:] = mask[:-1]
        before[inside] = False
        start = np.flatnonzero(mask & ~before)
        after = np.empty_like(mask)
        after[-1] = False
        after[:-1] = mask[1:]
        after[inside[inside > 0] - 1] = False
        end = np.flatnonzero(mask & ~after) + 1
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[part] * _power(_BASE, len(part) + 1)[: len(part)], out=total[1:])
        value = (total[end] - total[start]) * _power(_BASE_INVERSE, len(part) + 1)[start]
        value += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        parts.append((start + lo, end + lo, mix(value)))
        lo = hi
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, empty, np.zeros(0, dtype=np.uint64), data, offsets)
    start, end, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, end, value, data, offsets)


def lower_bytes(words: Words, index: np.ndarray) -> list[bytes]:
    """The lower-cased bytes of the words at index."""
    data = words.data
    return [LOWER[data[a:b]].tobytes() for a, b in zip(words.start[index].tolist(), words.end[index].tolist(), strict=True)]


def word_hash(word: str) -> int:
    """The hash tokenize() gives to this one word (of any characters)."""
    return int(tokenize(pa.array([word]), np.ones(256, dtype=bool)).hash[0])


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, in order, by prefix sums of a polynomial; rows do not count."""
    n = len(values)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * _power(_BASE, n + 1)[:n], out=total[1:])
    return (total[k:] - total[:-k]) * _power(_BASE_INVERSE, n + 1)[: n - k + 1]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct k-word shingles, ordered by row, then hash; a row of fewer
    words but not none has its whole sequence as its one shingle."""
    n, counts = len(words.hash), words.counts()
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.concatenate(([0], np.cumsum(counts)))
    position = np.arange(n) - first[words.row]
    left = counts[words.row] - position
    value = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        reach = np.flatnonzero(left > i)
        step = np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 2**64))
        value[reach] += words.hash[reach + i] * step + np.uint64(i + 1)
    keep = (left >= k) | (position == 0)
    row, value = words.row[keep], mix(value[keep])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]
