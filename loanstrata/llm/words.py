"""Words, windows and shingles of whole Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. No text is decoded: UTF-8 never holds those bytes
inside a character. Hashes are polynomials modulo 2^64 taken from running sums, so each byte and each word is touched
a fixed number of times however many windows overlap it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20
SLICE_ROWS = 30_000

_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a fixed bijection), so that any bits of the result can serve as a hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) if have is None else max(n, 2 * len(have[0]))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have


def _running(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    ahead, back = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * ahead[:len(values)], out=sums[1:])
    return sums, back


class Words(NamedTuple):
    """Words of a batch: byte ranges in `data`, a hash each, and where each row's words begin (`first`, rows + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and rows + 1 offsets into them; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool) -> Words:
    data, offsets = text_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    lengths = np.diff(offsets)
    heads, tails = offsets[:-1][lengths > 0], offsets[1:][lengths > 0] - 1
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    finish[:-1] &= ~inside[1:]
    finish[tails] = inside[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    sums, back = _running(_BYTE[data], _BYTE_BASE)
    hashes = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, hashes, np.searchsorted(start, offsets))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of `size` words inside one row: its row, first word (index in the batch) and Rabin-Karp hash."""
    counts = np.maximum(words.counts - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    skipped = np.cumsum(counts) - counts
    at = np.arange(len(row)) - skipped[row] + words.first[:-1][row]
    sums, back = _running(words.hash, _WORD_BASE)
    return row, at, mix((sums[at + size] - sums[at]) * back[at] + np.uint64(size))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as ascending 48-bit hashes, and rows + 1 offsets; words are lower-cased.

    A row with fewer than `size` words has its whole word sequence as the only shingle; one without words has none.
    """
    words = words_of(column, True)
    rows = len(column)
    if rows > 1 << 16:
        raise ValueError("at most 65,536 rows at a time")
    row, _, hashes = windows(words, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        sums, back = _running(words.hash, _WORD_BASE)
        a, b = words.first[short], words.first[short + 1]
        row = np.concatenate([row, short])
        hashes = np.concatenate([hashes, mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))])
    keys = np.sort((row.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    first = np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(48))
    if rows == 1 << 16:
        first[-1] = len(keys)
    return keys & np.uint64((1 << 48) - 1), first


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `size` bytes of text; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            upto = min(max(upto, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def pack(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers byte plane by byte plane, so that empty high planes compress to nothing."""
    values = np.ascontiguousarray(values, "<u8")
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)
