"""Words of Arrow text batches as numpy arrays: spans, hashes, windows.

The text operators that can't be built from column functions run as ``mapInArrow``. They look at the
UTF-8 bytes of a batch in slices of bounded size, find words with a byte-class table and
hash words and windows with vector operations, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93))
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)

#: Byte classes of the contracts: words between white space, and words of letters and digits (and all beyond ASCII).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    h = h ^ (h >> U64(32))
    h *= _ODD[3]
    h ^= h >> U64(29)
    h *= _ODD[1]
    h ^= h >> U64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def give_back(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``out``, and at its end a reused worker's free memory goes back to the system, so that idle workers don't add up."""
    yield from out
    trim()


def trim() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def slices(raw: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, min(n, int(np.searchsorted(offs, offs[a] + most, "right")) - 1))
        b = min(b, a + 200_000)
        yield a, b
        a = b


@dataclass
class Words:
    """Words of some rows: byte spans, and ``rows``: index of each row's first word, one more at the end."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def find_words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """``raw``: bytes of the rows that ``offs`` delimits (from 0)."""
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[raw]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    opens[cut] = inside[1:-1][cut]
    closes[cut - 1] = inside[1:-1][cut - 1]
    starts = np.flatnonzero(opens)
    return Words(raw, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(U64) + U64(seed * int(_ODD[2]) + int(_ODD[0]) & (1 << 64) - 1))
    h = mix(h ^ (eights[starts] & _LOW[np.minimum(size, 8)]) * _ODD[0])
    done, more = 8, np.flatnonzero(size > 8)
    while len(more):
        word = eights[starts[more] + done] & _LOW[np.minimum(size[more] - done, 8)]
        h[more] = mix(h[more] ^ word * _ODD[0])
        done += 8
        more = more[size[more] > done]
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` hashes in a row, by doubling; the last n-1 are left out."""
    if len(h) < n:
        return np.zeros(0, U64)
    size, out = 1, mix(h + _ODD[1])
    while size < n:
        step = min(size, n - size)
        keep = len(out) - step
        out = mix(out[:keep] * _ODD[0] + out[step:] * _ODD[2] + U64(step))
        size += step
    return out


def extremes(h: np.ndarray, n: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``n`` values in a row, by doubling."""
    size, out = 1, h
    while size < n:
        step = min(size, n - size)
        out = pick(out[: len(out) - step], out[step:])
        size += step
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all of some spans, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - first, sizes)


def same_spans(raw_a: np.ndarray, a: np.ndarray, raw_b: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes hold the same bytes, compared byte by byte."""
    equal = raw_a[ragged(a, sizes)] == raw_b[ragged(b, sizes)]
    wrong = np.flatnonzero(~equal)
    out = np.ones(len(sizes), dtype=bool)
    out[np.searchsorted(np.cumsum(sizes), wrong, "right")] = False
    return out


def list_array(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Rows of lists from their lengths and all values in a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


class HashIndex:
    """64-bit keys -> their numbers in order of arrival: an open-addressing table that is probed for many keys at once."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.numbers = np.zeros(1 << bits, dtype=np.int32)

    @staticmethod
    def _key(h: np.ndarray) -> np.ndarray:
        return np.where(h == 0, U64(1), h)  # 0 marks a free place

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 where unknown."""
        h = self._key(h)
        out = np.full(len(h), -1, dtype=np.int64)
        place = (h >> U64(64 - self.bits)).astype(np.int64)
        todo = None
        while len(h):
            held = self.keys[place]
            hit = held == h
            where = np.flatnonzero(hit) if todo is None else todo[hit]
            out[where] = self.numbers[place[hit]]
            more = np.flatnonzero(~hit & (held != 0))
            todo = more if todo is None else todo[more]
            h, place = h[more], (place[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Adds distinct unknown keys; their numbers."""
        while 2 * (self.n + len(h)) > len(self.keys):
            self._grow()
        numbers = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._put(self._key(h), numbers)
        self.n += len(h)
        return numbers

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        place = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[free]
            won = free & (self.keys[place] == h)
            self.numbers[place[won]] = numbers[won]
            h, numbers, place = h[~won], numbers[~won], (place[~won] + 1) & ((1 << self.bits) - 1)

    def _grow(self) -> None:
        keys, numbers = self.keys, self.numbers
        self.bits += 1
        self.keys, self.numbers = np.zeros(1 << self.bits, dtype=U64), np.zeros(1 << self.bits, dtype=np.int32)
        self._put(keys[keys != 0], numbers[keys != 0])
