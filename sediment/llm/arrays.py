"""Texts of an Arrow batch as numpy arrays: words, hashes of words and of any stretch of them."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

#: A fixed random number for every byte value.
_BYTE = np.random.Generator(np.random.PCG64(20231)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: So many bytes or words are worked on at a time; one longer text is cut into pieces of that size.
PIECE = 1 << 18

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        grown = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, U64)
            row[0] = 1
            grown.append(np.cumprod(row, dtype=U64))
        _powers = (grown[0], grown[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Sums:
    """Running sums over units (bytes or words, as 64-bit numbers) that give the hash of any stretch at once."""

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, U64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U64) * U64(_INVERSE))

    def hash_all(self, size: int) -> np.ndarray:
        """Of the stretches of one size, at every place."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + U64(size * _INVERSE % 2**64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and the last ends."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes add up to `most` at most; a larger one is alone."""
    at, total = 0, 0
    for i, size in enumerate(n.tolist()):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(n):
        yield at, len(n)


def give_back() -> None:
    """Let the system have the memory that is free in this process, which would stay with an idle worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 * PIECE) -> Iterator[pa.RecordBatch]:
    """Batches whose values in a binary column add up to `most` bytes at most; a larger value is alone.

    A batch's memory goes back before the next is read.
    """
    for batch in batches:
        _, offsets = column_bytes(batch.column(column))
        for a, b in runs(np.diff(offsets), most):
            yield batch.slice(a, b - a)
        del batch, offsets, _
        give_back()


class Words:
    """The words of the documents of a batch.

    starts, ends   of each word, in the batch's bytes
    offsets        which words each document has: offsets[i] to offsets[i + 1]
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK):
        self.body = body
        begins, lasts = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
        inside = ~separators[body]
        after = np.zeros(len(body), bool)
        after[1:] = inside[:-1]
        after[begins] = False
        self.starts = np.flatnonzero(inside & ~after)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[lasts] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit number for every word."""
        out = np.zeros(len(self.starts), U64)
        for a, b in runs(np.diff(np.append(self.starts, len(self.body))), PIECE):
            low, high = self.starts[a], self.ends[b - 1]
            out[a:b] = Sums(_BYTE[self.body[low:high]]).hash(self.starts[a:b] - low, self.ends[a:b] - low)
        return out


def byte_units(body: np.ndarray) -> np.ndarray:
    return _BYTE[body]


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values of each document."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes; bytes of the same weight lie together, which compresses well."""
    rows = (c.view(np.uint8).reshape(len(c), c.dtype.itemsize) for c in map(np.ascontiguousarray, columns))
    return b"".join(np.ascontiguousarray(r.T).tobytes() for r in rows)  # tobytes alone goes byte by byte where they are apart


def unpack(blobs: list, kinds: list) -> list[np.ndarray]:
    """The columns that were packed, those of several blobs one after the other."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        raw, at = np.frombuffer(blob, np.uint8), 0
        n = len(raw) // width
        for out, kind in zip(parts, kinds):
            size = np.dtype(kind).itemsize
            planes = raw[at : at + n * size].reshape(size, n)
            out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
            at += n * size
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]
