"""Vectorised helpers that run inside Spark tasks on Arrow batches of texts.

All of them work on the UTF-8 bytes of many texts at once. Fingerprints are
64-bit; they come from fixed constants, so every executor agrees on them. Of n different
values about n * n / 2**65 pairs share one; users say what that means for them.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of the "letters and digits" tokenisation, applied after lower-casing.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (splitmix64's finaliser)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STEP, _OTHER = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Spans up to so many bytes are hashed eight bytes at a time, all at once; longer ones singly.
LONG = 64


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, (_, offsets, data) = len(column), column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offsets: np.ndarray, limit: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(column, limit: int = 1 << 17):
    """(first, last, bytes, offsets) for consecutive groups of texts."""
    buf, offs = text_buffer(column)
    for lo, hi in slices(offs, limit):
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


class Words:
    """The words of a group of texts: byte spans, text numbers, fingerprints."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = ASCII_SPACE):
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        inside = ~separators[buf]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, offs)  # first word of each text, and the total
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offs) - 1), self.count)
        self.last = np.repeat(self.first[1:], self.count)  # end of the word's text, in words
        self.hash = span_hash(buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the k words from each word on, and whether they exist."""
        return window_hash(self.hash, k), np.arange(len(self)) + k <= self.last


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans: a chain of mixed eight-byte blocks over the length, so that no pattern of bytes
    cancels out; blake2b for spans above LONG bytes."""
    size = end - start
    h = mix(size.astype(U) * _STEP)
    if not len(h):
        return h
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", wide.data, strides=(1,))  # the eight bytes from each place on
    open_ = np.flatnonzero(size <= LONG)
    at = 0
    while len(open_):
        left = np.minimum(size[open_] - at, 8)
        block = eight[start[open_] + at] & (U(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(U) % U(64))
        h[open_] = mix((h[open_] ^ np.where(left > 0, block, U(0))) * _STEP + _OTHER)
        at += 8
        open_ = open_[size[open_] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of h[i:i+k] for each i, by doubling with a scramble at each step; ends wrap and must be masked."""
    out, have, part, size = np.zeros(len(h), U), 0, h, 1
    with np.errstate(over="ignore"):
        while size <= k:
            if k & size:
                out = _joined(out, np.roll(part, -have)) if len(h) else out
                have += size
            if 2 * size <= k:
                part = _joined(part, np.roll(part, -size))
            size *= 2
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _STEP
    out ^= out >> U(32)
    out += b
    out *= _OTHER
    out ^= out >> U(29)
    return out * _STEP ^ (out >> U(32))


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op over x[i:i+w] for each i where it fits; the rest hold partial results."""
    out, done = x.copy(), 1
    while done < w:
        step = min(done, w - done)
        nxt = out.copy()
        if step < len(out):
            nxt[:-step] = op(out[:-step], out[step:])
        out, done = nxt, done + step
    return out


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that hands the memory it used back to the system when its task ends: Python workers
    outlive tasks, and what one task needed at most would else stay with the executor."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    """Gives free memory of this process back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive borders."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])
