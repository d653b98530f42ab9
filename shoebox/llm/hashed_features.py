"""Hashed n-gram features of texts, shared by the two quality operators.

Four families: character 3-grams and 4-grams (of bytes), words, word pairs. Each family has
``2 ** BITS`` buckets, and a text's value for a bucket is its share among the
family's n-grams of the text, times ``SCALE``. A linear model's score is thus a mean of weights per family.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .kernels import U, Words, text_slices

BITS, FAMILIES, SCALE = 15, 4, 20.0
SIZE = FAMILIES << BITS


def families(buf: np.ndarray, offs: np.ndarray, words: Words):
    """(bucket of each n-gram, borders of the texts among them), family by family."""
    n = len(buf)
    low = buf.astype(np.uint32)
    for f, k in enumerate((3, 4)):
        code = np.zeros(max(0, n - k + 1), np.uint32)
        for j in range(k):
            code = code * np.uint32(257) + low[j : n - k + 1 + j]
        code = (code * np.uint32(2654435769)) >> np.uint32(32 - BITS)
        yield code.astype(np.int32) + (f << BITS), np.minimum(offs, len(code))  # a few n-grams span two texts of a slice
    yield (words.hash >> U(64 - BITS)).astype(np.int32) + (2 << BITS), words.first
    pair, _ = words.windows(2)
    yield (pair >> U(64 - BITS)).astype(np.int32) + (3 << BITS), words.first


def family_slices(column):
    """As ``families``, but text by text borders hold: a text's last k - 1 bytes and its last word begin no n-gram."""
    for lo, hi, buf, offs in text_slices(column):
        words = Words(buf, offs)
        out = []
        for f, (code, borders) in enumerate(families(buf, offs, words)):
            short = (2, 3, 0, 1)[f]
            ends = np.maximum(borders[1:] - short, borders[:-1])
            if f < 2:
                ends = np.maximum(np.minimum(offs[1:] - short, len(code)), borders[:-1])
            out.append((code, borders[:-1], ends))
        yield lo, hi, buf, offs, words, out


def margins(weights: np.ndarray, parts) -> np.ndarray:
    """Per text: the sum over families of SCALE * mean weight of its n-grams."""
    total = 0.0
    for code, start, end in parts:
        run = np.zeros(len(code) + 1)
        np.cumsum(weights[code], out=run[1:])
        total = total + SCALE * (run[end] - run[start]) / np.maximum(end - start, 1)
    return total


class Features:
    """The features of a bounded list of texts, in blocks of texts, so that no step needs memory for all of them at once."""

    def __init__(self, texts: list[str], block: int = 256):
        self.n, self.blocks = len(texts), []
        for at in range(0, self.n, block):
            keys, counts, sizes = [], [], []
            for lo, hi, _, _, _, parts in family_slices(pa.array(texts[at : at + block], pa.string())):
                for f, (code, start, end) in enumerate(parts):
                    keep = np.zeros(len(code) + 1, np.int64)
                    np.add.at(keep, start, 1)
                    np.add.at(keep, end, -1)
                    row = np.repeat(np.arange(lo, hi), end - start)
                    key, count = np.unique(row * SIZE + code[np.cumsum(keep[:-1]) > 0], return_counts=True)
                    size = np.zeros(block)
                    size[lo:hi] = end - start
                    keys.append(key)
                    counts.append((SCALE * count / size[key // SIZE]).astype(np.float32))
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            order = np.argsort(key)
            value = np.concatenate(counts)[order] if keys else np.zeros(0, np.float32)
            row, col = key[order] // SIZE, key[order] % SIZE
            rows = min(block, self.n - at)
            self.blocks.append((at, rows, np.searchsorted(row, np.arange(rows + 1)), col, value))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """The margin of each text."""
        out, low = np.zeros(self.n), w.astype(np.float32)
        for at, rows, first, col, value in self.blocks:
            if len(col):
                part = low.take(col)
                part *= value
                sums = np.add.reduceat(part, np.minimum(first[:-1], len(part) - 1))
                out[at : at + rows] = np.where(np.diff(first) > 0, sums, 0)
        return out

    def back(self, d: np.ndarray) -> np.ndarray:
        """The sum over texts of d times their features."""
        out = np.zeros(SIZE)
        for at, rows, first, col, value in self.blocks:
            out += np.bincount(col, value * np.repeat(d[at : at + rows], np.diff(first)), minlength=SIZE)
        return out


class Adam:
    """Adam steps on one weight vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
