"""Packing (operator 8): near-equal windows by Karmarkar-Karp multiway differencing.

A map-only job. Each task tokenises its documents, cuts off whole windows of long
ones, cuts the rest into pieces of at most ``piece`` tokens (long ones would not
balance), and gathers them into groups of ``group_windows`` windows.
A group is packed by the largest differencing method over k windows: every piece
starts as a partial partition (one loaded window, k - 1 empty ones); the two
partial partitions with the widest spread are merged with opposing order, until
one is left. If a window exceeds the capacity, k rises by one and the group is
packed anew. Before that, as sequences whose length is a power of two need no
padding, the group's tokens beyond a whole number of windows are cut off its
longest pieces into such sequences, less a slack of a few tokens a window.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .kernels import lean
from .token_counts import Encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of k near-equal windows."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[0] = size
        heap.append((-size, i, loads, [[i]] + [None] * (k - 1)))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        loads = a + b[::-1]  # both run from the fullest to the emptiest window
        order = np.argsort(-loads, kind="stable")
        joined = [(x + y if y else x) if x else y for x, y in zip(in_a, reversed(in_b), strict=True)]
        loads = loads[order]
        heapq.heappush(heap, (-int(loads[0] - loads[-1]), made, loads, [joined[j] for j in order]))
        made += 1
    return [w or [] for w in heap[0][3]]


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by window: k from the total on, rising while a window exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if max((sum(sizes[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


def trim(sizes: list[int], capacity: int, slack: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """What to cut off the pieces' ends, as (power of two, [(item, tokens)]), so that the rest fills
    whole windows but for ``slack`` tokens a window. Changes ``sizes``."""
    total = sum(sizes)
    whole = total // capacity
    spare = min(total, total - whole * capacity + slack * whole)
    out, order = [], sorted(range(len(sizes)), key=lambda i: -sizes[i])
    at = 0
    for bit in reversed(range(capacity.bit_length())):
        part = 1 << bit
        while spare >= part and part <= capacity and (part >= 16 or not whole):
            spare -= part
            need, took = part, []
            while need:
                i = order[at]
                n = min(need, sizes[i])
                if n:
                    sizes[i] -= n
                    need -= n
                    took.append((i, n))
                if not sizes[i]:
                    at += 1
            out.append((part, took))
    return out


class Packer:
    """Pieces in, rows of SCHEMA out, for one task."""

    def __init__(self, capacity: int, group_windows: int, slack: int, piece: int):
        self.piece, self.capacity, self.limit, self.slack = piece, capacity, group_windows * capacity, slack
        self.next = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        self.rows: list[tuple] = []
        self.open: list[tuple] = []  # (doc_id, start, ids as bytes, doc_tokens)
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        """ids: four little-endian bytes a token."""
        n = len(ids) // 4
        full = n - n % self.capacity
        for lo in range(0, full, self.capacity):
            self.put([(doc_id, lo, ids[4 * lo : 4 * (lo + self.capacity)], n)])
        for lo in range(full, n, self.piece):
            self.open.append((doc_id, lo, ids[4 * lo : 4 * (lo + self.piece)], n))
        self.tokens += n - full
        if self.tokens >= self.limit:
            self.flush()

    def put(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def flush(self) -> None:
        sizes = [len(p[2]) // 4 for p in self.open]
        for _, took in trim(sizes, self.capacity, self.slack):
            self.put([(d, start + sizes_end, ids[4 * sizes_end : 4 * (sizes_end + n)], total) for d, start, ids, total, sizes_end, n in self._cut(took)])
        pieces = [(d, start, ids, n) for d, start, ids, n in self.open if ids]
        for window in pack_group([len(p[2]) // 4 for p in pieces], self.capacity) if pieces else []:
            self.put([pieces[i] for i in window])
        self.open, self.tokens = [], 0

    def _cut(self, took):
        """Takes tokens off the ends of open pieces."""
        for i, n in took:
            d, start, ids, total = self.open[i]
            end = len(ids) // 4 - n
            yield d, start, ids, total, end, n
            self.open[i] = (d, start, ids[: 4 * end], total)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def as_bytes(ids) -> bytes:
    """Little-endian 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, group_windows: int = 64, slack: int = 24, piece: int = 512) -> DataFrame:
    """Whole documents -> pieces in sequences of at most ``capacity`` (a power of two) tokens.

    A document is its tokens and ``end_id``, so a null or empty text is one token. Each
    token lies in exactly one piece; rows with repeated or null ids are packed like any
    other. An empty table gives no rows. Sequence ids are unique; they and the pieces
    depend on how the input is split, and a lost task is redone with the same outcome.
    """
    tail = as_bytes([end_id])

    def run(batches):
        encoder, packer = Encoder(tokenizer, as_bytes), Packer(capacity, group_windows, slack, piece)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, b"".join(encoder.values(text.as_py() or "")) + tail)
            yield packer.batch()
        packer.flush()
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_packing": op8_packing}
