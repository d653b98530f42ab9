"""Benchmark decontamination (operator 6): a generalised suffix automaton of the test items.

The automaton reads word numbers. While a document streams through it, it holds the length of
the longest suffix read so far that occurs in any item. Where that length reaches the
window size, the last words are a window of some item; where a short item ends there, it
occurs as a whole. Words that no item has, and pairs of neighbours that no item has, reset the automaton,
so only the runs between them are streamed, word by word; finding the runs is vectorised.

Tasks cut the items into blocks of at most ``block_words`` words, build each block's automaton and pack it into arrays (about
60 bytes a word). The driver fetches packed blocks in groups of at most ``group_bytes`` and broadcasts a group at a time; no item
text passes through it. One group, the usual case, is one pass over the documents. With more, each group's hits are written
before the next group is sent, and joined with the documents at the end; so neither the driver nor a task ever holds more than a group.
Words are compared by 64-bit fingerprints: a document word passes for one of v item words by chance with a probability of v / 2**64.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, table, together
from .kernels import LOWER, NOT_ALNUM, U, Words, lean, text_buffer, text_slices, window_hash


class SuffixAutomaton:
    """Generalised suffix automaton under construction: transitions, suffix links and lengths by state."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for words in items:
            state = 0
            for w in words:
                state = self._extend(state, w)

    def path(self, words: list[int]) -> list[int]:
        """The state of each prefix of an item."""
        out, state = [], 0
        for w in words:
            state = self.next[state][w]
            out.append(state)
        return out

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings of length(p) + 1 and shorter."""
        copy = self._new(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state


def pack_block(items: list[tuple], window: int) -> bytes:
    """One block of (item_id, text): vocabulary, neighbours and automaton as arrays.

    ``top`` leads from a state to the one whose longest string has the window's length or is the shortest above it; that one knows the items
    which have the window. ``up`` leads to the nearest state, going by suffix links, at which a whole short item ends."""
    buf, offs = text_buffer(pa.array([t for _, t in items], pa.string()))
    words = Words(LOWER[buf], offs, NOT_ALNUM)
    vocabulary = np.unique(words.hash)
    ids = np.searchsorted(vocabulary, words.hash).tolist()
    lists = [ids[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
    pair, fits = words.windows(2)
    machine = SuffixAutomaton(lists)
    link, length = np.array(machine.link), np.array(machine.length)
    states = len(link)
    top = np.arange(states)
    for s in np.argsort(length, kind="stable").tolist():
        if s and length[link[s]] >= window:
            top[s] = top[link[s]]
    having, short = defaultdict(set), defaultdict(set)
    for (item, _), own in zip(items, lists, strict=True):
        path = machine.path(own)
        if 0 < len(own) < window:
            short[path[-1]].add((len(own), item))
        for s in path[window - 1 :]:
            having[int(top[s])].add(item)
    up = np.full(states, -1)
    for s in np.argsort(length, kind="stable").tolist():
        up[s] = s if s in short else (up[link[s]] if s else -1)
    moves = sorted((s * len(vocabulary) + w, t) for s, of in enumerate(machine.next) for w, t in of.items())
    keys = np.array([k for k, _ in moves], np.int64)
    least = min((min(len(x), window) for x in lists if x), default=0)
    small = lambda x: np.asarray(x, np.int32)
    return pickle.dumps({"vocabulary": vocabulary, "pairs": np.unique(pair[fits]), "keys": keys, "to": small([t for _, t in moves]), "link": small(link), "length": small(length), "top": small(top), "up": small(up), "items": {s: sorted(x, key=repr) for s, x in having.items()}, "short": {s: sorted(x, key=repr) for s, x in short.items()}, "least": least, "window": window}, 5)


class Block:
    """A packed block, ready to stream."""

    def __init__(self, packed: bytes):
        self.__dict__.update(pickle.loads(packed))
        for name in ("keys", "to", "link", "length", "top", "up"):
            setattr(self, name, memoryview(getattr(self, name)))

    def stream(self, words):
        """(position of its last word, length, items) of each window and whole short item; -1 is a word the block lacks."""
        keys, to, link, length, size_of, n = self.keys, self.to, self.link, self.length, len(self.vocabulary), len(self.keys)
        state = size = 0
        for at, w in enumerate(words):
            if w < 0:
                state = size = 0
                continue
            while True:
                i = bisect_left(keys, state * size_of + w)
                if i < n and keys[i] == state * size_of + w:
                    state, size = to[i], size + 1
                    break
                if not state:
                    size = 0
                    break
                state = link[state]
                size = length[state]
            s = self.up[state]
            while s >= 0:
                for k, item in self.short[s]:
                    if k <= size:
                        yield at, k, (item,)
                s = self.up[link[s]] if s else -1
            if size >= self.window:
                yield at, self.window, self.items[self.top[state]]


class Group:
    """Blocks that are held together. Runs of known neighbours are found once for all."""

    def __init__(self, packed: list[bytes]):
        self.blocks = [b for b in map(Block, packed) if b.least]
        both = lambda name: np.unique(np.concatenate([getattr(b, name) for b in self.blocks])) if self.blocks else np.zeros(0, U)
        self.vocabulary, self.pairs = both("vocabulary"), both("pairs")
        self.least = min((b.least for b in self.blocks), default=0)

    def hits(self, words: Words):
        """(first word, length, items) of each occurrence, over a group of texts."""
        if not self.least or not len(words):
            return
        known = member(words.hash, self.vocabulary)
        pair = np.zeros(len(words), bool)
        pair[:-1] = (words.text[1:] == words.text[:-1]) & known[1:] & known[:-1]
        at = np.flatnonzero(pair)
        pair[at] = member(window_hash(words.hash, 2)[at], self.pairs)
        joined = np.zeros(len(words), bool)  # a word that goes on the run of the word before
        joined[1:] = pair[:-1]
        start = np.flatnonzero(known & ~joined)
        end = np.flatnonzero(known & ~pair) + 1
        for block in self.blocks:
            fits = end - start >= block.least
            for a, b in zip(start[fits].tolist(), end[fits].tolist(), strict=True):
                h = words.hash[a:b]
                ids = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
                for last, n, items in block.stream(np.where(block.vocabulary[ids] == h, ids, -1).tolist()):
                    yield a + last - n + 1, n, items


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """x in the sorted array of, by a bitmap first."""
    bits = np.zeros(1 << 18, bool)
    bits[(of >> U(46)).astype(np.int64)] = True
    out = bits[(x >> U(46)).astype(np.int64)]
    at = np.flatnonzero(out)
    spot = np.minimum(np.searchsorted(of, x[at]), len(of) - 1)
    out[at] = of[spot] == x[at] if len(of) else False
    return out


def packed_blocks(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """(packed): the items in blocks of about block_words words (a longer item is alone), built by the tasks that read them."""

    def run(batches):
        block, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = len(text) // 4 + 1  # no more words than that but for very short ones
                if block and size + words > block_words:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_block(block, window)], pa.binary())], ["packed"])
                    block, size = [], 0
                block.append((item, text))
                size += words
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([pack_block(block, window)], pa.binary())], ["packed"])

    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return items.mapInArrow(lean(run), "packed binary")


def groups_of(benchmark: DataFrame, window: int, block_words: int, group_bytes: int):
    """Lists of packed blocks of at most group_bytes (a larger block is alone)."""
    held, size = [], 0
    for row in packed_blocks(benchmark, window, block_words).toLocalIterator():
        if held and size + len(row.packed) > group_bytes:
            yield held
            held, size = [], 0
        held.append(bytes(row.packed))
        size += len(row.packed)
    if held:
        yield held


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, group_bytes: int, finish, schema) -> DataFrame:
    """docs (text, rest) through ``finish``, which gets (batch, first row, borders, bytes, words, hit words, items by text) for each slice
    of texts and yields batches of ``schema``."""
    spark = docs.sparkSession
    groups = groups_of(benchmark, window, block_words, group_bytes)
    held, more = next(groups, []), next(groups, None)

    def sliced(batch, group):
        for lo, hi, buf, offs in text_slices(batch.column(0)):
            words = Words(LOWER[buf], offs, NOT_ALNUM)
            yield lo, hi, buf, offs, words, (group.hits(words) if group else ())

    def finished(batch, lo, hi, buf, offs, words, hits):
        mark, items = np.zeros(len(words) + 1, np.int64), defaultdict(set)
        for a, size, found in hits:
            mark[a] += 1
            mark[a + size] -= 1
            items[int(words.text[a])].update(x for x in found if x is not None)
        return finish(batch, lo, hi, buf, offs, words, np.cumsum(mark[:-1]) > 0, items)

    if more is None:
        shared = spark.sparkContext.broadcast(held)

        def run(batches):
            group = Group(shared.value)
            for batch in batches:
                for part in sliced(batch, group):
                    yield from finished(batch, *part)

        return docs.mapInArrow(lean(run), schema)

    rows, tables = docs.withColumn("row", F.monotonically_increasing_id()), []
    while held is not None:
        shared = spark.sparkContext.broadcast(held)

        def collect(batches, shared=shared):
            group = Group(shared.value)
            for batch in batches:
                at, first, sizes, items = [], [], [], []
                ids = batch.column(1).to_pylist()
                for lo, _, _, _, words, hits in sliced(batch, group):
                    for a, size, found in hits:
                        text = int(words.text[a])
                        at.append(ids[lo + text])
                        first.append(a - int(words.first[text]))
                        sizes.append(size)
                        items.append([x for x in found if x is not None])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(first, pa.int32()), pa.array(sizes, pa.int32()), pa.array(items, pa.list_(pa.int64()))], ["at", "first", "size", "items"])

        tables.append(cut(rows.select("text", "row").mapInArrow(lean(collect), "at long, first int, size int, items array<long>")))
        shared.destroy()
        held, more = more, next(groups, None)
    hits = reduce(DataFrame.unionByName, tables).groupBy("at").agg(F.collect_list(F.struct("first", "size", "items")).alias("hits"))
    joined = rows.join(hits, rows["row"] == hits["at"], "left").select("text", "rest", "hits")

    def run(batches):
        for batch in batches:
            own = batch.column(2).to_pylist()
            for lo, hi, buf, offs, words, _ in sliced(batch, None):
                found = [(int(words.first[i]) + h["first"], h["size"], h["items"]) for i in range(hi - lo) for h in own[lo + i] or ()]
                yield from finished(batch, lo, hi, buf, offs, words, found)

    return joined.mapInArrow(lean(run), schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 50_000, group_bytes: int = 32_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    A word is hit if it lies inside any occurrence of an item's window (``window`` words, or all words of a shorter
    item). Null and empty texts have no words; items without words match nothing; repeated
    items count by their id, and a null item_id is left out of the list of items. Repeated
    document rows and null doc_ids are kept; other columns are ignored. Empty tables: no rows, or no hits. docs must be read from files.
    """

    def finish(batch, lo, hi, buf, offs, words, hit, items):
        n = hi - lo
        n_hit = np.bincount(words.text[hit], minlength=n)
        lists = [sorted(map(str, items.get(i, ()))) for i in range(n)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).field("c0").slice(lo, n), pa.array(words.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array(n_hit > 0)],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(some.select(*apart(some)), benchmark, window, block_words, group_bytes, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, block_words: int = 50_000, group_bytes: int = 32_000_000) -> DataFrame:
    """docs without benchmark passages: the bytes from a hit span's first word to its last go, and a document
    of which more than ``coverage`` of the words are hit goes whole. Clean texts stay byte for byte; all columns stay, whatever their names.
    Null and empty texts stay. docs must be read from files."""

    def finish(batch, lo, hi, buf, offs, words, hit, items):
        texts = batch.column(0).slice(lo, hi - lo)
        share = np.bincount(words.text[hit], minlength=hi - lo) / np.maximum(words.count, 1)
        if hit.any():
            texts = texts.to_pylist()
            for i in np.unique(words.text[hit]).tolist():
                own = np.flatnonzero(hit[words.first[i] : words.first[i + 1]]) + words.first[i]
                raw, kept, last = buf[offs[i] : offs[i + 1]].tobytes(), [], 0
                for run_of in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    kept.append(raw[last : words.start[run_of[0]] - offs[i]])
                    last = words.end[run_of[-1]] - offs[i]
                texts[i] = b"".join([*kept, raw[last:]]).decode()
            texts = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([texts, batch.column(1).slice(lo, hi - lo)], ["text", "rest"]).filter(pa.array(share <= coverage))

    parts = docs.select(*apart(docs))
    return together(_judged(parts, benchmark, window, block_words, group_bytes, finish, parts.schema), docs)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op6_benchmark_decontamination": r"""
with w as (
  select 'd' kind, doc_id id, row_number() over () rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
  union all
  select 'b', item_id, row_number() over (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
sizes as (select distinct least(len(ws), 10) k from w where kind = 'b' and len(ws) > 0),
items as (select distinct id, least(len(ws), 10) k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') g
          from (select *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) i from w where kind = 'b' and len(ws) > 0)),
grams as (select rid, i, k, array_to_string(ws[i:i + k - 1], ' ') g from (select w.*, k, unnest(range(1, len(ws) - k + 2)) i from w, sizes where kind = 'd' and len(ws) >= k)),
hits as (select rid, i, grams.k, items.id from grams join items on grams.g = items.g and grams.k = items.k),
words as (select rid, count(*) n from (select distinct rid, unnest(range(i, i + k)) p from hits) group by rid),
found as (select rid, count(distinct id) n, array_to_string(list_sort(list(distinct cast(id as varchar))), ',') ids from hits group by rid)
select w.id doc_id, cast(len(w.ws) as bigint) n_words, cast(coalesce(words.n, 0) as bigint) n_hit, cast(coalesce(found.n, 0) as bigint) n_items, sha256(coalesce(found.ids, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
from w left join words on w.rid = words.rid left join found on w.rid = found.rid where w.kind = 'd'"""
}
QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
