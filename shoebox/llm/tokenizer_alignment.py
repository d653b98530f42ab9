"""Cross-tokenizer alignment (operator 12): inverted pair bitmaps.

Two tokenizers cut the same bytes; tokens whose byte ranges overlap are linked. Texts are cut into units at spaces and line ends after other
letters, which no token of either vocabulary crosses; a unit is encoded and aligned once and found again in a cache of
the task, so that a document is a list of unit numbers.

The inverted index has a row for each pair of ids, container of CONTAINER consecutive row numbers, and plane: the documents in which bit
``plane`` of the pair's number of links is set, as a bitmap or, where that is shorter, as a list of two-byte places. The planes
of a pair in a container OR-merge to the documents that hold it; the number ``n`` of their bits is the container's share of the
pair's document count, and containers share no documents, so shares add up. Counts are joined back to the index, and the postings
return scores to their documents container by container. The index is written once; only pairs, counts and bitmaps are shuffled, never texts or single links.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .kernels import lean
from .token_counts import _LETTERS

#: Documents of a container of bitmaps, as bits of a row number.
LOW_BITS = 12
CONTAINER = 1 << LOW_BITS
POSTINGS = "a int, b int, container long, plane int, n int, size int, places binary, bits binary"
DOCUMENTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: Where units begin: at a space or line end behind what no notion of white space includes; and the units, unless there are ODD signs.
EDGE = re.compile("(?<=[^\\s\u180e\u200b\ufeff])(?=[ \n])")
UNIT = re.compile("\\s*\\S+(?:[^\\S \n]\\s*\\S+)*(?:[^\\S \n]\\s*\\Z)?|\\s+")
ODD = re.compile("[\u180e\u200b\ufeff]")


#: The pattern by which byte-level tokenizers cut texts before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges whose letters and digits all versions of Unicode of the last years agree on; other texts go through the whole tokenizer.
SETTLED = re.compile("[\x00-\u052f\u1e00-\u2bff\u3000-\u9fef\uac00-\ud7a3\ufb00-\ufffd\U0001f300-\U0001faff]*").fullmatch
#: Most ids that a vocabulary may have: two ids and a place share a sorting key.
IDS = 1 << 20


class Table(dict):
    """What ``make`` gives for a key, kept until there are ``most`` keys."""

    def __init__(self, make, most: int = 200_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Side:
    """A tokenizer: ids of units, and the bytes of each id. ``.json``: byte-level, whose entries stand for bytes; ``.model``: pieces with byte
    fallback, which puts a space before what it encodes."""

    def __init__(self, path: str):
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        else:
            import json

            import regex
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            facts = json.loads(self.model.to_str())
            back = {c: b for b, c in _LETTERS.items()}
            shown = [self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size())]
            self.bytes = [bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s in shown]
            pieces = [b.decode("utf-8", "replace") for b in self.bytes]
            before = facts.get("pre_tokenizer") or {}
            self.known = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not facts.get("normalizer")
            self.split, self.bpe = regex.compile(PATTERN).findall, self.model.model
            self.words = Table(lambda w: [t.id for t in self.bpe.tokenize(w.encode().decode("latin-1").translate(_LETTERS))])
        if len(self.bytes) > IDS:
            raise ValueError(f"more than {IDS} ids in {path}")
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        crossed = [p for p in pieces if EDGE.search(p.replace("▁", " "))]
        self.cuts = not crossed and not any("\n" in p for p in pieces if self.pieces)

    def ids(self, units: list[str]) -> list[int]:
        """Of units one after the other, each as it stands in space + text: wherever a unit begins, nothing is joined."""
        if self.pieces:
            found = self.model.encode([u[1:] if u[:1] == " " else u for u in units], num_threads=1)
            return [*chain.from_iterable([ids if u[:1] == " " else ids[1:] for u, ids in zip(units, found, strict=True)])]  # a line end joins no piece, so the space put before it is one
        joined = "".join(units)
        if self.known and SETTLED(joined):
            return [*chain.from_iterable(map(self.words.__getitem__, self.split(joined)))]
        odd = [[*chain.from_iterable(map(self.words.__getitem__, self.split(u)))] if self.known and SETTLED(u) else self.model.encode(u, add_special_tokens=False).ids for u in units]
        return [*chain.from_iterable(odd)]


def sums_between(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many values each."""
    run = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return run[ends] - run[ends - counts]


def units_of(text: str) -> list[str]:
    return EDGE.split(text) if ODD.search(text) else UNIT.findall(text)


def segments(text: str, limit: int):
    """text in parts of about ``limit`` letters, cut where units begin."""
    at = 0
    while at < len(text):
        edge = EDGE.search(text, at + limit)
        end = edge.start() if edge else len(text)
        yield text[at:end]
        at = end


class Aligner:
    """Units of the texts of one task, by number, in a cache that starts anew when full. Of each unit: tokens of both sides, groups, links and whether its
    tokens spell it (``sums``), its groups as text, and its links between two borders of ``pairs``."""

    def __init__(self, path_a: str, path_b: str, limit_bytes: int = 120_000_000):
        self.side_a, self.side_b, self.limit = Side(path_a), Side(path_b), limit_bytes
        self.cuts = self.side_a.cuts and self.side_b.cuts
        most = max(len(self.side_a.bytes), len(self.side_b.bytes))
        self.shown = [f"{i}{sign}".encode() for sign in ",|;" for i in range(most)]  # within a side of a group, at the end of its first, at its end
        self.clear()

    def clear(self) -> None:
        self.numbers, self.texts, self.room = {}, [], self.limit
        self.sums, self.pairs, self.borders = array("q"), array("q"), array("q", [0])

    def add(self, units: list[str]) -> None:
        """Encodes and aligns new units, all at once."""
        raw = [u.encode() for u in units]
        length = np.array([len(u) for u in raw], np.int64)
        ids = [side.ids(units) for side in (self.side_a, self.side_b)]
        a, b = (np.array(x, np.int64) for x in ids)
        fine = np.ones(len(units), bool)
        whole = b"".join(raw)
        if not all(b"".join(map(side.bytes.__getitem__, x)) == whole for side, x in zip((self.side_a, self.side_b), ids, strict=True)):  # one by one
            each = [[side.ids([u]) for u in units] for side in (self.side_a, self.side_b)]
            fine = np.array([all(b"".join(map(side.bytes.__getitem__, x)) == u for side, x in zip((self.side_a, self.side_b), pair, strict=True)) for u, *pair in zip(raw, *each, strict=True)], bool)
            a, b = (np.array([*chain.from_iterable(x for x, good in zip(of, fine, strict=True) if good)], np.int64) for of in each)
        good = np.flatnonzero(fine)
        ends_a, ends_b = np.cumsum(self.side_a.sizes[a]), np.cumsum(self.side_b.sizes[b])
        unit_ends = np.cumsum(length[good])
        sums = np.zeros((len(units), 5), np.int64)
        sums[:, 4] = fine
        for k, ends in ((0, ends_a), (1, ends_b)):
            sums[good, k] = np.diff(np.searchsorted(ends, unit_ends, "right"), prepend=0)
        # between two neighbouring borders of either side lies one pair of overlapping tokens
        edges = np.union1d(ends_a, ends_b)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = np.bincount(np.searchsorted(unit_ends, edges), minlength=len(good))
        groups = np.searchsorted(shared, unit_ends, "right")
        sums[good, 3], sums[good, 2] = links, np.diff(groups, prepend=0)
        pairs = a[np.searchsorted(ends_a, edges)] << 32 | b[np.searchsorted(ends_b, edges)]
        texts = self._texts(a, b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), groups)
        size = np.zeros(len(units), np.int64)
        size[good] = links
        last = self.borders[-1]
        self.numbers.update(zip(units, range(len(self.texts), len(self.texts) + len(units)), strict=True))
        self.sums.frombytes(sums.tobytes())
        self.pairs.frombytes(pairs.tobytes())
        self.borders.frombytes((last + np.cumsum(size)).tobytes())
        every = [b""] * len(units)
        for i, text in zip(good.tolist(), texts, strict=True):
            every[i] = text
        self.texts += every
        self.room -= sum(260 + 3 * len(u) + len(x) for u, x in zip(raw, every, strict=True)) + 8 * len(pairs)

    def _texts(self, a, b, group_a, group_b, borders) -> list[bytes]:
        """``a1,a2|b1`` for each group, joined by ``;`` for each unit: its groups end before its border."""
        side = np.repeat([0, 1], [len(a), len(b)])
        group = np.concatenate([group_a, group_b])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, side, group = np.concatenate([a, b])[order], side[order], group[order]
        ends = np.append((side[1:] != side[:-1]) | (group[1:] != group[:-1]), True) if len(ids) else np.zeros(0, bool)
        shown = [*map(self.shown.__getitem__, (ids + len(self.shown) // 3 * np.where(ends, 1 + side, 0)).tolist())]
        at = np.searchsorted(group, borders).tolist()
        return [b"".join(shown[lo:hi])[:-1] for lo, hi in zip([0, *at], at, strict=False)]

    def texts_at_once(self, parts: list[str]) -> tuple:
        """(sums of each part, bytes of its groups or None where a unit isn't spelled, and (part, pair, times) of links, of which a pair may come several times)."""
        if self.room < 0:
            self.clear()
        units = [units_of(p) if self.cuts else [p] for p in parts]
        flat = list(chain.from_iterable(units))
        new = [u for u in dict.fromkeys(flat) if u not in self.numbers]
        if new:
            self.add(new)
        numbers = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        borders = np.append(0, np.cumsum([len(u) for u in units]))
        facts = np.frombuffer(self.sums, np.int64).reshape(-1, 5)
        total = np.stack([sums_between(facts[numbers, k], np.diff(borders)) for k in range(5)], axis=1)
        spelled = total[:, 4] == np.diff(borders)
        lists, find = numbers.tolist(), self.texts.__getitem__
        groups = [b";".join(map(find, lists[lo:hi])) if fine else None for lo, hi, fine in zip(borders.tolist(), borders[1:].tolist(), spelled.tolist(), strict=False)]
        stay = np.repeat(spelled, np.diff(borders))
        owner = np.repeat(np.arange(len(parts)), np.diff(borders))[stay]
        key, often = np.unique(owner * len(self.texts) + numbers[stay], return_counts=True)
        owner, own = key // max(1, len(self.texts)), key % max(1, len(self.texts))
        border = np.frombuffer(self.borders, np.int64)
        size = border[own + 1] - border[own]
        at = np.repeat(border[own] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
        return total, groups, np.repeat(owner, size), np.frombuffer(self.pairs, np.int64)[at], np.repeat(often, size)

    def documents(self, texts: list[str], limit: int = 1 << 20):
        """(number, (n_a, n_b, n_groups, n_links, groups_sha256) or None if its tokens don't spell it) of each text, and then (number, pair, times) of a few of them."""
        some, chars = [], 0
        for i, text in enumerate(texts):
            if len(text) > limit:
                yield from self._long(i, text, limit)
                continue
            some.append((i, text))
            chars += len(text)
            if chars > limit:
                yield self._short(some)
                some, chars = [], 0
        if some:
            yield self._short(some)

    def _short(self, some: list) -> tuple:
        total, groups, owner, pairs, times = self.texts_at_once([" " + t for _, t in some])
        found = [(i, (*total[k, :4].tolist(), hashlib.sha256(groups[k]).hexdigest()) if groups[k] is not None else None) for k, (i, _) in enumerate(some)]
        owner = np.array([i for i, _ in some], np.int64)[owner]
        for k, (i, text) in enumerate(some):
            if groups[k] is None:
                found[k] = (i, None)
                if whole := self._whole(text):
                    found[k] = (i, whole[0])
                    owner, pairs, times = np.append(owner, np.full(len(whole[1]), i)), np.append(pairs, whole[1]), np.append(times, np.ones(len(whole[1]), np.int64))
        return found, owner, pairs, times

    def _long(self, number: int, text: str, limit: int):
        digest, sums, held = hashlib.sha256(), np.zeros(5, np.int64), []
        for n, part in enumerate(segments(" " + text, limit) if self.cuts else [" " + text]):
            total, groups, _, pairs, times = self.texts_at_once([part])
            if groups[0] is None:
                whole = self._whole(text)
                held = [(whole[1], np.ones(len(whole[1]), np.int64))] if whole else []
                yield [(number, whole[0] if whole else None)], *_owned(number, held)
                return
            digest.update(b";" * (n > 0) + groups[0])
            sums += total[0]
            held.append(_added(pairs, times))
        yield [(number, (*sums[:4].tolist(), digest.hexdigest()))], *_owned(number, held)

    def _whole(self, text: str) -> tuple | None:
        """A text with a unit that its tokens don't spell: the whole decides."""
        alone = Aligner.__new__(Aligner)
        alone.side_a, alone.side_b, alone.limit, alone.shown = self.side_a, self.side_b, 0, self.shown
        alone.clear()
        alone.add([" " + text])
        return ((*alone.sums[:4], hashlib.sha256(alone.texts[0]).hexdigest()), np.array(alone.pairs, np.int64)) if alone.sums[4] else None


def _owned(number: int, held: list) -> tuple:
    pairs, times = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1))
    return np.full(len(pairs), number), pairs, times


@lru_cache(1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker: a unit that the last task met need not be encoded again."""
    return Aligner(path_a, path_b)


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of equal keys added up; keys ascend."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


def index_batches(container: int, pairs: np.ndarray, places: np.ndarray, times: np.ndarray):
    """Record batches of POSTINGS for one container; times of equal (pair, place) add up."""
    key, times = _added((pairs >> 32) << 32 | (pairs & 0xFFFFFFFF) << LOW_BITS | places, times)  # ids have 20 bits, places 12
    pairs, places = key >> 32 << 32 | (key & 0xFFFFFFFF) >> LOW_BITS, (key & CONTAINER - 1).astype("<u2")
    first = np.append(True, pairs[1:] != pairs[:-1])
    held = np.diff(np.append(np.flatnonzero(first), len(pairs)))  # bits of all planes of a pair, OR-merged
    held_at, told = np.cumsum(first) - 1, np.zeros(len(held), bool)
    for plane in range(int(times.max()).bit_length()):
        here = np.flatnonzero(times >> plane & 1)
        at = held_at[here]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(here) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(here)))
        owner = at[start]
        n = np.where(told[owner], 0, held[owner])
        told[owner] = True
        key = pairs[here[start]]
        dense = size * 2 > CONTAINER // 8
        lists = places[here[~np.repeat(dense, size)]]
        offsets = np.zeros((~dense).sum() + 1, np.int32)
        np.cumsum(size[~dense] * 2, out=offsets[1:])
        short = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(lists)])
        maps = []
        for k in np.flatnonzero(dense).tolist():
            bits = np.zeros(CONTAINER, np.uint8)
            bits[places[here[start[k] : start[k] + size[k]]]] = 1
            maps.append(np.packbits(bits, bitorder="little").tobytes())
        for which, short_part, map_part in ((~dense, short, None), (dense, None, pa.array(maps, pa.binary()))):
            rows = int(which.sum())
            if rows:
                none = pa.nulls(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((key[which] >> 32).astype(np.int32)), pa.array((key[which] & 0xFFFFFFFF).astype(np.int32)), pa.array(np.full(rows, container)), pa.array(np.full(rows, plane, np.int32)), pa.array(n[which].astype(np.int32)), pa.array(size[which].astype(np.int32)), short_part or none, map_part if map_part is not None else none], [c.split()[0] for c in POSTINGS.split(", ")])


def build_index(docs: DataFrame, path_a: str, path_b: str, postings: int = 2_000_000) -> DataFrame:
    """docs -> one table with the rows of DOCUMENTS (a is null) and of POSTINGS (row is null). A task holds about ``postings`` of a container's
    postings before it writes them; a container may come in several parts, which have no document in common."""
    both = [pa.field(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in f"{DOCUMENTS}, {POSTINGS}".split(", ")]

    def widened(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([batch.column(names.index(f.name)).cast(f.type) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in both], schema=pa.schema(both))

    def run(batches):
        aligner = aligner_of(path_a, path_b)
        container, held, parts = None, 0, []

        def flush():
            nonlocal held, parts
            if parts:
                places, pairs, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
                parts, held = [], 0
                yield from map(widened, index_batches(container, pairs, places, times))

        for batch in batches:
            rows, ids = (batch.column(i).to_numpy(zero_copy_only=False) if not i else batch.column(i) for i in (0, 1))
            texts = batch.column(2).to_pylist()
            edges = np.flatnonzero(np.append(True, rows[1:] >> LOW_BITS != rows[:-1] >> LOW_BITS)) if len(rows) else []
            for lo, hi in zip(edges, [*edges[1:], len(rows)], strict=True):
                if rows[lo] >> LOW_BITS != container:
                    yield from flush()
                    container = int(rows[lo] >> LOW_BITS)
                facts = [(0, 0, 0, 0, "")] * (hi - lo)
                some = [i for i in range(hi - lo) if texts[lo + i]]
                for found, owner, pairs, times in aligner.documents([texts[lo + i] for i in some]):
                    for k, known in found:
                        facts[some[k]] = known or facts[some[k]]
                    parts.append((np.array([int(rows[lo + i] & CONTAINER - 1) for i in some], np.int64)[owner], pairs, times))
                    held += len(pairs)
                    if held >= postings:
                        yield from flush()
                columns = [*zip(*facts, strict=True)]
                yield widened(pa.RecordBatch.from_arrays([pa.array(rows[lo:hi]), ids.slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [c.split()[0] for c in DOCUMENTS.split(", ")]))
        yield from flush()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"{DOCUMENTS}, {POSTINGS}")


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, count, best): the documents that hold a pair, and whether no other pair of the same a has more."""
    counts = cut(index.where("a is not null and n > 0").groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): what the postings return to their documents. A task holds one container's sums at a time."""
    known = index.where("a is not null").select("a", "b", "container", "plane", "places", "bits").join(counts.hint("merge"), ["a", "b"])  # pairs have no bound that allows sending them to all
    dealt = known.select("container", "plane", "places", "bits", "count", "best").repartition("container").sortWithinPartitions("container")

    def run(batches):
        now, sums = None, None

        def rows():
            some = np.flatnonzero(sums.any(axis=0))
            return pa.RecordBatch.from_arrays([pa.array((now << LOW_BITS) + some), pa.array(sums[0, some]), pa.array(sums[1, some])], ["row", "n_best", "count_sum"])

        for batch in batches:
            owner, plane, count, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
            edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
            for lo, hi in zip(edges, [*edges[1:], len(owner)], strict=True):
                if owner[lo] != now:
                    if now is not None:
                        yield rows()
                    now, sums = int(owner[lo]), np.zeros((2, CONTAINER), np.int64)
                lists, maps = batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)
                size = pc.binary_length(lists).fill_null(0).to_numpy(zero_copy_only=False) // 2
                places = np.frombuffer(b"".join(x for x in lists.to_pylist() if x), "<u2")
                times = np.left_shift(1, plane[lo:hi].astype(np.int64))
                np.add.at(sums[0], places, np.repeat(times * best[lo:hi], size))
                np.add.at(sums[1], places, np.repeat(times * count[lo:hi], size))
                for k, bits in enumerate(maps.to_pylist()):
                    if bits:
                        on = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
                        sums[0, on] += times[k] * best[lo + k]
                        sums[1, on] += times[k] * count[lo + k]
        if now is not None:
            yield rows()

    return dealt.mapInArrow(lean(run), "row long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each input row.

    Null and empty texts, and those that one of the tokenizers does not spell byte for byte, have no tokens: zeros and ''. Repeated rows and rows
    without an id are documents of their own. Other columns are ignored. docs must be read from files (or a cut). An empty table gives no rows.
    """
    index = cut(build_index(docs, path_a, path_b))
    scored = scores(index, pair_counts(index))
    plain = index.where("a is null").select(*[c.split()[0] for c in DOCUMENTS.split(", ")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return plain.join(scored.hint("merge"), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, documents, links, best): every pair of token ids that is linked somewhere, in how many documents, and how often, which the planes tell."""
    index = cut(build_index(docs, path_a, path_b))
    each = index.where("a is not null").select("a", "b", F.expr("shiftleft(cast(size as bigint), plane)").alias("links"))
    return pair_counts(index).join(each.groupBy("a", "b").agg(F.sum("links").alias("links")), ["a", "b"]).select("a", "b", F.col("count").alias("documents"), "links", "best")


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
