"""Substring dedup (operator 5): repeated word windows by level-wise doubling.

The target is every window of ``window`` words whose word sequence starts elsewhere too. Levels are
lengths that double from ``first`` up to ``window``. At a level of length l, an alive window is represented by the smallest
fingerprint among the l-word sequences inside it; equal windows pick equal ones. A window stays
alive only if its pick occurs more than once in the corpus, and then is
represented at twice the length, until the last level, where the pick is the window itself.
So the first level shuffles a small share of all positions, and each further one only
those that survive.

A level is one shuffle by fingerprint. On the last level, which decides, a second fingerprint is compared too (64 + 32 bits):
of w different windows about w * w / 2**97 pairs would count as equal, 0.0006 for 10**13 windows. Fingerprints that already repeat inside an Arrow
batch are known there: their places skip the count, and a single counted row stands for the batch,
so a passage that a third of all documents share sends one row a batch to its
key. Places come back grouped by document and are joined with the texts on a row number; both
levels and the last step use the same shuffled texts.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, table, together
from .kernels import U, Words, lean, mix, sliding, text_slices, window_hash
from .text_stats import covered

#: Turns word fingerprints into those of the second window fingerprint.
SECOND = U(0xC2B2AE3D27D4EB4F)
TOP = U(0xFFFFFFFFFFFFFFFF)
PLACES = "key long, row long, place int, times int, sure int"


def levels(first: int, window: int) -> list[int]:
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def targets(words: Words, window: int) -> np.ndarray:
    return np.arange(len(words)) + window <= words.last


def picks(h: np.ndarray, alive: np.ndarray, span: int) -> np.ndarray:
    """Places whose fingerprint is the smallest of an alive window; span: places in a window."""
    low = np.where(alive, sliding(np.minimum, h, span), U(0))
    if span == 1:
        return np.flatnonzero(alive)
    high = sliding(np.maximum, low[::-1], span)[::-1]  # over the windows that hold the place
    return np.flatnonzero((h == high) & (sliding(np.maximum, alive[::-1].astype(np.int8), span)[::-1] > 0))


def survivors(h: np.ndarray, places: np.ndarray, candidates: np.ndarray, span: int) -> np.ndarray:
    """Of the candidate windows, those whose smallest fingerprint is at one of the places."""
    kept = np.full(len(h), TOP)
    kept[places] = h[places]
    return candidates & (sliding(np.minimum, kept, span) == sliding(np.minimum, h, span)) & (sliding(np.minimum, kept, span) != TOP)


def flat_places(column: pa.Array, lo: int, hi: int, words: Words) -> np.ndarray:
    """A list column of places within texts -> places among the slice's words."""
    part = column.slice(lo, hi - lo)
    counts = np.array([len(x) if x is not None else 0 for x in part.to_pylist()]) if part.null_count else np.diff(part.offsets.to_numpy())
    values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values + np.repeat(words.first[:-1], counts)


def level_rows(rows: np.ndarray, keys: np.ndarray, sure: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows to count. What repeats inside the batch is known: it is keyed by its own document with times = 2, and one
    row without a place stands for it under its fingerprints."""
    order = np.lexsort((sure, keys))
    k, c = keys[order], sure[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(k)))
    times = np.empty(len(k), np.int64)
    times[order] = np.repeat(size, size)
    known = times > 1
    first = np.flatnonzero(new)[size > 1]
    own = mix(rows.astype(U) ^ U(0x5851F42D4C957F2D))
    key = np.concatenate([np.where(known, own, keys), k[first]]).view(np.int64)
    none = np.zeros(len(first), np.int64)
    is_head = np.concatenate([np.zeros(len(keys), bool), np.ones(len(first), bool)])
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(np.concatenate([rows, none]), mask=is_head), pa.array(np.concatenate([places, none]).astype(np.int32), mask=is_head), pa.array(np.concatenate([np.where(known, 2, 1), none + 2]).astype(np.int32)), pa.array(np.concatenate([np.where(known, 0, sure), c[first]]).astype(np.uint32).view(np.int32))],
        ["key", "row", "place", "times", "sure"],
    )


def repeated_places(docs: DataFrame, window: int, first: int) -> DataFrame:
    """docs: (row, text, ...) -> (at, places): starts of windows that occur more than once, by row."""
    found, steps = None, levels(first, window)
    for n, length in enumerate(steps):
        source = docs if found is None else docs.join(found, docs["row"] == found["at"])
        source = source.select(*docs.columns, *(["places"] if n else []))  # the same columns each time, so that Spark reuses the shuffle
        before, last = steps[n - 1] if n else 0, n + 1 == len(steps)

        def run(batches, length=length, before=before, last=last):
            for batch in batches:
                keys, checks, rows, places = [], [], [], []
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for lo, hi, buf, offs in text_slices(batch.column(1)):
                    words = Words(buf, offs)
                    if not len(words):
                        continue
                    alive = targets(words, window)
                    if before:
                        alive = survivors(window_hash(words.hash, before), flat_places(batch.column(batch.num_columns - 1), lo, hi, words), alive, window - before + 1)
                    h = window_hash(words.hash, length)
                    at = picks(h, alive, window - length + 1)
                    keys.append(h[at])
                    checks.append(window_hash(words.hash ^ SECOND, length)[at] >> U(32) if last else np.zeros(len(at), U))
                    rows.append(ids[lo + words.text[at]])
                    places.append(at - words.first[words.text[at]])
                if keys:
                    yield level_rows(*map(np.concatenate, (rows, keys, checks, places)))

        counted = source.mapInArrow(lean(run), PLACES).withColumn("total", F.sum("times").over(Window.partitionBy("key", "sure")))
        found = counted.where("total > 1 and row is not null").groupBy(F.col("row").alias("at")).agg(F.collect_list("place").alias("places"))
    return found


def _covered(docs: DataFrame, window: int, first: int) -> DataFrame:
    """(row, text, rest, places) of all rows of docs; see ``apart``. docs must be read from files (or a cut), so that a retried or
    repeated read numbers the rows alike."""
    text, rest = apart(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), text, rest)
    places = repeated_places(rows, window, first)
    return rows.join(places, rows["row"] == places["at"], "left").select("row", "text", "rest", "places")


def find(docs: DataFrame, window: int = 35, first: int = 18) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) with the repeated words removed; one row for each input row.

    Null and empty texts have no words; texts shorter than the window keep all. Repeated rows are
    repeats of each other; null ids stay. Other columns are ignored, whatever their names. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(2).field("c0")
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                words = Words(buf, offs)
                gone = covered(flat_places(batch.column(3), lo, hi, words), window, len(words))
                removed = np.bincount(words.text[gone], minlength=hi - lo)
                keep = np.ones(len(words), bool)
                keep[gone] = False
                digests = []
                for i in range(hi - lo):
                    own = buf[offs[i] : offs[i + 1]].tobytes().split()
                    if removed[i]:
                        own = compress(own, keep[words.first[i] : words.first[i + 1]].tolist())
                    digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _covered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, first)
    return rows.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 35, first: int = 18, drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated words cut out of their texts; all columns stay, whatever their names. A text without repeats stays byte for
    byte; the others keep their words joined by one space. Texts that lose every word become empty, or their rows go if ``drop_emptied``.
    Null and empty texts stay as they are; repeated rows are repeats of each other. An empty table stays empty."""

    def run(batches):
        for batch in batches:
            texts, stay = batch.column(1).to_pylist(), np.ones(batch.num_rows, bool)
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                words = Words(buf, offs)
                gone = covered(flat_places(batch.column(3), lo, hi, words), window, len(words))
                keep = np.ones(len(words), bool)
                keep[gone] = False
                for i in np.unique(words.text[gone]).tolist():
                    own = buf[offs[i] : offs[i + 1]].tobytes().split()
                    texts[lo + i] = b" ".join(compress(own, keep[words.first[i] : words.first[i + 1]].tolist())).decode()
                    stay[lo + i] = bool(texts[lo + i]) or not drop_emptied
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "rest"]).filter(pa.array(stay))

    rows = _covered(docs, window, first)
    return together(rows.mapInArrow(lean(run), rows.select("text", "rest").schema), docs)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


ORACLE = {
    "op5_substring_dedup": r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
w as (select rid, i, md5(array_to_string(ws[i:i + 34], ' ')) g from (select *, unnest(range(1, len(ws) - 33)) i from d where len(ws) >= 35)),
r as (select g from w group by g having count(*) > 1),
gone as (select distinct rid, unnest(range(i, i + 35)) p from w where g in (select g from r)),
o as (select rid, doc_id, unnest(ws) x, unnest(range(1, len(ws) + 1)) p from d),
k as (select o.rid, string_agg(x, ' ' order by o.p) filter (gone.p is null) kept, count(gone.p) n from o left join gone on o.rid = gone.rid and o.p = gone.p group by o.rid)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (rid)"""
}
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
