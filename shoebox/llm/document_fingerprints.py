"""Document fingerprints (operator 13): randomised edit embedding.

A walker goes over the characters of a text. At each position of the embedding it writes the character it stands on, and then steps to the next one or
stays, as a random bit that all walkers share tells for that position and that character (Chakraborty, Goldenberg, Koucký 2016). Two walkers
that an edit has set apart meet again, and from then on write the same: texts at a small edit distance have embeddings at a small Hamming distance.

A fingerprint keeps one hex digit of hashed character at sampled positions: all of the first SAMPLED, then SAMPLED of each octave of positions, one from each of so
many equal strata. So it has about SAMPLED * log2(length) digits whatever the length, and fingerprints of texts of different lengths compare position by position. Likeness is the
share of positions that agree, each sample counting for its stratum. The digits of an octave make BANDS bands; texts that share a band are candidates, which
likeness then verifies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, table
from .components import components
from .kernels import U, lean, mix

#: The shared random bits repeat after so many positions; characters are hashed to so many classes.
PERIOD, CLASSES = 1024, 256
SAMPLED, BANDS, OCTAVES = 64, 8, 40
#: Below so many texts that still walk, one by one is faster than side by side.
FEW = 64


def _strides() -> np.ndarray:
    """[class, position]: how many positions a walker writes for a character of the class that it reaches at the position."""
    bits = (mix(np.arange(CLASSES * PERIOD, dtype=U) + U(1 << 40)) >> U(17) & U(1)).astype(bool).reshape(CLASSES, PERIOD)
    out, waiting = np.ones((CLASSES, PERIOD), np.uint8), ~bits
    for k in range(1, 250):
        out[waiting] += 1
        waiting &= ~np.roll(bits, -k, axis=1)
    return out


def _samples() -> tuple[np.ndarray, np.ndarray]:
    """(positions, widths of their strata), in order."""
    places, widths = [np.arange(SAMPLED)], [np.ones(SAMPLED, np.int64)]
    for k in range(OCTAVES):
        width = 1 << k
        start = (SAMPLED + np.arange(SAMPLED)) * width
        places.append(start + (mix(start.astype(U) + U(7)) % U(width)).astype(np.int64))
        widths.append(np.full(SAMPLED, width))
    return np.concatenate(places), np.concatenate(widths)


STRIDES = _strides()
ROWS = [bytes(row) for row in STRIDES]
PLACES, WIDTHS = _samples()
CLASS = (mix(np.arange(0x110000, dtype=U)) % U(CLASSES)).astype(np.uint8)
DIGIT = np.frombuffer(b"0123456789abcdef", np.uint8)[(mix(np.arange(len(PLACES) * CLASSES, dtype=U) + U(1 << 50)) % U(16)).astype(np.int64)].reshape(-1, CLASSES)


def _walk(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each letter the position behind what its walker writes for it. Texts come longest first."""
    ends, at = np.zeros(len(letters), np.int64), np.zeros(len(start), np.int64)
    active = np.searchsorted(-size, -np.arange(int(size[0]) + 1 if len(size) else 0), "left")  # texts longer than i
    done = 0
    for done, m in enumerate(active.tolist()):
        if m < FEW:
            break
        here = start[:m] + done
        at[:m] += STRIDES[letters[here], at[:m] & PERIOD - 1]
        ends[here] = at[:m]
    for k in range(int(active[done]) if len(active) else 0):
        j, out = int(at[k]), []
        for c in letters[start[k] + done : start[k] + size[k]].tobytes():
            j += ROWS[c][j & 1023]
            out.append(j)
        ends[start[k] + done : start[k] + size[k]] = out
    return ends


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text; that of an empty one is empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    letters = CLASS[np.frombuffer("".join([texts[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = sizes[order]
    start = np.cumsum(size) - size
    ends = _walk(letters, start, size)
    out = [""] * len(texts)
    for i, lo, n in zip(order.tolist(), start.tolist(), size.tolist(), strict=True):
        if n:
            own = ends[lo : lo + n]
            k = int(np.searchsorted(PLACES, own[-1]))
            symbols = letters[lo + np.searchsorted(own, PLACES[:k], "right")]
            out[i] = DIGIT[np.arange(k), symbols].tobytes().decode()
    return out


def likeness(one: str, other: str) -> float:
    """The share of positions of the longer embedding at which both agree, 0 to 1, as the samples estimate it; 1 for two empty ones."""
    n, m = sorted((len(one), len(other)))
    if not m:
        return 1.0
    same = np.frombuffer(one[:n].encode(), np.uint8) == np.frombuffer(other[:n].encode(), np.uint8)
    return float(WIDTHS[:n][same].sum() / WIDTHS[:m].sum())


def bands(fingerprint: str) -> list[str]:
    """Keys of the last two whole octaves, BANDS each, their digits dealt in turn; a fingerprint without an octave of its own is one key."""
    whole = len(fingerprint) // SAMPLED
    if not whole:
        return ["-:" + fingerprint]
    return [f"{k}:{b}:{fingerprint[k * SAMPLED + b : (k + 1) * SAMPLED : BANDS]}" for k in range(max(0, whole - 2), whole) for b in range(BANDS)]


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _splits(rows: DataFrame, parts: int) -> np.ndarray:
    """First keys (id is there, id, row) of ``parts`` ranges of about equal numbers of rows; each is the key of a row. The driver sees these only."""

    def run(batches):
        low = None
        for batch in batches:
            for row, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = (doc_id is not None, doc_id or 0, row)
                low = key if low is None else min(low, key)
        if low is not None:
            yield pa.RecordBatch.from_pylist([{"known": int(low[0]), "doc_id": low[1], "row": low[2]}])

    found = rows.select("row", "doc_id").repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.asc("row")).mapInArrow(run, "known long, doc_id long, row long").collect()
    return np.array(sorted(map(tuple, found)), np.int64).reshape(-1, 3)


def _dealt(rows: DataFrame, splits: np.ndarray) -> DataFrame:
    """rows by range, in order of (doc_id, row), null ids first, each range followed by a copy of the next one's first row (own is false)."""
    low = {tuple(s): i for i, s in enumerate(splits.tolist())}
    known, ids, numbers = (np.ascontiguousarray(splits[:, k]) for k in range(3))

    def run(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            there = np.array(batch.column(1).is_valid())
            doc_id = batch.column(1).fill_null(0).to_numpy()
            lo, hi = np.zeros(len(row), np.int64), np.full(len(row), len(known))
            while (lo < hi).any():  # the last split that is not above the key
                mid = np.minimum((lo + hi) // 2, len(known) - 1)
                above = (known[mid] > there) | (known[mid] == there) & ((ids[mid] > doc_id) | (ids[mid] == doc_id) & (numbers[mid] > row))
                open_ = lo < hi
                hi, lo = np.where(open_ & above, mid, hi), np.where(open_ & ~above, mid + 1, lo)
            part = lo - 1
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(row), bool)), *batch.columns], ["part", "own", "row", "doc_id", "text"])
            first = [k for k, key in enumerate(zip(there.tolist(), doc_id.tolist(), row.tolist(), strict=True)) if (int(key[0]), *key[1:]) in low]
            if first:
                copy = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array((part[first] - 1) % len(known)), pa.array(np.zeros(len(first), bool)), *copy.columns], ["part", "own", "row", "doc_id", "text"])

    marked = rows.mapInArrow(run, "part long, own boolean, row long, doc_id long, text string")
    return marked.repartition("part").sortWithinPartitions("part", F.desc("own"), F.asc_nulls_first("doc_id"), "row")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"


def compare_with_next(docs: DataFrame, parts: int | None = None, limit: int = 2_000_000) -> DataFrame:
    """(doc_id, text) -> COMPARED, one row for each input row: its fingerprint, that of its edited text, whose last half is the beginning of the next
    document's text, how like it is to that and to the next document's, and how many bands it shares with them.

    The next document is the one with the next larger doc_id, null ids first, rows of one id in the order of the table; the first follows the last. Null
    texts are empty. Texts travel once, by ranges of ids with as many rows each; an id of any number of rows is split. docs must be
    read from files (or a cut), so that rows keep their numbers. Other columns are ignored. An empty table gives no rows.
    """
    rows = _numbered(docs)
    splits = _splits(rows, parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not len(splits):
        splits = np.zeros((1, 3), np.int64)

    def run(batches):
        held, some, chars = [], [], 0

        def flush():
            nonlocal held, some, chars
            prints = fingerprints([r[2] for r in some])
            rows = held + [(*r, f) for r, f in zip(some, prints, strict=True)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0]]
            edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in pairs]
            changed = fingerprints(edited)
            out = []
            for (a, b), text, f in zip(pairs, edited, changed, strict=True):
                own = set(bands(a[3]))
                out.append((a[1], len(a[2]), hashlib.sha256(text.encode()).hexdigest(), a[3], f, likeness(a[3], f), likeness(a[3], b[3]), len(own & set(bands(f))), len(own & set(bands(b[3])))))
            held, some, chars = rows[-1:], [], 0
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in COMPARED.split(", ")])

        for batch in batches:
            for part, doc_id, text in zip(*(batch.column(i) for i in (0, 3, 4)), strict=True):
                text = text.as_py() or ""
                some.append((part.as_py(), doc_id.as_py(), text))
                chars += len(text)
                if chars > limit:
                    yield from flush()
        if some:
            yield from flush()

    return _dealt(rows, splits).mapInArrow(lean(run), COMPARED)


def near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, class_id, links): documents whose fingerprints are at least ``least`` alike, by banding and verification. class_id is
    the smallest row number of what is linked; links: verified ones of the row's fingerprint.

    Equal fingerprints are one candidate. In a band's bucket all candidates are compared with its smallest; those that are not like it are compared among
    themselves in the next round, and so on until none is left, so a bucket of any size sends each candidate once a round and no product is made.
    Null texts are empty; repeated rows are in one class; null ids stay. docs must be read from files (or a cut). An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts, done = [t or "" for t in batch.column(2).to_pylist()], []
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < 2_000_000):
                    chars, hi = chars + len(texts[hi]), hi + 1
                done += fingerprints(texts[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], ["row", "doc_id", "fingerprint"])

    rows = cut(_numbered(docs).mapInArrow(lean(run), "row long, doc_id long, fingerprint string"))
    one = cut(rows.groupBy("fingerprint").agg(F.min("row").alias("id")))
    keys = one.select("id", "fingerprint").mapInArrow(_banded, "id long, key string")
    open_, edges = cut(keys), None
    while True:
        first = open_.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        pairs = open_.join(first, "key").where("id <> first")
        facts = one.select(F.col("id").alias("first"), F.col("fingerprint").alias("other"))
        judged = cut(pairs.join(one, "id").join(facts, "first").mapInArrow(_judged(least), "id long, first long, key string, near boolean"))
        if judged.isEmpty():
            discard(judged, open_)
            break
        new = cut(judged.where("near").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct())
        edges = new if edges is None else edges.unionByName(new)
        rest = cut(judged.where("not near").select("id", "key"))
        discard(judged, open_)
        open_ = rest
    none = one.select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v")).limit(0)
    edges = (none if edges is None else edges).distinct()
    linked = components(edges)
    count = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    known = one.join(linked, one["id"] == linked["node"], "left").join(count, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return rows.join(known, "fingerprint").select("doc_id", "fingerprint", "class_id", "links")


def _banded(batches):
    for batch in batches:
        every = [bands(f) for f in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in every])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([k for x in every for k in x], pa.string())], ["id", "key"])


def _judged(least: float):
    def run(batches):
        for batch in batches:
            own, other = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("fingerprint", "other"))
            near = [likeness(a, b) >= least for a, b in zip(own, other, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in ("id", "first", "key")), pa.array(near, pa.bool_())], ["id", "first", "key", "near"])

    return run


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op13_document_fingerprints": op13_document_fingerprints}
