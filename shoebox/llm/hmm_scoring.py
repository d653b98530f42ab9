"""LM scoring (operator 3): a hidden Markov language model over words.

Counts of all training words are one aggregation. The ``symbols`` most frequent words are
symbols of their own; every other word belongs to one of ``classes`` classes by its last bytes. Latent states emit symbols;
a word of a class then has probability (c + 1) / (tokens + words of the class + 1), which leaves room for
unknown words. Baum-Welch: a start on a bounded sample, then passes over all training documents, whole texts
by the forward-backward recursion, whose expected counts are summed across partitions. A text's score is exact: the scaled forward
recursion over all of its tokens, batch-wise, plus the words' probabilities inside their classes.

Words are 64-bit fingerprints: of v different ones about v * v / 2**65 pairs would count as one word.
Counts of the ``size`` most frequent words are broadcast (a bound that does not grow). The other words of a
document are looked up by a join; as each is rare, no key of that join is hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_fold, labelled_sample, table, top_counts
from .kernels import LOWER, U, Words, lean, mix, release, text_slices

END = int(mix(np.array([0xE0D], U)).view(np.int64)[0])
#: Tokens whose forward values a task holds at a time; longer slices are redone block by block from the states at block borders.
HELD = 1 << 19


class Lookup:
    """Places of fingerprints in a sorted array, by their leading bits; -1 where absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U(64 - max(1, int(len(keys)).bit_length()))
        self.start = np.searchsorted(keys >> self.shift, np.arange((1 << int(U(64) - self.shift)) + 1, dtype=U))
        self.most = int(np.diff(self.start).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not self.most:
            return out
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        open_ = np.flatnonzero(at < end)
        for _ in range(self.most):
            here = at[open_]
            same = self.keys[here] == h[open_]
            out[open_[same]] = here[same]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
            if not len(open_):
                break
        return out


def tokens_of(column, limit: int = 1 << 17):
    """Per slice of texts: (first text, texts, fingerprints, class hash, text of each word, words)."""
    for lo, hi, buf, offs in text_slices(column, limit):
        words = Words(LOWER[buf], offs)
        low = LOWER[buf]
        tail = np.zeros(len(words), np.uint32)
        for j in range(1, 4):
            at = words.end - j
            tail = tail * np.uint32(257) + np.where(at >= words.start, low[np.maximum(at, 0)], 0).astype(np.uint32)
        yield lo, hi, words, (tail * np.uint32(2654435769)) >> np.uint32(16)


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(key, class, n) of the words and the end of each text of docs."""

    def run(batches):
        for batch in batches:
            keys, kinds = [np.full(batch.num_rows, END, np.int64).view(U)], [np.zeros(batch.num_rows, np.int64)]
            for _, _, words, tail in tokens_of(batch.column(0)):
                keys.append(words.hash)
                kinds.append(tail.astype(np.int64) % classes)
            keys, kinds = np.concatenate(keys), np.concatenate(kinds)
            order = np.argsort(keys)
            keys, kinds = keys[order], kinds[order]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(kinds[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(keys))))], ["key", "class", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "key long, class int, n long").groupBy("key", "class").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Bounded: the most frequent words' counts and symbols, and totals by class."""

    def __init__(self, counts: DataFrame, symbols: int, classes: int, size: int):
        total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.n, self.v, self.classes = int(total.n or 0), int(total.v), classes
        top = top_counts(counts, size).toPandas().sort_values(["n", "key"], ascending=[False, True], ignore_index=True)
        if END not in set(top["key"]):  # the end always is in the table and a symbol
            top = pd.concat([top, counts.where(F.col("key") == END).select(*top.columns).toPandas()])
        key, n, kind = top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["class"].to_numpy(np.int64)
        by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
        mass, kinds = np.zeros(classes), np.zeros(classes)
        mass[by_class["class"]], kinds[by_class["class"]] = by_class["n"], by_class["v"]
        own = np.arange(len(key)) < symbols
        own |= key == END
        np.subtract.at(mass, kind[own], n[own])
        np.subtract.at(kinds, kind[own], 1)
        self.room = np.log10(mass + kinds + 1)  # of each class
        rank = np.cumsum(own) - 1
        self.symbols = int(own.sum())
        order = np.argsort(key.view(U))
        self.lookup, self.count = Lookup(key.view(U)[order]), n[order]
        self.symbol = np.where(own, rank, self.symbols + kind)[order].astype(np.int32)
        at = self.lookup.find(np.array([END], np.int64).view(U))[0]
        self.end = int(self.symbol[at]) if at >= 0 else self.symbols  # without training texts: some class
        self.end_count = int(self.count[at]) if at >= 0 else 0
        self.mass = np.zeros(self.symbols + classes)
        np.add.at(self.mass, self.symbol, self.count)
        self.mass[self.symbols :] = np.maximum(mass, 0)

    @property
    def size(self) -> int:
        return self.symbols + self.classes

    def read(self, column):
        """(texts, symbols with an end after each text, borders, words, places in the table) per slice."""
        for lo, hi, words, tail in tokens_of(column):
            at = self.lookup.find(words.hash)
            symbol = np.where(at >= 0, self.symbol[at] if len(self.symbol) else 0, self.symbols + tail.astype(np.int64) % self.classes)
            out = np.full(len(words) + hi - lo, self.end, np.int32)
            out[np.arange(len(words)) + words.text] = symbol
            yield lo, hi, out, words.first + np.arange(hi - lo + 1), words, at, symbol


class Hmm:
    def __init__(self, states: int, mass: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k = states
        self.move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        self.move /= self.move.sum(1, keepdims=True)
        self.first = np.full(states, 1 / states)
        self.base = (mass + 0.5) / (mass + 0.5).sum()
        self.emit = self.base * rng.gamma(0.6, 1, (states, len(mass))) + 0.05 * self.base
        self.emit /= self.emit.sum(1, keepdims=True)

    def expect(self, symbols: np.ndarray, border: np.ndarray, total: dict, held: int = HELD) -> None:
        """Adds the expected counts of whole sequences (forward-backward, all of them in step). Values lie in time-major order: step by
        step, longest sequence first. Above ``held`` tokens only the forward states at block borders are kept, and a block is redone on the way back."""
        lengths = np.diff(border)
        order = np.argsort(-lengths, kind="stable")
        sizes, begin = lengths[order], border[:-1][order]
        most = int(sizes[0]) if len(sizes) else 0
        if not most:
            return
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(most), "right")  # sequences that have step t
        at = np.append(0, np.cumsum(active))
        turn = np.unique(np.append(np.searchsorted(at[:-1], np.arange(0, at[-1], held)), most))  # block borders, in steps
        emit, move = np.ascontiguousarray(self.emit.T, np.float32), self.move.astype(np.float32)

        def seen(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            """(symbols, emission weights) of steps lo to hi."""
            n = active[lo:hi]
            step = np.repeat(np.arange(lo, hi), n)
            x = symbols[begin[np.arange(len(step)) - np.repeat(at[lo:hi] - at[lo], n)] + step]
            return x, emit[x]

        def forward(now: np.ndarray, lo: int, hi: int, e: np.ndarray, keep: bool):
            alpha, scale = (np.empty_like(e), np.empty(len(e), np.float32)) if keep else (None, None)
            for t in range(lo, hi):
                a, b = at[t] - at[lo], at[t + 1] - at[lo]
                now = (now[: b - a] @ move if t else now) * e[a:b]
                s = now.sum(1)
                now /= s[:, None]
                if keep:
                    alpha[a:b], scale[a:b] = now, s
            return now, alpha, scale

        entry = [np.broadcast_to(self.first.astype(np.float32), (len(sizes) if active[0] == len(sizes) else int(active[0]), self.k))]
        for lo, hi in zip(turn[:-2].tolist(), turn[1:-1].tolist(), strict=True):
            entry.append(forward(entry[-1], lo, hi, seen(lo, hi)[1], False)[0])
        after = None  # what the step behind the block hands back: emission * beta / scale of its sequences
        for b_no in range(len(turn) - 2, -1, -1):
            lo, hi = int(turn[b_no]), int(turn[b_no + 1])
            x, e = seen(lo, hi)
            _, alpha, scale = forward(entry[b_no], lo, hi, e, True)
            beta, ahead = np.ones_like(e), e
            ahead /= scale[:, None]
            for t in range(hi - 1, lo - 1, -1):
                a, b = at[t] - at[lo], at[t + 1] - at[lo]
                if after is not None and len(after):
                    beta[a : a + len(after)] = after @ move.T
                ahead[a:b] *= beta[a:b]
                after = ahead[a:b]
            gamma = alpha * beta
            gamma /= gamma.sum(1, keepdims=True)
            for s in range(self.k):
                total["emit"][s] += np.bincount(x, gamma[:, s], minlength=total["emit"].shape[1])
            if lo == 0:
                total["first"] += gamma[: active[0]].sum(0)
            elif hi > lo:
                total["move"] += self.move * (entry[b_no][: active[lo]].T.astype(np.float64) @ ahead[: active[lo]])
            n = active[lo + 1 : hi]
            back = np.repeat(at[lo : hi - 1] - at[lo], n) + np.arange(n.sum()) - np.repeat(at[lo + 1 : hi] - at[lo + 1], n)
            total["move"] += self.move * (alpha[back].T @ ahead[active[lo] :]).astype(np.float64)

    def empty(self) -> dict:
        return {"emit": np.zeros(self.emit.shape), "move": np.zeros((self.k, self.k)), "first": np.zeros(self.k)}

    def update(self, total: dict) -> None:
        mass = total["emit"].sum(1, keepdims=True)
        self.emit = (total["emit"] + 0.02 * mass * self.base + 1e-3 * self.base) / (1.02 * mass + 1e-3)
        self.emit /= self.emit.sum(1, keepdims=True)
        self.move = total["move"] + 1
        self.move /= self.move.sum(1, keepdims=True)
        self.first = (total["first"] + 1) / (total["first"] + 1).sum()

    def likelihood(self, symbols: np.ndarray, border: np.ndarray) -> np.ndarray:
        """log10 probability of each whole sequence: scaled forward recursion, all sequences in step."""
        lengths = np.diff(border)
        order = np.argsort(-lengths, kind="stable")
        sizes, start = lengths[order], border[:-1][order]
        out, emit = np.zeros(len(order)), np.ascontiguousarray(self.emit.T)
        now = np.broadcast_to(self.first, (len(order), self.k))
        n = len(order)
        for t in range(int(sizes[0]) if n else 0):
            while n and sizes[n - 1] <= t:
                n -= 1
            now = now[:n] @ self.move if t else now[:n]
            now = now * emit[symbols[start[:n] + t]]
            total = now.sum(1)
            out[:n] += np.log10(total)
            now = now / total[:, None]
        back = np.empty(len(order))
        back[order] = out
        return back


def together(slices, limit: int):
    """Slices joined to about ``limit`` tokens, so that many sequences go in step: (symbols, borders)."""
    held, size = [], 0
    for _, _, symbols, border, *_ in slices:
        if held and size + len(symbols) > limit:
            yield _joined(held)
            held, size = [], 0
        held.append((symbols, border))
        size += len(symbols)
    if held:
        yield _joined(held)


def _joined(slices):
    ends = np.cumsum([0] + [len(s) for s, _ in slices])
    return np.concatenate([s for s, _ in slices]), np.concatenate([[0], *(b[1:] + end for (_, b), end in zip(slices, ends[:-1], strict=True))])


def baum_welch(docs: DataFrame, words, model: Hmm) -> Hmm:
    """One pass over docs: expected counts by task, summed across partitions by symbol."""
    shared = docs.sparkSession.sparkContext.broadcast((words.value, model))
    k = model.k

    def run(batches):
        vocabulary, model = shared.value
        total = model.empty()
        for batch in batches:
            for symbols, border in together(vocabulary.read(batch.column(0)), 8 * HELD):
                model.expect(symbols, border, total)
        rows = np.concatenate([total["emit"].T, total["move"], total["first"][None]])
        used = np.flatnonzero(rows.sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, s]) for s in range(k))], ["at", *(f"s{s}" for s in range(k))])

    schema = "at long, " + ", ".join(f"s{s} double" for s in range(k))
    sums = docs.select("text").mapInArrow(lean(run), schema).groupBy("at").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toPandas()
    size = model.emit.shape[1]
    rows = np.zeros((size + k + 1, k))
    rows[sums["at"].to_numpy(int)] = sums.drop(columns="at").to_numpy(float)
    model.update({"emit": rows[:size].T, "move": rows[size : size + k], "first": rows[-1]})
    shared.destroy()
    return model


def score(docs: DataFrame, training: DataFrame, states: int = 6, symbols: int = 8192, classes: int = 1024, size: int = 131_072, sample: int = 400, passes: int = 2) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Null and empty texts are the end token alone. Without training texts every token is unknown. Repeated rows and null
    ids are kept; other columns are ignored. docs must be read from files.
    """
    spark = docs.sparkSession
    training = training.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = cut(word_counts(training, classes))
    vocabulary = Vocabulary(counts, symbols, classes, size)
    words = spark.sparkContext.broadcast(vocabulary)
    model = Hmm(states, vocabulary.mass)
    some = labelled_sample(training, training.select("doc_id", F.lit(1).alias("any")), "any", sample).orderBy("doc_id").toPandas()
    slices = list(together(vocabulary.read(pa.array(some.text, pa.string())), HELD)) if len(some) else []
    for _ in range(25 if slices else 0):
        total = model.empty()
        for x in slices:
            model.expect(*x, total)
        model.update(total)
    del some, slices
    release()
    for _ in range(passes if vocabulary.n else 0):
        model = baum_welch(training, words, model)
    best = spark.sparkContext.broadcast(model)

    def run(batches):
        vocabulary, model = words.value, best.value
        for batch in batches:
            n = batch.num_rows
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            n_tokens, n_known = np.ones(n, np.int64), np.full(n, int(vocabulary.end_count > 0))
            base, inner = np.full(n, np.log10(vocabulary.end_count + 1.0)), np.zeros(n)
            if vocabulary.end >= vocabulary.symbols:
                inner -= vocabulary.room[vocabulary.end - vocabulary.symbols]
            sequences, borders, keys, rows, times = [], [np.zeros(1, np.int64)], [], [], []
            log_count = np.log10(vocabulary.count + 1.0)
            for lo, hi, seq, border, w, at, symbol in vocabulary.read(batch.column(0)):
                sequences.append(seq)
                borders.append(border[1:] + borders[-1][-1])
                known = at >= 0
                n_tokens[lo:hi] += w.count
                n_known[lo:hi] += np.bincount(w.text[known], minlength=hi - lo)
                value = np.where(known, log_count[at] if len(log_count) else 0, 0)
                base[lo:hi] += np.bincount(w.text, value, minlength=hi - lo)
                classed = symbol >= vocabulary.symbols
                own = np.where(classed, value - vocabulary.room[np.maximum(symbol - vocabulary.symbols, 0)], 0)
                inner[lo:hi] += np.bincount(w.text, own, minlength=hi - lo)
                rare = np.flatnonzero(~known)
                order = np.lexsort((w.hash[rare], w.text[rare]))
                key, text = w.hash[rare][order], w.text[rare][order]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else np.zeros(0, int)
                keys.append(key[new])
                rows.append(ids[lo + text[new]])
                times.append(np.diff(np.append(new, len(key))))
            total = inner + (model.likelihood(np.concatenate(sequences), np.concatenate(borders)) if sequences else 0)
            m = sum(map(len, keys))
            blank = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([mix(ids.astype(U)), *keys]).view(np.int64)), pa.array(np.concatenate([ids, *rows])), pa.array(np.concatenate([np.zeros(n, np.int64), *times])), pa.concat_arrays([batch.column(2), pa.nulls(m, pa.int64())]), blank(n_tokens, pa.int64()), blank(n_known, pa.int64()), blank(base, pa.float64()), blank(total, pa.float64())],
                ["key", "row", "times", "doc_id", "n_tokens", "n_known", "base", "total"],
            )

    source = docs.select(F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    parts = source.mapInArrow(lean(run), "key long, row long, times long, doc_id long, n_tokens long, n_known long, base double, total double")
    joined = parts.join(counts.select("key", "n"), "key", "left")
    gain = F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1))
    found = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("base") + gain).alias("base"),
        (F.sum("total") + gain).alias("score"),
    )
    room = float(np.log10(vocabulary.n + vocabulary.v + 1))
    return found.select("doc_id", "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(room)).alias("base_score"), "score")


def op3_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 7, 2)
    return score(docs, docs.where(~held)).withColumn("held_out", held)


QUERIES = {"op3_hmm_scoring": op3_hmm_scoring}
