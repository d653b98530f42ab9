"""Language identification (operator 1): a byte convolutional network in numpy.

Input: consecutive windows of ``WIDTH`` bytes of the UTF-8 text, the last padded with
zero bytes. Filters of 2, 3 and 4 bytes slide over a window (one-hot bytes, so a filter
is a table of 256 weights for each of its places), the maximum over the window is
kept for each filter, and a softmax layer reads the maxima. A text's probabilities are
the byte-weighted mean over all its windows. Training: Adam on cross entropy, on a
bounded sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, labelled_sample, table
from .kernels import lean, release, text_buffer

WIDTH = 256
SIZES = (2, 3, 4)


def window_matrix(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of each): every byte of every text is in one window."""
    lengths = np.diff(offs)
    n = -(-lengths // WIDTH)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((first[-1], WIDTH), np.uint8)
    text = np.repeat(np.arange(len(lengths)), n)
    flat = out.reshape(-1)
    flat[np.arange(len(buf)) + np.repeat(first[:-1] * WIDTH - offs[:-1], lengths)] = buf
    size = np.minimum(WIDTH, lengths[text] - (np.arange(len(text)) - first[text]) * WIDTH)
    return out, text, size


class ByteCnn:
    def __init__(self, labels: list[str], filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.filters = labels, filters
        self.p = {k: rng.normal(0, 0.3 / np.sqrt(k), (k, 256, filters)).astype(np.float32) for k in SIZES}
        self.p |= {"w": rng.normal(0, 0.3, (filters * len(SIZES), len(labels))).astype(np.float32), "b": np.zeros(len(labels), np.float32)}

    def pooled(self, x: np.ndarray, k: int, where: bool = False):
        """Maxima over the window of the filters of size k, and where they are."""
        n = WIDTH - k + 1
        act = self.p[k][0][x[:, :n]]
        for j in range(1, k):
            act += self.p[k][j][x[:, j : j + n]]
        if not where:
            return act.max(1)
        at = act.argmax(1)
        return np.take_along_axis(act, at[:, None], 1)[:, 0], at

    def gradients(self, x: np.ndarray, goal: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy of windows x with labels goal, and its gradient by parameter."""
        tops = {k: self.pooled(x, k, True) for k in SIZES}
        hidden = np.concatenate([tops[k][0] for k in SIZES], 1)
        z = hidden @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        rows = np.arange(len(x))
        loss = float(-np.log(z[rows, goal] + 1e-30).mean())
        z[rows, goal] -= 1
        z /= len(x)
        back = z @ self.p["w"].T
        grads = {"w": hidden.T @ z, "b": z.sum(0)}
        for i, k in enumerate(SIZES):
            g, part = np.zeros_like(self.p[k]), back[:, i * self.filters : (i + 1) * self.filters]
            at = tops[k][1]
            cols = np.broadcast_to(np.arange(self.filters), at.shape)
            for j in range(k):
                np.add.at(g[j], (np.take_along_axis(x, at + j, 1), cols), part)
            grads[k] = g
        return loss, grads

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int = 160, batch: int = 64, rate: float = 0.02, seed: int = 11) -> ByteCnn:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            for k, g in self.gradients(windows[pick], y[pick])[1].items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
        return self

    def compiled(self) -> ByteCnn:
        """Adds tables over byte pairs: half as many lookups at scoring."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, self.filters)
        self.pairs = {k: pair(self.p[k][0], self.p[k][1]) for k in SIZES} | {"tail": pair(self.p[4][2], self.p[4][3])}
        return self

    def probabilities(self, windows: np.ndarray, block: int = 32) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for lo in range(0, len(windows), block):
            x = windows[lo : lo + block]
            two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            hidden = []
            for k in SIZES:
                act = self.pairs[k].take(two[:, : WIDTH - k + 1], axis=0)
                if k == 3:
                    act += self.p[3][2].take(x[:, 2:], axis=0)
                elif k == 4:
                    act += self.pairs["tail"].take(two[:, 2:], axis=0)
                hidden.append(act.max(1))
            z = np.concatenate(hidden, 1) @ self.p["w"] + self.p["b"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + block] = z / z.sum(1, keepdims=True)
        return out


def train(docs: DataFrame, per_language: int = 400, most: int = 20_000, windows: int = 1200) -> ByteCnn | None:
    """Fits on at most ``per_language`` texts of each language and about ``most`` texts in all (see ``labelled_sample``: no language
    is left out), from which ``windows`` windows a language are drawn among all windows of its texts; None without any text."""
    rows = labelled_sample(docs, docs, "lang", per_language, most).orderBy("doc_id").toPandas()
    if rows.empty:
        return None
    labels = sorted(rows.label.unique())
    buf, offs = text_buffer(pa.array(rows.text, pa.string()))
    every, text, _ = window_matrix(buf, offs)
    y = np.searchsorted(labels, rows.label.to_numpy())[text]
    # the same number of windows a language, and within it a text's chance does not grow with its length
    share = 1 / np.bincount(text, minlength=len(rows))[text] if len(text) else np.zeros(0)
    rng, pick = np.random.default_rng(3), []
    for c in range(len(labels)):
        own = np.flatnonzero(y == c)
        if len(own):
            pick.append(rng.choice(own, windows, p=share[own] / share[own].sum()))
    model = None
    if pick:
        pick = np.concatenate(pick)
        model = ByteCnn(labels).fit(every[pick], y[pick])
    del rows, buf, every
    release()
    return model


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``und`` with score 1 if it is null or has no letter
    (or nothing could be learnt). One row for each input row, repeated and null ids too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value and shared.value.compiled()
        for batch in batches:
            out, best = np.ones(batch.num_rows), np.zeros(batch.num_rows, int)
            names = np.array(["und", *(model.labels if model else [])], object)
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if model:
                buf, offs = text_buffer(batch.column(1))
                lo = 0
                while lo < batch.num_rows:  # windows of about 1 MB at a time
                    hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 20), "right")) - 1)
                    windows, text, size = window_matrix(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    p, total = model.probabilities(windows) * size[:, None], np.zeros((hi - lo, len(model.labels)))
                    np.add.at(total, text, p)
                    total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
                    best[lo:hi], out[lo:hi] = total.argmax(1) + 1, total.max(1)
                    lo = hi
            best, out = np.where(letters, best, 0), np.where(letters & (best > 0), np.clip(out, 0, 1), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(out, pa.float64())], ["doc_id", "lang_pred", "score"])

    some = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return some.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~in_fold(F.col("doc_id"), 3, 1)))
    return identify(docs, model).withColumn("held_out", in_fold(F.col("doc_id"), 3, 1)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
