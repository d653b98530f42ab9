"""Quality classifier (operator 4): positive-unlabelled learning.

Trusted positives are labelled rows of label 1; the unlabelled rows are a bounded sample of
all web text. With the class prior pi, the risk

    pi * R(positives, +1) + max(0, R(unlabelled, -1) - pi * R(positives, -1))

(non-negative unbiased risk, Kiryo et al. 2017; logistic loss) is minimised over hashed n-grams and a few
style shares. Where the second term turns negative, the step goes up that term instead.
Rows of label 0 are never read. The prior is estimated from the two samples (best bin estimation, Garg et al. 2021): a probe learns to
tell positives from unlabelled rows on one half; on the other half, among the score thresholds, the smallest ratio of
unlabelled to positive shares above it, with its confidence margin, bounds the share of positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, in_fold, labelled_sample, table, together
from .hashed_features import SIZE, Adam, Features, family_slices, margins, sigmoid
from .kernels import lean, release, sums
from .text_stats import base_counts

N_STYLE = 8


def style(buf, offs, words) -> np.ndarray:
    """Per text: shares that tell prose from shouting, tables, symbol noise, lists and repetition."""
    c = base_counts(buf, offs, words)
    n, size = np.maximum(c["n_words"], 1), np.maximum(np.diff(offs), 1)
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    sign = (buf < 128) & (buf > 32) & ~digit & ~upper & ~((buf >= 97) & (buf <= 122))
    columns = [sums(same, words.first) / n, c["n_repeat_words"] / n, sums(upper, offs) / size * 5, sums(digit, offs) / size * 5, sums(sign, offs) / size * 5, c["n_symbols"] / size * 10, c["word_chars"] / n / 10, np.log1p(n) / 10]
    return np.stack(columns, 1)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled rows, from the scores of held-out rows of both samples."""
    cuts = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / max(1, len(x))
    q_p, q_u = above(positive), above(unlabelled)
    margin = np.sqrt(np.log(4 / delta) / 2 / max(1, len(positive))) + np.sqrt(np.log(4 / delta) / 2 / max(1, len(unlabelled)))
    bound = (q_u + (1 + gamma) * margin) / q_p
    at = int(bound.argmin())
    return float(np.clip(q_u[at] / q_p[at], 0.02, 0.98))


class PuModel:
    def __init__(self, prior: float | None = None):
        self.prior, self.w, self.s, self.bias = prior, None, None, 0.0

    def inputs(self, texts: list[str]) -> tuple[Features, np.ndarray]:
        extra = np.concatenate([style(buf, offs, words) for _, _, buf, offs, words, _ in family_slices(pa.array(texts, pa.string()))])
        self.mean, self.scale = extra.mean(0), extra.std(0) + 1e-3
        return Features(texts), np.clip((extra - self.mean) / self.scale, -8, 8)

    def fit(self, positive: list[str], unlabelled: list[str], steps: int = 100, rate: float = 0.1, l2: float = 1e-4) -> PuModel:
        pos = np.arange(len(positive) + len(unlabelled)) < len(positive)
        x, extra = self.inputs([*positive, *unlabelled])
        if self.prior is None:
            self.prior = estimate_prior(x, extra, pos)
        w, opt = np.zeros(SIZE + N_STYLE + 1), Adam(SIZE + N_STYLE + 1, rate)
        w[-1] = np.log(self.prior / (1 - self.prior))
        for _ in range(steps):
            _, d = pu_risk(x.dot(w[:SIZE]) + extra @ w[SIZE:-1] + w[-1], pos, self.prior)
            opt.step(w, np.concatenate([x.back(d) + l2 * w[:SIZE], extra.T @ d + l2 * w[SIZE:-1], [d.sum()]]))
        self.w, self.s, self.bias = w[:SIZE].astype(np.float32), w[SIZE:-1], float(w[-1])
        return self

    def scores(self, column, n: int) -> np.ndarray:
        out = np.zeros(n)
        for lo, hi, buf, offs, words, parts in family_slices(column):
            extra = np.clip((style(buf, offs, words) - self.mean) / self.scale, -8, 8)
            out[lo:hi] = sigmoid(margins(self.w, parts) + extra @ self.s + self.bias)
        return out


def pu_risk(z: np.ndarray, pos: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The risk at margins z, and the direction of the step by margin: its gradient, or that of the negated second term while that is below 0."""
    n_p, n_u, p = pos.sum(), (~pos).sum(), sigmoid(z)
    plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)  # losses against +1 and -1
    negative = minus[~pos].sum() / n_u - prior * minus[pos].sum() / n_p
    risk = prior * plus[pos].sum() / n_p + max(0.0, negative)
    if negative >= 0:
        return risk, np.where(pos, prior * (p - 1) / n_p - prior * p / n_p, p / n_u)
    return risk, np.where(pos, prior * p / n_p, -p / n_u)


def estimate_prior(x: Features, extra: np.ndarray, pos: np.ndarray, steps: int = 20, rate: float = 0.1) -> float:
    """Mean of two best-bin estimates, each half of the rows being the other's probe."""
    half, found = np.arange(len(pos)) % 2 == 0, []
    for use in (half, ~half):
        weight = np.where(use, np.where(pos, 0.5 / max(1, (pos & use).sum()), 0.5 / max(1, (~pos & use).sum())), 0)
        w, opt = np.zeros(SIZE + N_STYLE + 1), Adam(SIZE + N_STYLE + 1, rate)
        margin = lambda: x.dot(w[:SIZE]) + extra @ w[SIZE:-1] + w[-1]  # noqa: B023, E731
        for _ in range(steps):
            d = (sigmoid(margin()) - pos) * weight
            opt.step(w, np.concatenate([x.back(d) + 1e-4 * w[:SIZE], extra.T @ d + 1e-4 * w[SIZE:-1], [d.sum()]]))
        z = margin()
        if (pos & ~use).any() and (~pos & ~use).any():
            found.append(best_bin(z[pos & ~use], z[~pos & ~use]))
    return float(np.mean(found)) if found else 0.5


def train(docs: DataFrame, labels: DataFrame, positives: int = 700, unlabelled: int = 1400, prior: float | None = None) -> PuModel | None:
    """From at most ``positives`` rows of label 1 and ``unlabelled`` rows of docs, both picked by a hash of doc_id; None without
    either. Null texts and null ids are not learnt from; a repeated id counts once a row of docs. The prior is estimated unless given."""
    trusted = labelled_sample(docs, labels.where("quality = 1"), "quality", positives).orderBy("doc_id").toPandas()
    web = labelled_sample(docs, docs.select("doc_id", F.lit(0).alias("any")), "any", unlabelled).orderBy("doc_id").toPandas()
    if trusted.empty or web.empty:
        return None
    model = PuModel(prior).fit(list(trusted.text), list(web.text))
    del trusted, web
    release()
    return model


def _scored(docs: DataFrame, model: PuModel | None, texts: bool) -> DataFrame:
    """(rest, score), with the text too if ``texts``; see ``apart``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            out = shared.value.scores(batch.column(0), n) if shared.value else np.full(n, 0.5)
            kept = batch.columns if texts else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.float64())], [*batch.schema.names[0 if texts else 1 :], "score"])

    parts = docs.select(*apart(docs))
    return parts.mapInArrow(lean(run), (parts if texts else parts.drop("text")).withColumn("score", F.lit(0.0)).schema)


def score(docs: DataFrame, model: PuModel | None, name: str = "pu_score") -> DataFrame:
    """docs with the column ``name``: the probability (0 to 1) of label 1 for every whole text. Null and empty texts are scored as
    empty ones; without a model all have 0.5. Rows stay one to one, repeated rows and null ids too. ``name`` must be new."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs already has a column {name}")
    return together(_scored(docs, model, True), docs, F.col("score").alias(name))


def select(docs: DataFrame, model: PuModel | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score ``threshold`` or more, with their columns as they are, whatever their names."""
    return together(_scored(docs, model, True).where(F.col("score") >= threshold), docs)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 3, 1)
    model = train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    found = _scored(docs, model, False).select(F.col("rest.c0").alias("doc_id"), "score")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
