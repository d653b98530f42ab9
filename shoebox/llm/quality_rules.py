"""Quality rules (operator 2): exact base rules, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word and character n-grams, fitted on
a bounded sample of labelled rows; one third of the sample is left out of the fit and
calibrates the probabilities (Platt scaling). Texts are scored whole, in Arrow batches,
and compared with a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, labelled_sample, table
from .hashed_features import SIZE, Adam, Features, family_slices, margins, sigmoid
from .kernels import lean, release
from .text_stats import base_counts

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def fit_logistic(x: Features, y: np.ndarray, use: np.ndarray, steps: int = 80, rate: float = 0.08, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from the texts marked in ``use``; both classes weigh the same."""
    w, opt = np.zeros(SIZE + 1), Adam(SIZE + 1, rate)
    share = np.clip(y[use].mean(), 0.01, 0.99)
    weight = np.where(use, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / use.sum(), 0)
    for _ in range(steps):
        d = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight
        opt.step(w, np.append(x.back(d) + l2 * w[:-1], d.sum()))
    return w[:-1].astype(np.float32), float(w[-1])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * z + b), by Newton steps on smoothed targets (Platt 1999)."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - goal) * z).sum(), (p - goal).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 800):
    """(weights, bias, a, b) from at most ``per_class`` rows of either label; None unless both occur. Every third text is left
    out of the fit and calibrates it, if both labels are among them."""
    rows = labelled_sample(docs, labels.where("quality in (0, 1)"), "quality", per_class).orderBy("doc_id").toPandas()
    y = rows.label.to_numpy(float)
    if len(set(y)) < 2:
        return None
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    x = Features(list(rows.text))
    w, bias = fit_logistic(x, y, ~held)
    a, b = platt((x.dot(w) + bias)[held], y[held]) if held.any() else (1.0, 0.0)
    del x, rows
    release()
    return w, bias, a, b


def apply_rules(docs: DataFrame, model, threshold: float = 0.5, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """One row for each input row: doc_id, the base counts, base_failed, kept, probability.

    Null texts have no words. Without a model, base_failed alone decides. Repeated and null
    ids are kept as they are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = {k: np.zeros(batch.num_rows, np.int64) for k in COUNTS} | {"p": np.ones(batch.num_rows)}
            for lo, hi, buf, offs, words, parts in family_slices(batch.column(1)):
                for k, v in base_counts(buf, offs, words).items():
                    out[k][lo:hi] = v
                if shared.value:
                    w, bias, a, b = shared.value
                    out["p"][lo:hi] = sigmoid(a * (margins(w, parts) + bias) + b)
            failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > repeat_percent * out["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k]) for k in COUNTS), pa.array(failed), pa.array(~failed & (out["p"] >= threshold)), pa.array(out["p"])], ["doc_id", *COUNTS, "base_failed", "kept", "probability"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 3, 1))
    return apply_rules(docs, train(docs, learn))


QUERIES = {"op2_quality_rules": op2_quality_rules}
