"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text (lengths, character shares, repetition, vocabulary) are transformed (logarithms, square
roots of shares), standardised, and modelled per class by a Gaussian whose covariance is shrunk towards a multiple of
the identity.  The Cholesky factor of each class is inverted once and kept with its log-determinant; a score is the
difference of the two log-densities (a Mahalanobis term is the squared length of the whitened vector, one product with
the kept inverse factor), mapped to 0..1 by a logistic calibration.

The model is fitted on at most ``PER_CLASS`` labelled documents of each class (texts of ``learning.LONGEST`` bytes at most),
never held-out ones; the shrinkage weight is chosen by cross-validation there.

Edge cases: null and empty texts have all statistics zero and get a score like any text; without labels of both
classes each score is the share of positive labels (0.5 if none); repeated rows are scored alike; whole texts are
read a few MB at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .learning import class_counts, decided, labelled_sample
from .util import held_out

PER_CLASS = 10_000
THRESHOLD = 0.3
SHRINKAGE = (0.02, 0.05, 0.1, 0.2, 0.4)
FOLDS = 4
NAMES = (
    "log_words", "log_bytes", "mean_word", "sd_word", "long_words", "short_words", "unique_words", "top_word", "repeat_next", "unique_pairs",
    "upper", "digit", "punctuation", "bar", "shout", "non_ascii", "lone_symbols", "capitalised", "log_lines", "unique_lines", "line_length",
)


def _shares(keys: np.ndarray, doc: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the count of the most frequent one, each as a share of the document's total."""
    mixed = keys ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    mixed, doc = mixed[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])])) if len(mixed) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(mixed)]]))
    top = np.zeros(n)
    np.maximum.at(top, doc[first], size)
    return np.bincount(doc[first], minlength=n) / total, top / total


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; columns as in NAMES."""
    n = len(offsets) - 1
    words = tb.split(data, offsets, tb.space_class())
    text = np.repeat(np.arange(n), np.diff(offsets))
    n_words, n_bytes = words.count(), np.diff(offsets)
    per_word, per_byte = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    count = lambda mask, of: np.bincount(of[mask], minlength=n)
    table = np.zeros(256, np.uint8)
    for kind, ranges in enumerate(([(0x41, 0x5B)], [(0x30, 0x3A)], [(0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)], [(0x80, 0x100)]), 1):
        for a, b in ranges:
            table[a:b] = kind
    kinds = np.bincount(text * 5 + table[data], minlength=5 * n).reshape(n, 5)
    length = (words.end - words.start).astype(np.float64)
    mean = np.bincount(words.doc, length, n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(words.doc, length * length, n) / per_word - mean * mean, 0))
    unique, top = _shares(words.hash, words.doc, n, per_word)
    same = np.zeros(len(words.doc), bool)
    pair = words.hash.copy()
    if len(pair) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        pair[:-1] = words.hash[:-1] * np.uint64(3) + words.hash[1:]
    pairs, _ = _shares(pair, words.doc, n, per_word)
    line_class = np.ones(256, bool)
    line_class[0x0A] = False
    lines = tb.split(data, offsets, line_class)
    n_lines = np.maximum(lines.count(), 1)
    unique_lines, _ = _shares(lines.hash, lines.doc, n, n_lines)
    first = data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    lone = (length == 1) & (table[first] == 3)
    share = lambda x, of: np.sqrt(x / of)
    return np.stack([
        np.log1p(n_words), np.log1p(n_bytes), np.log1p(mean), np.log1p(spread), share(count(length > 12, words.doc), per_word), share(count(length <= 3, words.doc), per_word), unique, np.sqrt(top),
        share(count(same, words.doc), per_word), pairs, share(kinds[:, 1], per_byte), share(kinds[:, 2], per_byte), share(kinds[:, 3], per_byte), share(count(data == 0x7C, text), per_byte), share(count(data == 0x21, text), per_byte),
        share(kinds[:, 4], per_byte), share(count(lone, words.doc), per_word), share(count(table[first] == 1, words.doc), per_word), np.log1p(lines.count()), unique_lines, np.log1p(n_words / n_lines),
    ], 1).astype(np.float64)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None  # of class 0 and 1
    factors: tuple[np.ndarray, np.ndarray] | None  # inverse Cholesky factors
    logdets: tuple[float, float] | None
    slope: float
    offset: float
    constant: float | None = None
    shrinkage: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 minus that of class 0."""
        z = (x - self.centre) / self.scale
        value = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            white = (z - mean) @ inverse.T
            value.append(-0.5 * (white * white).sum(1) - logdet)
        return value[1] - value[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.margin(x)) + self.offset, -30, 30)))


def squash(margin: np.ndarray) -> np.ndarray:
    """Large margins are sums of many dependent terms; their growth is damped before calibration."""
    return np.sign(margin) * np.log1p(np.abs(margin))


def _gaussians(x: np.ndarray, y: np.ndarray, shrinkage: float) -> Model:
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    means, factors, logdets = [], [], []
    for c in (0, 1):
        own = z[y == c]
        mean = own.mean(0)
        cov = (own - mean).T @ (own - mean) / max(1, len(own) - 1)
        d = len(mean)
        weight = min(1.0, shrinkage + d / max(d, len(own)) * 0.2)
        cov = (1 - weight) * cov + weight * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(factor))
        logdets.append(float(np.log(np.diag(factor)).sum()))
    return Model(centre, scale, tuple(means), tuple(factors), tuple(logdets), 1.0, 0.0, shrinkage=shrinkage)


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    a = np.stack([m, np.ones_like(m)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """Choose the shrinkage by cross-validated log-loss, then fit on all rows; ``prior`` is the true share of ones."""
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    fold = np.zeros(len(y), int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    enough = min((y == 0).sum(), (y == 1).sum()) >= 2 * FOLDS
    best = None
    for shrinkage in SHRINKAGE if enough else SHRINKAGE[-1:]:
        m = np.zeros(len(y))
        for f in range(FOLDS if enough else 1):
            inside = fold != f if enough else np.ones(len(y), bool)
            outside = ~inside if enough else inside
            m[outside] = squash(_gaussians(x[inside], y[inside], shrinkage).margin(x[outside]))
        slope, offset = _logistic(m, y, weight)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
        if best is None or loss < best[0]:
            best = (loss, shrinkage, slope, offset)
    model = _gaussians(x, y, best[1])
    model.slope, model.offset = best[2], best[3]
    return model


def _frame_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the array column _stats; nothing is shuffled."""
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            data, offsets = tb.buffers(batch.column("text"))
            parts = [np.zeros((0, len(NAMES)))]
            for i, j in tb.groups(offsets):
                parts.append(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            flat = pa.array(np.concatenate(parts).ravel(), pa.float64())
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(at, flat)], [*keep, "_stats"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_stats", T.ArrayType(T.DoubleType()))])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    n0, n1 = class_counts(labels, label)
    zero = np.zeros(len(NAMES))
    rows = []
    if n0 and n1:
        sample = _frame_statistics(labelled_sample(docs, labels, label, per_class), ["doc_id", "y"])
        rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["_stats"]))
    y = np.array([r["y"] for r in rows])
    if not rows or min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(zero, zero + 1, None, None, None, 0.0, 0.0, constant=n1 / (n0 + n1) if n0 + n1 else 0.5)
    return fit(np.array([r["_stats"] for r in rows]), y, n1 / (n0 + n1))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = Model(**shared.value)
        for batch in batches:
            data, offsets = tb.buffers(batch.column("text"))
            parts = [np.zeros(0)]
            for i, j in tb.groups(offsets):
                parts.append(m.scores(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts), pa.float64())], ["doc_id", "score"])

    from pyspark.sql import types as T

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", decided(F.col("score"), THRESHOLD).alias("predicted"))
