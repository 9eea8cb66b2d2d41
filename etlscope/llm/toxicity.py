"""Toxicity scores from a small convolutional text classifier, trained in numpy.

Words (lower-cased runs of letters and digits) and their first 4, 5 and 6 bytes hash to rows of an embedding table,
whose sum is the word's vector, so inflected forms share what their stem teaches.  Filters of widths 1, 2 and 3 slide
over the whole text, each filter's largest response is kept, and a logistic layer joins them.  Scoring uses
lookup tables (embedding times filter tap), so a filter of width w costs 4w table look-ups a word.

Training: every labelled document, whole, of any length, in shards of about ``SHARD_ROWS`` documents (``MOST_SHARDS`` at
most, which then grow).  Each of the ``EPOCHS`` rounds trains every shard from the same state, by a task, and adds the mean of
what the shards changed; one shard is plain AdaGrad.  Classes
weigh alike, and half of the log-odds of their true shares is put back in the bias, a compromise between both kinds of error.
Rows kept out by ``held_out`` are never seen.  One fifth of the training documents is set aside to choose a decision
threshold for each language, from counts over all of them; those thresholds judge documents (``toxic``), but neither
language nor any other column than text enters a score.

Edge cases: null and empty texts get the score of a text without words; without labels of both classes every score
is the share of positive labels (0 if none); null or unseen languages use the threshold 0.5; long texts are scored
whole, a few MB of text at a time; repeated rows are scored alike.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .learning import class_counts, classes_of, decided, id_names, labels_by_name
from .util import find, fresh, held_out

SHARD_ROWS, MOST_SHARDS = 8000, 32
BUCKET_BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
PREFIXES = (4, 5, 6)  # bytes
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.05, 1e-4
PAD = max(WIDTHS) - 1
LEAST_ROWS, LEAST_POSITIVE = 60, 10  # for a threshold of a language's own
SLICE, LARGE, POOL = 1 << 17, 1 << 20, 1024  # words at a time, words that end a batch, documents shuffled among each other


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (from 1; 0: none) of each word and of its prefixes, and the bounds of texts in words."""
    data = tb.lower(data)
    words = tb.split(data, offsets, tb.alnum_class())
    shift, size = np.uint64(64 - BUCKET_BITS), words.end - words.start
    out = np.zeros((len(size), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = (words.hash >> shift).astype(np.int32) + 1
    code = np.zeros(len(size), np.uint64)
    for k in range(max(PREFIXES)):
        has = size > k
        code[has] = (code[has] + data[words.start[has] + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if k + 1 in PREFIXES:
            long = size > k + 1
            out[long, 1 + PREFIXES.index(k + 1)] = (((code[long] ^ (code[long] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int32) + 1
    return out, words.bounds


def padded(buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with PAD zeros behind each; a text without words gets one zero more."""
    counts = np.maximum(np.diff(bounds), 1)
    start = np.concatenate([[0], np.cumsum(counts + PAD)])
    out = np.zeros((start[-1], 1 + len(PREFIXES)), np.int32)
    text = np.repeat(np.arange(len(counts)), np.diff(bounds))
    out[start[text] + np.arange(len(buckets)) - bounds[text]] = buckets
    return out, start


@dataclass
class Model:
    embedding: np.ndarray  # row 0: padding and unknown words
    filters: dict[int, np.ndarray]  # width -> taps x DIM x FILTERS
    bias: dict[int, np.ndarray]
    out: np.ndarray
    offset: float
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [np.ascontiguousarray(self.embedding @ f[k]) for k in range(w)] for w, f in self.filters.items()}

    def scores(self, buckets: np.ndarray, bounds: np.ndarray, tables=None) -> np.ndarray:
        n = len(bounds) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant or 0.0)
        tables = tables or self.tables()
        ids, start = padded(buckets, bounds)
        pooled = []
        for w in WIDTHS:
            z = sum(tables[w][0][ids[:, c]] for c in range(ids.shape[1]))
            for k in range(1, w):
                for c in range(ids.shape[1]):
                    z[:-k] += tables[w][k][ids[k:, c]]
            z[np.concatenate([start[1:] - 1 - k for k in range(PAD)])] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(z, start[:-1], axis=0) + self.bias[w], 0))
        x = np.concatenate(pooled, 1) @ self.out + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -30, 30).astype(np.float64)))


GRID = np.linspace(0.2, 0.8, 61)
STATE = ("o", "c", *(f"{x}{w}" for x in "fb" for w in WIDTHS))


def start_state(known: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters and their sums of squares (named with a leading s) before the first round."""
    rng = np.random.default_rng(seed)
    known[0] = False
    state = {"known": known, "e": (rng.normal(0, 0.1, (len(known), DIM)) * known[:, None]).astype(np.float32), "se": np.full(len(known), 1e-3, np.float32)}
    state |= {f"f{w}": rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) / w for w in WIDTHS}
    state |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
    state |= {"o": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32)}
    return state | {f"s{k}": np.full_like(state[k], 1e-3) for k in STATE}


def _responses(state: dict, ids: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each filter's largest response in each text and where it is, by width; ``SLICE`` words at a time."""
    n, total = len(start) - 1, len(ids)
    value = [np.full((n, FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    where = [np.zeros((n, FILTERS), np.int64) for _ in WIDTHS]
    for a in range(0, total - PAD, SLICE):
        size = min(SLICE, total - PAD - a)
        x = state["e"][ids[a : a + size + PAD]].sum(1)
        texts = range(int(np.searchsorted(start, a, "right")) - 1, int(np.searchsorted(start, a + size, "left")))
        for j, w in enumerate(WIDTHS):
            z = sum(x[k : k + size] @ state[f"f{w}"][k] for k in range(w))
            for i in texts:
                low, high = max(start[i], a) - a, min(start[i + 1] - PAD, a + size) - a
                if low < high:
                    at = z[low:high].argmax(0)
                    top = z[low + at, np.arange(FILTERS)]
                    better = top > value[j][i]
                    value[j][i][better], where[j][i][better] = top[better], a + low + at[better]
    return value, where


def step(state: dict, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    """One AdaGrad step on a batch of texts' word buckets; changes ``state``."""
    ids, start = padded(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    ids[~state["known"][ids]] = 0
    value, where = _responses(state, ids, start)
    raw = np.concatenate([v + state[f"b{w}"] for v, w in zip(value, WIDTHS, strict=True)], 1)
    act = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ state["o"] + state["c"][0], -30, 30)))
    g = ((p - y) * weight / len(y)).astype(np.float32)
    grads = {"o": act.T @ g + DECAY * state["o"], "c": np.array([g.sum()], np.float32)}
    back = g[:, None] * state["o"][None] * (raw > 0)
    rows, shares = [], []
    for n, w in enumerate(WIDTHS):
        b, f = back[:, n * FILTERS : (n + 1) * FILTERS], state[f"f{w}"]
        grads[f"b{w}"], fg = b.sum(0), np.empty_like(f)
        for k in range(w):
            words = ids[where[n] + k]
            fg[k] = np.einsum("df,dfe->ef", b, state["e"][words].sum(2))
            live = b != 0
            rows.append(words[live].ravel())
            shares.append(np.repeat((b[:, :, None] * f[k].T[None])[live], words.shape[2], 0))
        grads[f"f{w}"] = fg + DECAY * f
    for k, v in grads.items():
        state[f"s{k}"] += v * v
        state[k] -= RATE * v / np.sqrt(state[f"s{k}"])
    rows, of = np.unique(np.concatenate(rows), return_inverse=True)
    shares = np.concatenate(shares)
    total = np.stack([np.bincount(of, shares[:, d], len(rows)) for d in range(DIM)], 1).astype(np.float32)
    total[rows == 0] = 0
    state["se"][rows] += (total * total).mean(1)
    state["e"][rows] -= RATE * total / np.sqrt(state["se"][rows])[:, None]


def _unpacked(raw) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.int32).reshape(-1, 1 + len(PREFIXES))


def _pools(documents):
    """Lists of ``POOL`` documents, or fewer if large."""
    group, size = [], 0
    for y, raw in documents:
        group.append((y, raw))
        size += len(raw)
        if len(group) == POOL or size > POOL << 16:
            yield group
            group, size = [], 0
    if group:
        yield group


def learn(state: dict, documents, weight: tuple[float, float], seed: tuple[int, ...]) -> dict:
    """One round over a shard: ``documents`` yields (y, packed words); what it changed, for ``merge``."""
    before = {k: v.copy() for k, v in state.items()}
    for turn, group in enumerate(_pools(documents)):
        order = np.random.default_rng((*seed, turn)).permutation(len(group))
        texts, y, size = [], [], 0
        for i in order:
            texts.append(_unpacked(group[i][1]))
            y.append(group[i][0])
            size += len(texts[-1])
            if len(y) == BATCH or size > LARGE or i == order[-1]:
                step(state, texts, np.array(y), np.where(np.array(y) == 1, weight[1], weight[0]))
                texts, y, size = [], [], 0
    rows = np.flatnonzero(state["se"] != before["se"])
    out = {k: state[k] - before[k] for k in (*STATE, *(f"s{k}" for k in STATE))}
    return out | {"rows": rows, "e": state["e"][rows] - before["e"][rows], "se": state["se"][rows] - before["se"][rows]}


def merge(state: dict, changes: list[dict]) -> None:
    """Adds the mean of the shards' changes; a word's vector moves by the mean over the shards that changed it."""
    count = np.zeros(len(state["se"]), np.float32)
    for c in changes:
        count[c["rows"]] += 1
    for c in changes:
        share = 1 / count[c["rows"]]
        state["e"][c["rows"]] += c["e"] * share[:, None]
        state["se"][c["rows"]] += c["se"] * share
        for k in (*STATE, *(f"s{k}" for k in STATE)):
            state[k] += c[k] / np.float32(len(changes))


def calibrate(n: np.ndarray, positive: np.ndarray) -> float:
    """The threshold of ``GRID`` with the best F1, nearest to 0.5 among equals.

    ``n`` and ``positive`` count the documents whose score reaches i thresholds of the grid, i from 0 to all.
    """
    best = (-1.0, 0.0, 0.5)
    for i, t in enumerate(GRID):
        f1 = 2 * positive[i + 1 :].sum() / max(1, n[i + 1 :].sum() + positive.sum())
        best = max(best, (round(float(f1), 6), -abs(t - 0.5), float(t)))
    return round(best[2], 2)


def shards(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """(shard, aside, lang, y, words) of every labelled document that is not held out, whole; a shard is in one partition, in an order of its own."""

    shared = docs.sparkSession.sparkContext.broadcast(labels_by_name(labels, label))

    def run(batches):
        for batch in batches:
            y = classes_of(shared.value, batch.column("_a").to_numpy(), batch.column("_b").to_numpy())
            batch, y = batch.filter(pa.array(y >= 0)), y[y >= 0]
            data, offsets = tb.buffers(batch.column("text"))
            for i, j in tb.groups(offsets):
                buckets, bounds = word_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw = [zstandard.compress(buckets[a:b].tobytes(), 1) for a, b in zip(bounds, bounds[1:], strict=False)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(y[i:j], pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "lang", "y", "words"])

    lang = F.col("lang").cast("string") if "lang" in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    own = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"), lang.alias("lang"), *id_names(F.col("doc_id")))
    rows = own.mapInArrow(run, "doc_id string, lang string, y int, words binary")
    aside = F.crc32(F.col("doc_id").cast("binary")) % 5 == 2
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "words"), F.lit(n)).cast("int").alias("shard"), aside.alias("aside"), "lang", "y", "words", F.xxhash64("words", "doc_id").alias("o"), "doc_id")
    return rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "o", "doc_id", "words").drop("o", "doc_id")


def _by_shard(batches, of):
    """``of(shard, documents)`` of each shard in a task; ``documents`` yields (aside, lang, y, packed words)."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in batch.columns)

    for shard, documents in groupby(rows(), lambda r: r[0]):
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pickle.dumps(of(shard, (r[1:] for r in documents)))], pa.binary())], ["shard", "out"])


def _of_shards(parts: DataFrame, of) -> list:
    """The results of all shards, in their order."""
    found = parts.mapInArrow(lambda batches: _by_shard(batches, of), "shard int, out binary").collect()
    return [pickle.loads(r["out"]) for r in sorted(found, key=lambda r: r["shard"])]


def _census(shard: int, documents) -> tuple[np.ndarray, np.ndarray]:
    """Documents by [aside, y], and by [aside, bucket] those that hold the bucket (2: two or more)."""
    count, seen = np.zeros((2, 2), np.int64), np.zeros((2, (1 << BUCKET_BITS) + 1), np.uint8)
    for aside, _, y, raw in documents:
        count[int(aside), y] += 1
        words = np.unique(_unpacked(raw))
        seen[int(aside), words] = np.minimum(seen[int(aside), words] + 1, 2)
    return count, seen


def _thresholds(parts: DataFrame, model: Model) -> dict[str, float]:
    """The threshold of each language with enough documents aside."""
    shared = parts.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = Model(**shared.value)
        tables = m.tables()
        for batch in batches:
            reached = []
            for raw in batch.column("words"):
                words = _unpacked(raw.as_py())
                reached.append(int(np.searchsorted(GRID, m.scores(words, np.array([0, len(words)]), tables)[0], "right")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(reached, pa.int32())], ["lang", "y", "reached"])

    rows = parts.where(F.col("aside") & F.col("lang").isNotNull()).select("lang", "y", "words").mapInArrow(run, "lang string, y int, reached int")
    counts = rows.groupBy("lang", "reached").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"), F.collect_list(F.struct("reached", "n", "positive")).alias("counts"))
    out = {}
    for r in langs.where((F.col("n") >= LEAST_ROWS) & (F.col("positive") >= LEAST_POSITIVE)).collect():
        n, positive = np.zeros(len(GRID) + 1, np.int64), np.zeros(len(GRID) + 1, np.int64)
        for c in r["counts"]:
            n[c["reached"]], positive[c["reached"]] = c["n"], c["positive"]
        out[r["lang"]] = calibrate(n, positive)
    return dict(sorted(out.items()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", shard_rows: int = SHARD_ROWS) -> Model:
    n0, n1 = class_counts(labels, label)
    empty = np.zeros((1, DIM), np.float32)
    none = Model(empty, {}, {}, empty[0], 0.0, constant=n1 / max(1, n0 + n1))
    if not n0 or not n1:
        return none
    sc = docs.sparkSession.sparkContext
    parts = shards(docs, labels, label, min(MOST_SHARDS, -(-(n0 + n1) // shard_rows))).persist(StorageLevel.DISK_ONLY)
    try:
        census = _of_shards(parts, _census)
        count = sum((c for c, _ in census), np.zeros((2, 2), np.int64))
        if not count.sum(0).all():
            return none
        seen = sum((s.astype(np.int64) for _, s in census), np.zeros((2, (1 << BUCKET_BITS) + 1), np.int64))
        thresholds = bool((count[0] >= 2).all())  # else nothing is set aside
        count, seen = (count[0], seen[0]) if thresholds else (count.sum(0), seen.sum(0))
        state = start_state(seen >= 2)  # a word of a single document teaches nothing that another document could use
        weight = tuple(float(0.5 * count.sum() / c) for c in count)
        for epoch in range(EPOCHS):
            shared = sc.broadcast(state)

            def round_(shard, documents, shared=shared, epoch=epoch):
                own = {k: v.copy() for k, v in shared.value.items()}
                return learn(own, ((y, raw) for aside, _, y, raw in documents if not (aside and thresholds)), weight, (epoch, shard))

            merge(state, _of_shards(parts, round_))
            shared.unpersist()
        odds = np.log(max(n1, 1e-6) / max(n0, 1e-6))
        model = Model(state["e"], {w: state[f"f{w}"] for w in WIDTHS}, {w: state[f"b{w}"] for w in WIDTHS}, state["o"], float(state["c"][0] + odds * 0.5))
        if thresholds:
            model.thresholds = _thresholds(parts, model)
        return model
    finally:
        parts.unpersist()


def scored(docs: DataFrame, model: Model, score: str, threshold: str) -> DataFrame:
    """``docs`` with two added columns of the given names: score and threshold of the language; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    place = docs.columns.index(find(docs, "text"))

    def run(batches):
        m = Model(**shared.value)
        tables = None if m.constant is not None else m.tables()
        for batch in batches:
            data, offsets = tb.buffers(batch.column(place))
            parts = [np.zeros(0)]
            for i, j in tb.groups(offsets):
                parts.append(m.scores(*word_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), tables))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts), pa.float64())], [*batch.schema.names, score])

    from pyspark.sql import types as T

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
    least = F.lit(0.5)
    if model.thresholds and "lang" in [c.lower() for c in docs.columns]:
        for lang, t in sorted(model.thresholds.items()):
            least = F.when(F.col("lang").cast("string") == lang, t).otherwise(least)
    return out.withColumn(threshold, least)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    lang = F.col("lang") if "lang" in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    out = scored(docs.select("doc_id", "text", lang.alias("lang")), model, "score", "language_threshold")
    score = F.col("score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", decided(score, 0.5).alias("predicted"), "language_threshold", (score >= F.col("language_threshold")).alias("rejected"))


def reject_toxic(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, below the threshold of their language."""
    model = train(train_on if train_on is not None else docs, labels)
    score, threshold = fresh(docs, "score"), fresh(docs, "threshold")
    return scored(docs, model, score, threshold).where(F.col(score) < F.col(threshold)).select(*docs.columns)
