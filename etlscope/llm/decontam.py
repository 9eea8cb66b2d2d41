"""Benchmark decontamination by suffix arrays over the training text.

Words are numbered by the benchmark's vocabulary (exactly, by their bytes; other words are 0).  Each shard of training
text (a few MB of whole documents) gets a suffix array over its words, sorted as deep as the longest item, and every
suffix of the benchmark that holds a window is binary-searched in it.  A window is 13 consecutive words of one item (an
item of fewer words is one window); the search gives the run of training suffixes that start with it, so all its
locations.  The longest verbatim match at each location comes from narrowing the matching range of the benchmark's own
suffix array word by word.

Training positions outside of runs of known words that could hold the shortest window are left out of the array: no
benchmark suffix can match there.  Text never leaves its task; nothing is shuffled.  The benchmark travels in blocks of
``block_bytes`` at most; blocks of a larger one are searched one after the other, each in one reading of the corpus, and
only rows with hits are written and merged by row id.  Rows are judged by their own text in either case.

Edge cases: null text and empty text have no words and are never contaminated; items without words match nothing;
equal item_ids count as one item and a null item_id is named "null"; repeated documents give repeated rows; ids may have
any type; columns may have any names; empty tables work.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .util import find, fresh, materialize

WINDOW = 13
BLOCK_BYTES = 32 << 20  # of the benchmark
SHARD_BYTES = 4 << 20  # of training text
SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def _packed(numbers: np.ndarray, at: np.ndarray, end: np.ndarray, step: int, take: int, base: int, fill: int = 0) -> np.ndarray:
    """One number of the ``take`` numbers at ``at``, ``at + step``, ...; ``fill`` from ``end`` on."""
    key = np.zeros(len(at), np.int64)
    for k in range(take):
        here = at + k * step
        key = key * base + np.where(here < end, numbers[np.minimum(here, len(numbers) - 1)], fill)
    return key


def _fits(base: int) -> int:
    """How many numbers below ``base`` go into 62 bits."""
    return max(2, int(62 / np.log2(max(2, base))))


def suffix_array(numbers: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` sorted by their numbers up to ``depth``.

    ``end`` holds where the run of each position ends; with a position, all later ones of its run belong to ``at``.  Each round ranks several times as
    many numbers as the one before.
    """
    rank, have = numbers, 1
    while True:
        base = int(rank.max(initial=0)) + 1
        take = _fits(base)
        key = _packed(rank, at, end, have, take, base)
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
        have *= take
        if have >= depth or new.all():
            return at[order]
        rank = np.zeros(len(numbers), np.int64)
        rank[at[order]] = np.cumsum(np.concatenate([[True], new]))


def _numbers(words: tb.Words, vocabulary: pa.Array) -> np.ndarray:
    """The place of each word in the vocabulary, from 1; 0 for others."""
    found = pc.index_in(tb.arrow_words(words, tb.alnum_class()), value_set=vocabulary)
    return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


@dataclass
class Benchmark:
    """The searchable form of a block of items: word numbers, their suffix array, distinct windows."""

    names: list[str]
    vocabulary: pa.Array
    numbers: np.ndarray
    item: np.ndarray  # item name index of each word
    end: np.ndarray  # where the text of each word ends
    order: np.ndarray  # suffix array
    head: np.ndarray  # of each distinct window: where it first occurs, its words, its run in ``order``
    size: np.ndarray
    run: np.ndarray
    owners: np.ndarray  # items of all windows, window by window
    owner_at: np.ndarray
    longest: int

    @classmethod
    def build(cls, rows: list[tuple[str, str]], window: int) -> Benchmark:
        names = sorted({n for n, _ in rows})
        index = {n: i for i, n in enumerate(names)}
        data, offsets = tb.buffers(pa.array([t for _, t in rows], pa.large_string()))
        words = tb.split(tb.lower(data), offsets, tb.alnum_class(), hashes=False)
        vocabulary = tb.arrow_words(words, tb.alnum_class()).unique()
        numbers = _numbers(words, vocabulary)
        n = len(numbers)
        item = np.array([index[x] for x, _ in rows], np.int64)[words.doc] if n else np.zeros(0, np.int64)
        end, length = words.bounds[words.doc + 1], words.count()[words.doc]
        longest = int(length.max(initial=0))
        order = suffix_array(numbers, np.arange(n), end, longest)
        size = np.minimum(length, window)
        # windows in the order of the suffix array, so equal ones of one size are neighbours once sorted by size
        heads = order[(end - np.arange(n) >= size)[order]]
        heads = heads[np.argsort(size[heads], kind="stable")]
        fresh_ = np.ones(len(heads), bool)
        if len(heads) > 1:
            a, b, span = heads[1:], heads[:-1], size[heads[1:]]
            same = size[a] == size[b]
            for k in range(window):
                inside = span > k
                same &= ~inside | (numbers[np.minimum(a + k, n - 1)] == numbers[np.minimum(b + k, n - 1)])
            fresh_[1:] = ~same
        head, of = heads[fresh_], np.cumsum(fresh_) - 1
        pairs = np.unique(of * max(1, len(names)) + item[heads])
        owner_of, owners = pairs // max(1, len(names)), pairs % max(1, len(names))
        out = cls(names, vocabulary, numbers, item, end, order, head, size[head], np.zeros((0, 2), np.int64), owners, np.searchsorted(owner_of, np.arange(len(head) + 1)), longest)
        out.run = out.ranges(numbers, order, end)
        return out

    def ranges(self, numbers: np.ndarray, order: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First and last (exclusive) place in a suffix array of the suffixes that start with each window.

        The first words are looked up at once, packed into one key; the rest narrows the range word by word.
        """
        out = np.zeros((len(self.head), 2), np.int64)
        if not len(order) or not len(self.head):
            return out
        base = len(self.vocabulary) + 1
        take = _fits(base)
        keys, stop = _packed(numbers, order, end[order], 1, take, base), self.head + self.size
        out[:, 0] = np.searchsorted(keys, _packed(self.numbers, self.head, stop, 1, take, base), "left")
        out[:, 1] = np.searchsorted(keys, _packed(self.numbers, self.head, stop, 1, take, base, base - 1), "right")
        live = np.flatnonzero((out[:, 0] < out[:, 1]) & (self.size > take))
        for k in range(take, int(self.size.max())):
            live = live[self.size[live] > k]
            word = self.numbers[self.head[live] + k]
            a, b = (bisect(numbers, order, end, out[live, 0], out[live, 1], np.full(len(live), k), word, right) for right in (False, True))
            out[live, 0], out[live, 1] = a, b
            live = live[a < b]
        return out

    def extend(self, numbers: np.ndarray, end: np.ndarray, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match of each training suffix with any benchmark suffix, and a place of it in the benchmark."""
        low, high = self.run[window, 0].copy(), self.run[window, 1].copy()
        depth = self.size[window].copy()
        live = np.arange(len(at))
        while len(live):
            live = live[end[at[live]] > at[live] + depth[live]]
            word, d = numbers[at[live] + depth[live]], depth[live]
            a, b = (bisect(self.numbers, self.order, self.end, low[live], high[live], d, word, right) for right in (False, True))
            grew = (a < b) & (word > 0)
            live, a, b = live[grew], a[grew], b[grew]
            low[live], high[live] = a, b
            depth[live] += 1
        return depth, self.order[low] if len(low) else low


def bisect(numbers: np.ndarray, order: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """Within places low:high of a suffix array, whose suffixes agree before ``depth``, the first whose number there is not below ``word`` (or above it)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        value = np.where(at + depth < end[at], numbers[np.minimum(at + depth, len(numbers) - 1)], 0)
        less = (value <= word) if right else (value < word)
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def training_array(numbers: np.ndarray, doc: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the positions in runs of ``least`` known words or more, and where each position's run ends."""
    n = len(numbers)
    place = np.arange(n)
    begins = np.concatenate([[True], (doc[1:] != doc[:-1]) | (numbers[:-1] == 0) | (numbers[1:] == 0)]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(begins, place, 0))
    end = np.append(np.minimum.accumulate(np.where(begins, place, n)[::-1])[::-1][1:], n) if n else place
    kept = np.flatnonzero((numbers > 0) & (end - first >= least))
    return suffix_array(numbers, kept, end[kept], depth) if len(kept) else kept, end


def built(key: str, rows: list[tuple[str, str]], window: int) -> Benchmark:
    """The searchable form of a block, built once in each Python worker, which Spark reuses for many tasks; the latest block is kept."""
    import sys

    kept = vars(sys).setdefault("_etlscope_benchmark", {})
    if key not in kept:
        kept.clear()
        kept[key] = Benchmark.build(rows, window)
    return kept[key]


def search(bench: Benchmark, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """One record per text: n_words, hit spans (word positions), items, and the longest match with its place."""
    words = tb.split(tb.lower(data), offsets, tb.alnum_class(), hashes=False)
    out = [{"n_words": int(c), "spans": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None} for c in words.count()]
    if not len(words.start) or not len(bench.head):
        return out
    numbers = _numbers(words, bench.vocabulary)
    order, end = training_array(numbers, words.doc, int(bench.size.min()), bench.longest)
    run = bench.ranges(numbers, order, end)
    n = run[:, 1] - run[:, 0]
    which = np.repeat(np.arange(len(n)), n)
    spot = order[np.repeat(run[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if n.any() else n[:0]
    if not len(spot):
        return out
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, spot, 1)
    np.add.at(cover, spot + bench.size[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = hit & (np.diff(words.doc, prepend=-1) != 0)
    begins = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
    ends = np.flatnonzero(hit & np.concatenate([~hit[1:] | edge[1:], [True]])) + 1
    for b, e in zip(begins, ends, strict=True):
        d = int(words.doc[b])
        out[d]["spans"].append({"first": int(b - words.bounds[d]), "last": int(e - words.bounds[d])})
    doc = words.doc[spot]
    pairs = np.unique(doc * len(bench.head) + which)
    for d, w in zip((pairs // len(bench.head)).tolist(), (pairs % len(bench.head)).tolist(), strict=True):
        out[d]["items"].extend(bench.owners[bench.owner_at[w] : bench.owner_at[w + 1]].tolist())
    depth, place = bench.extend(numbers, end, spot, which)
    best = np.lexsort((spot, -depth, doc))
    for i in best[np.unique(doc[best], return_index=True)[1]]:
        d = int(doc[i])
        out[d] |= {"longest": int(depth[i]), "longest_at": int(spot[i] - words.bounds[d]), "longest_item": bench.names[bench.item[place[i]]]}
    for d in np.unique(doc).tolist():
        out[d]["items"] = [bench.names[i] for i in sorted(set(out[d]["items"]))]
    return out


_OUT = [
    T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.IntegerType()), T.StructField("longest_at", T.IntegerType()), T.StructField("longest_item", T.StringType()),
]
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string())),
    ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string()),
])


def _scan(rows: DataFrame, bench_rows: list[tuple[str, str]], window: int) -> DataFrame:
    shared, key = rows.sparkSession.sparkContext.broadcast(bench_rows), uuid.uuid4().hex

    def run(batches):
        bench = built(key, shared.value, window)
        for batch in batches:
            data, offsets = tb.buffers(batch.column(2))
            for i, j in tb.groups(offsets, SHARD_BYTES):
                columns = pa.array(search(bench, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), _ARROW).flatten()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *columns], ["rid", "doc_id", *[f.name for f in _OUT]])

    schema = T.StructType([rows.schema["rid"], rows.schema["doc_id"], *_OUT])
    return rows.select("rid", "doc_id", "text").mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items, longest, longest_at, longest_item) per row of ``docs(doc_id, text)``.

    spans are the maximal runs of hit words; items the sorted names of the items with a window in the document.
    """
    items, total = _items(benchmark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    if total > block_bytes:
        rows = materialize(rows, "decontam-rows")
    return _matches(rows, items, total, window, block_bytes).drop("rid")


def _matches(rows: DataFrame, items: DataFrame, total: int, window: int, block_bytes: int) -> DataFrame:
    """What ``matches`` gives and rid, per row of ``rows(rid, doc_id, text)``; with several blocks, rids must be stored ones.

    Each block is searched and its hits written before the next is read, so one block at a time is held.
    """
    if total <= block_bytes:
        return _scan(rows, [tuple(r) for r in items.collect()], window)
    n = -(-total // block_bytes)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    found = None
    for b in range(n):
        part = _scan(rows, [tuple(r) for r in items.where(block == b).collect()], window)
        part = materialize(part if found is None else part.where("longest > 0"), "decontam-hits")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("rid").orderBy("first", "last")
    spans = found.select("rid", F.inline("spans"))
    spans = spans.withColumn("fresh", F.col("first") > F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    spans = spans.withColumn("run", F.sum(F.col("fresh").cast("int")).over(order)).groupBy("rid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    names = found.select("rid", F.explode("items").alias("item")).groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    best = F.max_by(F.struct("longest", "longest_at", "longest_item"), F.struct("longest", -F.col("longest_at"))).alias("best")
    whole = found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), best)
    whole = whole.join(spans, "rid", "left").join(names, "rid", "left")
    return whole.select("rid", "doc_id", "n_words", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "best.longest", "best.longest_at", "best.longest_item")


def judge(found: DataFrame) -> DataFrame:
    """n_hit and the contamination rule: hit words are at least a twentieth of all words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = judge(matches(docs, benchmark))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return items, items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    With a benchmark of one block rows are filtered where they are; else by an anti-join on stored row ids.
    """
    items, total = _items(benchmark)
    text = find(docs, "text")
    if total > block_bytes:
        rid = fresh(docs, "rid")
        own = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "decontam-docs")
        rows = own.select(F.col(rid).alias("rid"), F.lit(None).cast("int").alias("doc_id"), F.col(text).alias("text"))
        bad = judge(_matches(rows, items, total, window, block_bytes)).where("contaminated").select(F.col("rid").alias(rid))
        return own.join(bad, rid, "left_anti").select(*docs.columns)
    shared, key = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex
    place = docs.columns.index(text)

    def run(batches):
        bench = built(key, shared.value, window)
        for batch in batches:
            data, offsets = tb.buffers(batch.column(place))
            keep: list[bool] = []
            for i, j in tb.groups(offsets, SHARD_BYTES):
                for x in search(bench, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    n_hit = sum(s["last"] - s["first"] for s in x["spans"])
                    keep.append(not (n_hit > 0 and 20 * n_hit >= x["n_words"]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def items_digest(names: list[str]) -> str:
    """What the query gives as items_sha256."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
