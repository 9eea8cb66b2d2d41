"""Substring deduplication by seed and extend over winnowed anchors.

Seeds: of every 28 consecutive 8-word hashes the least is an anchor (winnowing), so each 35-word window contains an
anchor that depends on the window's words alone, and equal windows contain equal anchors.  Documents are joined on
anchors: an anchor that occurs once in the corpus cannot lie in a repeated window.

Extension: from each repeated anchor to both sides, as far as a window that holds it can reach, all windows whose anchor
it is are candidates.  A window whose words occur at two places or more is repeated; runs of repeated windows are the
maximal repeats, and all their words are removed, at every occurrence.  Pairs of occurrences are never formed, as a
passage held by n documents has n squared of them: occurrences of one anchor are told apart by what surrounds them.

How it runs.  Texts are packed into groups of a few MB (one row, zstandard-compressed), which are the unit of work.
Each group sends its distinct hashes to buckets of the hash space, with a mark if it holds one several times; a bucket
answers which are repeated.  A task sends a hash twice at most as long as it remembers it (``MEMORY`` hashes): at the
third group it knows that the hash is repeated.  So a hash held by a third of all documents reaches its bucket about
twice a task, and buckets are sized by the volume of text.

Exactness.  Words are compared by 128-bit names (their own bytes up to 15, see textbytes), anchors by 64 bits (a false
match only adds a candidate), and windows by 127 bits of two unrelated hashes of the names of their words.

Edge cases: null and empty texts have no words; texts below 35 words keep all; a word sequence repeated inside one
document counts; rows of equal id are separate documents; ids may have any type; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .util import materialize

WINDOW, GRAM = 35, 8
GROUP_BYTES = 2 << 20
BUCKET_BYTES = 12 << 20  # text per bucket of the hash space
MEMORY = 1 << 19  # hashes that a task remembers

#: The lowest bit of g marks hashes that a group holds several times.
_HASH = np.dtype([("h", "<u8"), ("g", "<u8")])
_ONE = np.uint64(1)


# --- words, anchors, windows of one group ------------------------------------------------------------------------


def winnow(words: tb.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each window start: its position (-1 where no whole window starts) and all gram hashes.

    The anchor is the leftmost least gram of the window.
    """
    grams = tb.grams(words.hash, gram)
    span = window - gram + 1
    n = len(words.start)
    anchor = np.full(n, -1, np.int64)
    starts = n - window + 1
    if starts <= 0:
        return anchor, grams
    at = np.arange(len(grams))
    size = 1  # sliding minimum by doubling: at[i] is the place of the least of size grams from i on
    while size * 2 <= span:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(grams[b] < grams[a], b, a)
        size *= 2
    a, b = at[:starts], at[span - size : span - size + starts]
    anchor[:starts] = np.where(grams[b] < grams[a], b, a)
    anchor[words.left() < window] = -1
    return anchor, grams


def distinct_hashes(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes, marked where they occur more than once."""
    order = np.argsort(h, kind="stable")
    h, g = h[order], g[order] >> _ONE
    same = h[1:] == h[:-1]
    if (same & (g[1:] != g[:-1])).any():  # equal in the first half only
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
    place = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
    out = np.empty(len(place), _HASH)
    out["h"], out["g"] = h[place], g[place] << _ONE | (np.diff(place, append=len(h)) > 1)
    return out


def anchor_hashes(words: tb.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window anchors, gram hashes, and the distinct anchor hashes.

    An anchor that serves windows at several starts of one place is one occurrence.
    """
    anchor, grams = winnow(words, window, gram)
    grams = tb.mix(grams)  # anchors are least values: spread them over the hash space before they are dealt to buckets
    places = np.unique(anchor[anchor >= 0])
    return anchor, grams, distinct_hashes(grams[places], np.zeros(len(places), np.uint64))


def candidate_windows(anchor: np.ndarray, grams: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Starts of windows whose own anchor is repeated; ``repeated`` holds the repeated anchor hashes, sorted."""
    starts = np.flatnonzero(anchor >= 0)
    if not len(repeated):
        return starts[:0]
    places, of = np.unique(anchor[starts], return_inverse=True)
    spot = np.minimum(np.searchsorted(repeated, grams[places]), len(repeated) - 1)
    return starts[(repeated[spot] == grams[places])[of]]


def window_hashes(words: tb.Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tb.grams(words.hash, window)[starts], tb.grams(words.other, window, 1)[starts]


# --- packing, buckets --------------------------------------------------------------------------------------------


def pack(docs: DataFrame) -> DataFrame:
    """(gid, ids, texts, offsets): one row per group of whole texts."""

    def run(batches):
        from pyspark import TaskContext

        task, seq, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(1)
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            own = batch.column(0)
            for i, j in tb.groups(offsets, GROUP_BYTES):
                part = pa.RecordBatch.from_arrays([own.slice(i, j - i)], ["doc_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                row = [f"{task}-{seq}", sink.getvalue().to_pybytes(), squeeze.compress(data[offsets[i] : offsets[j]].tobytes()), (offsets[i : j + 1] - offsets[i]).astype("<i8").tobytes(), int(offsets[j] - offsets[i])]
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["gid", "ids", "texts", "offsets", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "gid string, ids binary, texts binary, offsets binary, bytes long")


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(row["offsets"], "<i8")
    data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, row["bytes"]))
    return np.frombuffer(data, np.uint8), offsets


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Memory:
    """Which hashes this task has sent, and how often; a new one takes the place of another at its slot."""

    def __init__(self, slots: int = MEMORY):
        self.seen, self.times = np.zeros(slots, _HASH), np.zeros(slots, np.uint8)

    def known(self, found: np.ndarray) -> np.ndarray:
        """Which of a group's distinct hashes were sent twice already; the others count as sent now."""
        slot = (found["h"] >> np.uint64(11)).astype(np.int64) & (len(self.times) - 1)
        same = (self.times[slot] > 0) & (self.seen["h"][slot] == found["h"]) & (self.seen["g"][slot] >> _ONE == found["g"] >> _ONE)
        known = same & (self.times[slot] >= 2)
        self.times[slot[same & ~known]] += 1
        new = slot[~same]
        self.seen[new], self.times[new] = found[~same], 1
        return known


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary cells: data[edges[i]:edges[i + 1]]."""
    offsets = (edges * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _cells(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a binary column, one after the other, and the length of each."""
    cells = [np.frombuffer(c.as_buffer(), dtype) for c in column]
    return np.concatenate([np.zeros(0, dtype), *cells]), np.array([len(c) for c in cells], np.int64)


_SENT = "bucket long, gid string, hashes binary"


def _sent(gid: str, found: np.ndarray, buckets: int, memory: Memory) -> pa.RecordBatch:
    """A row for each bucket that gets hashes, and row -1 with a byte for each hash: 1 if it was not sent."""
    known = memory.known(found)
    own = found[~known]
    bucket = ((own["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = _binary(own, np.append(begins, len(own)))
    hashes = pa.chunked_array([pa.array([known.astype(np.uint8).tobytes()], pa.binary()), rows]).combine_chunks()
    gids = pa.array([gid], pa.string()).take(pa.array(np.zeros(len(hashes), np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], bucket[begins]])), gids, hashes], ["bucket", "gid", "hashes"])


def _answer(table: pa.Table) -> pa.Table:
    """A byte for each hash of each group in this bucket: 1 if it is held twice or more in all; rows -1 stay as they are."""
    if table["bucket"][0].as_py() < 0:
        return pa.table({"gid": table["gid"], "bucket": table["bucket"], "flags": table["hashes"]})
    found, size = _cells(table["hashes"], _HASH)
    h, g = found["h"], found["g"] >> _ONE
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    run = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) - 1
    hit = (np.bincount(run) > 1) | (np.bincount(run, (found["g"] & _ONE)[order]) > 0)
    flag = np.empty(len(found), np.uint8)
    flag[order] = hit[run]
    return pa.table({"gid": table["gid"], "bucket": table["bucket"], "flags": _binary(flag, np.concatenate([[0], np.cumsum(size)]))})


def _ask(sent: DataFrame, buckets: int) -> DataFrame:
    """(gid, answers): per group its row -1 and the flags of its buckets, which are in the order of its sorted hashes."""
    n = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 2)  # a task gets a few buckets at any size
    dealt = sent.withColumn("own", F.when(F.col("bucket") < 0, F.col("gid"))).repartition(n, "bucket", "own")
    return dealt.groupBy("bucket", "own").applyInArrow(_answer, "gid string, bucket long, flags binary").groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("bucket", "flags"))).alias("answers"))


def _flags(answers: list) -> np.ndarray:
    """Which of the group's distinct hashes are repeated."""
    out = np.frombuffer(answers[0]["flags"], np.uint8).astype(bool)
    out[~out] = np.frombuffer(b"".join(a["flags"] for a in answers[1:]), np.uint8)
    return out


# --- the operator ------------------------------------------------------------------------------------------------


def _candidates(row: dict, window: int, gram: int):
    data, offsets = _unpack(row)
    words = tb.split(data, offsets, tb.space_class())
    anchor, grams, found = anchor_hashes(words, window, gram)
    starts = candidate_windows(anchor, grams, found["h"][_flags(row["answers"])])
    return data, words, starts, *window_hashes(words, starts, window)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, spans (first, last word) of its maximal repeats, kept text."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    packed = materialize(pack(docs), "packed")
    total = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = int(max(8, -(-total // BUCKET_BYTES)))

    def seeds(batches):
        memory = Memory()
        for row in _rows(batches):
            data, offsets = _unpack(row)
            yield _sent(row["gid"], anchor_hashes(tb.split(data, offsets, tb.space_class()), window, gram)[2], buckets, memory)

    known = materialize(_ask(packed.mapInArrow(seeds, _SENT), buckets), "anchors")
    seeded = packed.join(known, "gid")

    def extend(batches):
        memory = Memory()
        for row in _rows(batches):
            yield _sent(row["gid"], distinct_hashes(*_candidates(row, window, gram)[3:]), buckets, memory)

    answers = _ask(seeded.mapInArrow(extend, _SENT), buckets).withColumnRenamed("answers", "windows")

    def finish(batches):
        for row in _rows(batches):
            data, words, starts, h, g = _candidates(row, window, gram)
            found = distinct_hashes(h, g)
            hit = found[_flags(row["windows"])]
            spot = np.minimum(np.searchsorted(hit["h"], h), max(0, len(hit) - 1))
            if len(hit) and (np.diff(hit["h"]) == 0).any():  # equal in the first half only
                inside = np.isin(_joined(h, g >> _ONE), _joined(hit["h"], hit["g"] >> _ONE))
            else:
                inside = (hit["h"][spot] == h) & (hit["g"][spot] >> _ONE == g >> _ONE) if len(hit) else np.zeros(len(h), bool)
            yield _removed(row, data, words, starts[inside], window)

    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType())]
    return seeded.join(answers, "gid").mapInArrow(finish, T.StructType([docs.schema["doc_id"], *fields]))


def _joined(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), _HASH)
    out["h"], out["g"] = h, g
    return out.view("V16").ravel()


def _removed(row: dict, data: np.ndarray, words: tb.Words, starts: np.ndarray, window: int) -> pa.RecordBatch:
    n = len(words.start)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    edge = np.diff(words.doc, prepend=-1) != 0
    begins = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
    ends = np.flatnonzero(gone & np.concatenate([~gone[1:] | edge[1:], [True]])) + 1 if n else begins
    n_docs = len(words.bounds) - 1
    base = words.bounds[words.doc[begins]]
    spans = pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["first", "last"])
    at = np.searchsorted(words.doc[begins], np.arange(n_docs + 1)).astype(np.int32)
    kept = np.flatnonzero(~gone)
    size = words.end[kept] - words.start[kept] + 1
    target = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(target[-1]) - np.repeat(target[:-1] - words.start[kept], size)
    text = data[np.minimum(source, max(0, len(data) - 1))] if len(data) else np.zeros(0, np.uint8)
    text[target[1:] - 1] = 0x20
    bounds = target[np.searchsorted(words.doc[kept], np.arange(n_docs + 1))]
    raw = text.tobytes()
    strings = [raw[a : b - 1] if b > a else b"" for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
    ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
    removed = np.bincount(words.doc, gone, n_docs).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(words.count()), pa.array(removed), pa.ListArray.from_arrays(pa.array(at), spans), pa.array(strings, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "n_removed", "spans", "kept"],
    )


def query(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
