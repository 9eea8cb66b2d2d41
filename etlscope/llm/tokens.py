"""Token ids in a bit-plane shuffled binary format.

Documents are range-partitioned by doc_id, tokenised, and each task writes one shard.  Within a shard, ids go in
blocks of a fixed size; a block's 32-bit ids are transposed into byte planes (all lowest bytes, then all second
bytes, ...) or into 32 bit planes, planes of zeros are left out, and each other plane is compressed with zstandard
on its own.  A chunk index at the end locates every plane, so a reader can decode any block alone.

Shard layout; all integers little-endian::

    header   "BPSHUF01", shard number u32, planes kind u32 (8 byte, 1 bit), block size u32        then "\\n"
    block    its compressed planes, one after the other                                          then "\\n"
    docs     zstandard of: doc_id i64[n], null flag u8[n], ids per document u64[n]               then "\\n"
    index    zstandard of, per block: offset u64, ids u32, bytes of each plane u32[4 or 32]      then "\\n"
    footer   docs offset, docs bytes, documents, index offset, index bytes, blocks u64[6], "BPSHUF01"  then "\\n"

The files are written by Spark's line writer (each part above is one "line" of raw bytes), so they go to any store
that Spark can write, under Spark's commit protocol: retried or lost tasks leave no partial shards.

The tokenizer sees each distinct piece of text once.  A text may be cut before a single space between two visible
characters, around a single newline between two, and after a letter before punctuation, because the byte-level
pre-tokenizer always starts a new piece there.  Pieces are told apart by their bytes, and the ids of up to ``CACHE``
pieces are kept in each worker process.  New pieces are encoded in batches, joined by a newline where that is a token of
its own.

Edge cases: null text is empty and gives only the end id; a null doc_id sorts first; equal ids are ordered by text;
an empty table gives an empty result.  Shards hold about ``SHARD_BYTES`` of text, split by doc_id and a hash of the text, so
only identical rows of one id must share a shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .util import new_folder

MAGIC = b"BPSHUF01"
BLOCK = 1 << 16
END_ID = 2
CACHE = 500_000  # pieces
SHARD_BYTES = 64 << 20  # of text
JOINED = 500  # pieces encoded as one text
_HEADER, _FOOTER = "<8sIII", "<6Q8s"


# --- format -----------------------------------------------------------------------------------------------------


def planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The byte (8) or bit (1) planes of u32 ids, lowest first; a plane of zeros is empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    rows = raw.T if kind == 8 else np.unpackbits(raw, axis=1, bitorder="little").T
    return [(x.tobytes() if kind == 8 else np.packbits(x).tobytes()) if x.any() else b"" for x in rows]


def unplane(parts: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == 8:
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(parts):
            if p:
                raw[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(parts):
            if p:
                bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    """Yields the lines of one shard; holds one block of ids and 17 bytes per document."""

    def __init__(self, shard: int, kind: int = 8, block: int = BLOCK, level: int = 3):
        self.kind, self.block, self.offset = kind, block, 0
        self.header = struct.pack(_HEADER, MAGIC, shard, kind, block)
        self.zstd = zstandard.ZstdCompressor(level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _line(self, raw: bytes) -> bytes:
        self.offset += len(raw) + 1
        return raw

    def start(self) -> bytes:
        return self._line(self.header)

    def _flush(self, ids: np.ndarray) -> bytes:
        parts = [self.zstd.compress(p) if p else b"" for p in planes(ids, self.kind)]
        self.index.append((self.offset, len(ids), [len(p) for p in parts]))
        return self._line(b"".join(parts))

    def add(self, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append((doc_ids.astype("<i8"), null.astype(np.uint8), counts.astype("<u8")))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            ids = np.concatenate(self.waiting)
            full = len(ids) // self.block * self.block
            for i in range(0, full, self.block):
                yield self._flush(ids[i : i + self.block])
            self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def finish(self) -> Iterator[bytes]:
        if self.n_waiting:
            yield self._flush(np.concatenate(self.waiting))
        columns = [np.concatenate(c) for c in zip(*self.docs, strict=True)] if self.docs else [np.zeros(0, t) for t in ("<i8", "u1", "<u8")]
        docs_at, docs = self.offset, self.zstd.compress(b"".join(c.tobytes() for c in columns))
        yield self._line(docs)
        index_at, index = self.offset, self.zstd.compress(b"".join(struct.pack(f"<QI{len(p)}I", at, n, *p) for at, n, p in self.index))
        yield self._line(index)
        yield self._line(struct.pack(_FOOTER, docs_at, len(docs), len(columns[0]), index_at, len(index), len(self.index), MAGIC))


class Reader:
    """One shard; blocks are decoded one at a time."""

    def __init__(self, content):
        self.content = content
        magic, self.shard, self.kind, self.block = struct.unpack_from(_HEADER, content, 0)
        docs_at, docs_n, n, index_at, index_n, blocks, end = struct.unpack_from(_FOOTER, content, len(content) - struct.calcsize(_FOOTER) - 1)
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a whole shard file")
        self.zstd = zstandard.ZstdDecompressor()
        docs = self.zstd.decompress(content[docs_at : docs_at + docs_n], max_output_size=max(1, 17 * n))
        self.doc_ids = np.frombuffer(docs, "<i8", n)
        self.null = np.frombuffer(docs, np.uint8, n, 8 * n).astype(bool)
        self.counts = np.frombuffer(docs, "<u8", n, 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        entry = np.dtype([("at", "<u8"), ("n", "<u4"), ("parts", "<u4", (4 if self.kind == 8 else 32,))])
        raw = self.zstd.decompress(content[index_at : index_at + index_n], max_output_size=max(1, entry.itemsize * blocks))
        self.index = np.frombuffer(raw, entry, blocks)

    def ids(self, k: int) -> np.ndarray:
        at, n, sizes = int(self.index["at"][k]), int(self.index["n"][k]), self.index["parts"][k]
        plane = n if self.kind == 8 else -(-n // 8)
        parts = []
        for size in sizes.tolist():
            parts.append(self.zstd.decompress(self.content[at : at + size], max_output_size=plane) if size else b"")
            at += size
        return unplane(parts, n, self.kind)

    def span(self, first: int, last: int) -> np.ndarray:
        """Ids first:last of the shard, decoding only the blocks that hold them."""
        got = [self.ids(k)[max(0, first - k * self.block) : last - k * self.block] for k in range(first // self.block, -(-last // self.block))]
        return np.concatenate(got) if got else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))

    def digests(self) -> list[int]:
        """CRC-32 of each document's ids, block by block."""
        out, ids, base, k = [], np.zeros(0, np.uint32), 0, 0
        for first, last in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            crc = 0
            while first < last:
                if first >= base + len(ids):
                    base, ids, k = base + len(ids), self.ids(k), k + 1
                part = ids[first - base : last - base]
                crc = zlib.crc32(np.ascontiguousarray(part), crc)
                first += len(part)
            out.append(crc)
        return out


# --- tokenising -------------------------------------------------------------------------------------------------


class Encoder:
    """encode() of whole texts through a tokenizer that is asked once for each distinct piece."""

    def __init__(self, tokenizer_path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(b" " in a or b"\n" in a for a in self.added):
            raise ValueError("added tokens with white space are not supported")
        self.cache_size = cache
        self.clear()
        self.visible = np.zeros(256, bool)
        self.visible[0x21:0x7F] = True
        self.letter = np.zeros(256, bool)
        self.letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        self.mark = self.visible & ~self.letter
        self.mark[0x30:0x3A] = False
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = line[0] if len(line) == 1 else None

    def clear(self) -> None:
        self.store = Store()
        self.long: dict[bytes, int] = {}  # entry of each piece of more than SHORT bytes

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: all text starts, and the safe places inside texts.

        Visible means ASCII 0x21-0x7E or a letter of the block whose UTF-8 lead byte is 0xC3, which has no space.
        """
        n = len(data)
        begin = np.zeros(n, bool)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        if n > 2:
            lead = data == 0xC3
            letter = self.letter[data]
            letter[1:] |= lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)  # all letters but the signs for times and divide
            if not self.has_added(data):
                begin[1:] |= letter[:-1] & self.mark[data[1:]]
            after = self.visible[data] | lead  # a visible character begins here
            before = self.visible[data]
            before[1:] |= lead[:-1]  # ... or ends here
            gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
            first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            first[offsets[:-1]] = True
            last[offsets[1:]] = True  # position after a text's last byte
            gap = gap[(gap > 0) & (gap < n - 1)]
            gap = gap[before[gap - 1] & after[gap + 1] & ~first[gap] & ~last[gap + 1]]
            begin[gap] = True
            begin[gap[data[gap] == 0x0A] + 1] = True
        return np.flatnonzero(begin)

    def has_added(self, data: np.ndarray) -> bool:
        """Whether a string of the tokenizer's added tokens occurs; a cut must not fall inside one."""
        raw = data.tobytes()
        return any(a in raw for a in self.added)

    def _learn(self, raw: memoryview, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and the count of each."""
        first = data[start]
        second = (first == 0x20) & (end - start > 1)
        first[second] = data[start[second] + 1]
        lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
        # a newline before and one behind such a piece are tokens of their own: it begins (but for one space) and ends visibly
        joins = (self.visible[first] | (first == 0xC3)) & self.visible[data[end - 1]] & (lines[end] == lines[start]) & (self.newline is not None)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n, pieces = int(joins.sum()), [bytes(raw[a:b]) for a, b in zip(start[order].tolist(), end[order].tolist(), strict=True)]
        texts = [b"\n".join(pieces[a : min(n, a + JOINED)]).decode() for a in range(0, n, JOINED)] + [p.decode() for p in pieces[n:]]
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for e in (e for a in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[a : a + 64], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            if n > 0:
                line = np.flatnonzero(ids == self.newline)
                counts.append(np.diff(line, prepend=-1, append=len(ids)) - 1)
                ids = np.delete(ids, line)
                n -= JOINED
            else:
                counts.append(np.array([len(ids)]))
            flat.append(ids)
        found, size = np.concatenate(flat), np.concatenate(counts)
        if len(size) != len(order):
            raise ValueError("pieces and their ids do not fit")
        place = np.argsort(order)  # back to the order given
        at, size = (np.cumsum(size) - size)[place], size[place]
        return found[np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and the count of each text."""
        start = self.cuts(data, offsets)
        end = np.append(start[1:], len(data)).astype(np.int64)[: len(start)]
        if len(self.store.first) + len(start) > self.cache_size:
            self.clear()
        entry, raw = np.empty(len(start), np.int64), memoryview(np.ascontiguousarray(data))
        short = end - start <= tb.SHORT
        own = np.flatnonzero(short)
        low, high = tb.names(data, start[own], end[own])
        found = self.store.lookup(low, high)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            miss = miss[np.lexsort((low[miss], high[miss]))]
            fresh = np.concatenate([[True], (low[miss][1:] != low[miss][:-1]) | (high[miss][1:] != high[miss][:-1])])
            new = miss[fresh]
            found[miss] = self.store.add(low[new], high[new], *self._learn(raw, data, start[own[new]], end[own[new]]))[np.cumsum(fresh) - 1]
        entry[own] = found
        own = np.flatnonzero(~short)
        if len(own):
            pieces = [bytes(raw[a:b]) for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]
            new = {p: i for i, p in enumerate(pieces) if p not in self.long}
            if new:
                at = own[list(new.values())]
                self.long.update(zip(new, self.store.extend(*self._learn(raw, data, start[at], end[at])).tolist(), strict=True))
            entry[own] = [self.long[p] for p in pieces]
        first, size = self.store.first[entry], self.store.size[entry]
        text = np.searchsorted(offsets, start, side="right") - 1
        counts = np.bincount(text, weights=size, minlength=len(offsets) - 1).astype(np.int64) + 1
        # one more piece, the end id, after the pieces of each text
        ends = np.cumsum(np.bincount(text, minlength=len(offsets) - 1))
        first, size = np.insert(first, ends, -1), np.insert(size, ends, 1)
        target = np.cumsum(size) - size
        ids = np.arange(int(size.sum())) - np.repeat(target - first, size)
        out = self.store.flat[np.maximum(ids, 0)]
        out[ids < 0] = END_ID
        return out, counts


class Store:
    """Ids of pieces, one after the other, and an open hash table of 128-bit names."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by entry
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.table = np.full(1 << 12, -1, np.int32)
        self.named = 0

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (tb.mixed(low, high)[0] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def lookup(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each name, -1 if it has none."""
        out, at, open_ = np.full(len(low), -1, np.int64), self._home(low, high), np.arange(len(low))
        while len(open_):
            here = self.table[at[open_]]
            taken = here >= 0
            open_, here = open_[taken], here[taken]
            same = (self.low[here] == low[open_]) & (self.high[here] == high[open_])
            out[open_[same]] = here[same]
            open_ = open_[~same]
            at[open_] = (at[open_] + 1) & (len(self.table) - 1)
        return out

    def _place(self, entry: np.ndarray) -> None:
        at = self._home(self.low[entry], self.high[entry])
        while len(entry):
            free = np.flatnonzero(self.table[at] < 0)
            self.table[at[free]] = entry[free]  # of several at one place the last stays
            left = self.table[at] != entry
            entry, at = entry[left], (at[left] + 1) & (len(self.table) - 1)

    def extend(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New entries without names."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        entry = np.arange(len(self.first), len(self.first) + len(size))
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)
        for name in ("low", "high"):
            setattr(self, name, np.concatenate([getattr(self, name), np.zeros(len(size), np.uint64)]))
        return entry

    def add(self, low: np.ndarray, high: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New entries with names, which are distinct and have none yet."""
        entry = self.extend(flat, size)
        self.low[entry], self.high[entry] = low, high
        self.named += len(entry)
        if 2 * self.named > len(self.table):
            everything = np.concatenate([self.table[self.table >= 0], entry])
            self.table = np.full(1 << (4 * self.named).bit_length(), -1, np.int32)
            self._place(everything)
        else:
            self._place(entry)
        return entry


def worker_encoder(tokenizer: str) -> Encoder:
    """The encoder of this Python worker, which Spark reuses for many tasks."""
    import sys

    kept = vars(sys).setdefault("_etlscope_encoders", {})
    if tokenizer not in kept:
        kept[tokenizer] = Encoder(tokenizer)
    return kept[tokenizer]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, kind: int = 8, block: int = BLOCK) -> None:
    """Tokenise ``docs(doc_id, text)`` and write shards in ascending doc_id order; shard number = partition."""

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, writer = worker_encoder(tokenizer), Writer(TaskContext.get().partitionId(), kind, block)
        line = lambda parts: pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["line"])
        yield line([writer.start()])
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            own = batch.column(0)
            null = np.asarray(own.is_null())
            ids = own.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in tb.groups(offsets):
                tokens, counts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for raw in writer.add(ids[i:j], null[i:j], counts, tokens):
                    yield line([raw])
        for raw in writer.finish():
            yield line([raw])

    own = docs.select(F.col("doc_id").cast("long"), "text")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    key = F.xxhash64("text")
    ordered = own.repartitionByRange(n, "doc_id", key).sortWithinPartitions("doc_id", key, "text")
    lines = ordered.mapInArrow(run, "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, position, doc_id, local_start, n_tokens, ids_crc32) of every document in the shards of a folder."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                r = Reader(memoryview(content.as_buffer()))
                n = len(r.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, r.shard, np.int64)), pa.array(np.arange(n)), pa.array(r.doc_ids, pa.int64(), mask=r.null),
                        pa.array(r.starts[:-1].astype(np.int64)), pa.array(r.counts), pa.array(r.digests(), pa.int64()),
                    ],
                    ["shard", "position", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    return _shards(spark, folder).mapInArrow(run, "shard long, position long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def shard_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, total): ids of each shard, from its document table alone."""

    def run(batches):
        for batch in batches:
            found = [Reader(memoryview(c.as_buffer())) for c in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r.shard for r in found], pa.int64()), pa.array([int(r.starts[-1]) for r in found], pa.int64())], ["shard", "total"])

    return _shards(spark, folder).mapInArrow(run, "shard long, total long")


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """read_shards with ``start``: how many ids all documents before have."""
    totals = shard_totals(spark, folder)  # one row per shard
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", before.alias("base"))
    return read_shards(spark, folder).join(bases, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "position")


def query(docs: DataFrame, tokenizer: str, kind: int = 8) -> DataFrame:
    spark = docs.sparkSession
    folder = new_folder(spark, "token-shards")
    write_shards(docs, folder, tokenizer, kind)
    return documents_of(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
