"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns.

Everything here works on whole batches of texts at once with numpy: a byte table says which bytes belong to
words, and each word gets a 128-bit name made of its bytes: the bytes themselves and the length up to 15 bytes, and
XXH3 of the bytes above.  Two 64-bit hashes are mixed from the name, and n-gram hashes are sums of word hashes times
powers of an odd constant, one family for each of the two.  Both word definitions used in this package separate on
ASCII bytes only, so classifying bytes is the same as classifying code points.  Memory is bounded by the group of texts
at hand (:data:`SLAB` bytes, or one longer text) plus a few arrays with one entry per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled as one group of documents.
SLAB = 1 << 20

#: Longest word whose bytes are its name.
SHORT = 15
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1] * (SHORT - 7), np.uint64)  # masks by word length
_HIGH = np.array([0] * 9 + [(1 << 8 * n) - 1 for n in range(1, SHORT - 7)], np.uint64)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd multipliers
_Q = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def space_class() -> np.ndarray:
    """Words are runs of ``[^\\x20\\x09-\\x0D]``."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def alnum_class() -> np.ndarray:
    """Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, after A-Z was lower-cased."""
    word = np.zeros(256, bool)
    word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return word


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        have = _POWERS[int(base)] = (both[0], both[1])
    return have


@dataclass
class Words:
    """The words of a group of texts: byte ranges in ``data``, the text each is in, and two 64-bit hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i+1]
    hash: np.ndarray | None = None
    other: np.ndarray | None = None

    def count(self) -> np.ndarray:
        return np.diff(self.bounds)

    def left(self) -> np.ndarray:
        """How many words of the same text follow from each word on, itself included."""
        return self.bounds[self.doc + 1] - np.arange(len(self.doc))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table[data]


def split(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, hashes: bool = True) -> Words:
    n = len(data)
    inside = word[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:n]
    ends = inside
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets, side="left")
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    out = Words(data, start, end, doc, bounds)
    if hashes:
        out.hash, out.other = word_hashes(data, start, end)
    return out


def arrow_words(words: Words, word: np.ndarray) -> pa.Array:
    """The bytes of each word; ``word`` is the byte class that they were split by."""
    edges = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    data = words.data[word[words.data]]
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit name of each byte range, as two 64-bit halves; ranges of up to SHORT bytes never share one."""
    size = end - start
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(wide) - 7,), "<u8", wide, strides=(1,))  # the eight bytes from each position on
    short = np.minimum(size, SHORT)
    low = eight[start] & _LOW[short]
    high = eight[np.minimum(start + 8, len(data))] & _HIGH[short] | short.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digest = xxhash.xxh3_128_digest
        found = b"".join([digest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        low[long], high[long] = np.frombuffer(found, "<u8").reshape(-1, 2).T
    return low, high


def mixed(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of a 128-bit name."""
    return mix(mix(low * _K[0]) + high * _K[1]), mix(mix(high * _K[2] + _K[0]) ^ low * _K[1])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte range."""
    return mixed(*names(data, start, end))


def grams(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of the k words from each position on, of family ``which``; the last k-1 positions have none."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_Q[which], n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def groups(offsets: np.ndarray, size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield i, j
        i = j
