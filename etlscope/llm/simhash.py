"""SimHash votes as plain aggregates, and permuted block tables for Hamming search (no Python on executors).

A 64-bit term hash votes on every bit.  Instead of 64 counters, two bits share a 64-bit sum: shifting the hash by
j and masking with 0x0000000100000001 leaves bits j and j+32 in separate 32-bit lanes, so 32 sums hold all votes
exactly as long as a document's total weight stays below 2**32.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote_columns(h: Column, weight: Column | None = None) -> list[Column]:
    """32 sums of votes and the total weight ``votes_n``."""
    one = F.when(h.isNotNull(), weight if weight is not None else F.lit(1)).otherwise(0).cast("long")
    out = []
    for j in range(32):
        bits = F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0000000100000001))
        out.append(F.sum(bits if weight is None else bits * one).alias(f"votes_{j}"))
    return [*out, F.sum(one).alias("votes_n")]


def vote_fingerprint() -> Column:
    """The fingerprint of summed votes: a bit is 1 if it got over half of the weight; zero without terms."""
    total = F.coalesce(F.col("votes_n"), F.lit(0))
    value = F.lit(0).cast("long")
    for j in range(32):
        lanes = F.coalesce(F.col(f"votes_{j}"), F.lit(0).cast("long"))
        for bit, votes in ((j, lanes.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(lanes, 32))):
            constant = (1 << bit) - (1 << 64 if bit == 63 else 0)
            value = value.bitwiseOR(F.when(votes * 2 > total, F.lit(constant).cast("long")).otherwise(F.lit(0).cast("long")))
    return value


def hex16(fingerprint: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n nearly equal blocks of 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_value(fingerprint: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1))


def block_tables(fingerprint: Column, radius: int, n_blocks: int) -> Column:
    """Array of (table, key): one permuted table for each choice of ``n_blocks - radius`` leading blocks.

    Two fingerprints that differ in at most ``radius`` bits agree on all bits of at least ``n_blocks - radius``
    blocks, so they share the key of at least one table.
    """
    parts = blocks(n_blocks)
    out = []
    for t, chosen in enumerate(combinations(range(n_blocks), n_blocks - radius)):
        key, shift = F.lit(0).cast("long"), 0
        for b in chosen:
            first, width = parts[b]
            key = key.bitwiseOR(F.shiftleft(block_value(fingerprint, first, width), shift))
            shift += width
        out.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*out)


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, n_blocks: int = 6) -> DataFrame:
    """All (query_fp, fp) pairs of distinct fingerprints at Hamming distance ``radius`` or less, equal ones included.

    ``queries(fp)`` and ``fingerprints(fp)`` hold distinct non-null values.  Copies never multiply pairs, since
    both sides are classes of equal fingerprints.  A pair that several tables find is kept by the first of them.
    """
    left = queries.select(F.col("fp").alias("query_fp"), F.explode(block_tables(F.col("fp"), radius, n_blocks)).alias("x")).select("query_fp", "x.t", "x.key")
    right = fingerprints.select("fp", F.explode(block_tables(F.col("fp"), radius, n_blocks)).alias("x")).select("fp", "x.t", "x.key")
    near = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))) <= radius
    first, parts, difference = F.lit(None).cast("int"), blocks(n_blocks), F.col("query_fp").bitwiseXOR(F.col("fp"))
    for t, chosen in reversed(list(enumerate(combinations(range(n_blocks), n_blocks - radius)))):
        mask = sum(((1 << w) - 1) << a for a, w in (parts[b] for b in chosen))
        mask -= (1 << 64) * (mask >> 63)
        first = F.when(difference.bitwiseAND(F.lit(mask).cast("long")) == 0, F.lit(t)).otherwise(first)
    return left.join(right.hint("merge"), ["t", "key"]).where(near & (F.col("t") == first)).select("query_fp", "fp")
