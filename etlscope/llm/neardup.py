"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 3-word shingles of the lower-cased text, XXH64 with seed 42, a bit set where over half of the
shingles set it.  Copies collapse into classes of equal fingerprints first, so nothing is ever paired within a
group of copies.

Links at Hamming distance tau or less, on the ring of m segments: if the segment differences sum to at most tau,
some segment i exists from which every chain of l consecutive segments (cyclically) differs in at most l*tau/m
bits.  Chains whose budget is below one bit must be equal, so the first ceil(m/tau)-1 segments from i are the join
key; longer chains prune candidates before the full Hamming check.

A key shared by more than ``CROWD`` distinct fingerprints is not paired.  Its members go another exact way: two
fingerprints differ in at most 2k bits exactly if some value is at distance k or less from both, so each member visits
the values around it (65 for a radius of 2) and all visitors of one value are linked to the least of them.  For a radius of 2k+1 one of
the bits that differ is left out of the values, each bit in turn.  Work is thus linear in the number of distinct
fingerprints, however dense a cluster is.  Both ways give the same components; radii go up to 4.

Edge cases: null text is empty; a text without words has fingerprint zero and links like any other; fewer words
than a shingle make one shingle of the whole; repeated rows and repeated ids stay separate rows; a null doc_id never
names a component unless its members have no id at all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .simhash import block_value, blocks, hex16, vote_columns, vote_fingerprint
from .util import ascii_lower, fresh, materialize, words

SHINGLE, RADIUS, SEGMENTS, CROWD = 3, 2, 5, 128


def fingerprints(docs: DataFrame, k: int = SHINGLE, rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, text_hash, fp) per row; the shuffle carries one row of sums per document."""
    rid = rid if rid is not None else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(ascii_lower(F.col("text"))).alias("w"))
    n = F.size("w") - (k - 1)
    names = [f"w{i}" for i in range(k)]
    zipped = F.arrays_zip(*[F.slice("w", F.lit(i + 1), F.greatest(n, F.lit(0))).alias(name) for i, name in enumerate(names)])
    whole = F.array(F.struct(F.concat_ws(" ", "w").alias("w0"), *[F.lit(None).cast("string").alias(x) for x in names[1:]]))
    shingles = F.when(n >= 1, zipped).when(F.size("w") > 0, whole)
    long = rows.select("rid", "doc_id", "text_hash", F.explode_outer(shingles).alias("s"))
    hashed = long.select("rid", "doc_id", "text_hash", F.when(F.col("s").isNotNull(), F.xxhash64(F.concat_ws(" ", *[f"s.{x}" for x in names]))).alias("h"))
    votes = hashed.groupBy("rid", "doc_id", "text_hash").agg(*vote_columns(F.col("h")))
    return votes.select("rid", "doc_id", "text_hash", vote_fingerprint().alias("fp"))


def _chains(difference: Column, i: int, radius: int, segments: int) -> Column:
    """Whether each chain from segment i on keeps within its share of the radius."""
    parts = blocks(segments)
    total, ok = F.lit(0), F.lit(True)
    for length in range(1, segments + 1):
        total = total + F.bit_count(block_value(difference, *parts[(i + length - 1) % segments]))
        ok = ok & (total <= F.lit(length * radius // segments))
    return ok


def pigeonring_links(classes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all distinct ``classes.fp`` at Hamming distance ``radius`` or less.

    Cold keys give every pair; crowded keys give star edges with the same components.
    """
    if not 1 <= radius <= min(4, segments - 1):
        raise ValueError("radius must be from 1 to 4 and below the number of segments")
    parts = blocks(segments)
    exact = -(-segments // radius) - 1  # chains so long have a budget below one bit
    tables = []
    for i in range(segments):
        key, shift = F.lit(0).cast("long"), 0
        for s in range(exact):
            first, width = parts[(i + s) % segments]
            key = key.bitwiseOR(F.shiftleft(block_value(F.col("fp"), first, width), shift))
            shift += width
        tables.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
    rows = classes.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.i", "x.key")
    sizes = rows.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialize(rows.join(sizes, ["i", "key"]), "segments")
    cold = keyed.where(F.col("n") <= crowd)
    difference = F.col("a").bitwiseXOR(F.col("b"))
    ring = F.lit(False)
    for i in range(segments):
        ring = ring | ((F.col("i") == i) & _chains(difference, i, radius, segments))
    pairs = (
        cold.select("i", "key", F.col("fp").alias("a"))
        .join(cold.select("i", "key", F.col("fp").alias("b")), ["i", "key"])
        .where((F.col("a") < F.col("b")) & ring & (F.bit_count(difference) <= radius))
        .select("a", "b")
    )
    crowded = keyed.where(F.col("n") > crowd).select("fp").distinct()
    return pairs.unionByName(_ball_links(crowded, radius)).distinct()


def _flips(bits: int) -> Column:
    """Array of all 64-bit values with at most ``bits`` (0 to 2) bits set."""
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    out = F.array(F.lit(0).cast("long"))
    if bits >= 1:
        out = F.concat(out, F.transform(F.sequence(F.lit(0), F.lit(63)), one))
    if bits >= 2:
        pairs = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda a: F.transform(F.sequence(F.lit(0), a - 1), lambda b: one(a) + one(b)))
        out = F.concat(out, F.flatten(pairs))
    return out


def _ball_links(members: DataFrame, radius: int) -> DataFrame:
    """Star edges among fingerprints that are both near some value; exact."""
    around = members.select("fp", F.explode(_flips(radius // 2)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), F.lit(-1).alias("bit"))
    if radius % 2:  # one of the bits in which both differ does not count: each bit in turn is cleared
        around = around.select("fp", "z", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        around = around.select("fp", F.col("z").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))).alias("z"), "bit").distinct()
    met = around.groupBy("z", "bit").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # as many as are within the radius of one value
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS, crowd: int = CROWD, rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, fp, component_id, keep) per row of ``docs(doc_id, text)``.

    component_id is the least doc_id reachable over links, the row's own included; keep marks one row of each
    component, the first by (doc_id, position).  ``rid``: a column that numbers the rows, if there is one.
    """
    prints = materialize(fingerprints(docs, k, rid), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("rid"))).alias("first")
    classes = materialize(prints.groupBy("fp").agg(first), "classes")
    roots = connected(pigeonring_links(classes.select("fp"), radius, segments, crowd))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = joined.groupBy("root").agg(F.min("first").alias("best"))
    placed = joined.join(best, "root").select("fp", "best")
    return prints.join(placed, "fp").select("rid", "doc_id", "fp", F.col("best.doc_id").alias("component_id"), (F.col("rid") == F.col("best.rid")).alias("keep"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a row number, and the name of that column."""
    rid = fresh(docs, "rid")
    return materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered"), rid


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that near_duplicates keeps: one of each group.  Texts are shuffled once at most."""
    own, rid = numbered(docs)
    kept = near_duplicates(own, rid=F.col(rid), **options).where("keep").select(F.col("rid").alias(rid))
    return own.join(kept, rid, "left_semi").select(*docs.columns)
