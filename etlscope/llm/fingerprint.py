"""Document fingerprints: weighted SimHash, and its use on edited texts; DataFrame functions only.

Terms are pairs of neighbouring words (a one-word text: the word).  A pair's weight is its length in bytes, at most
``MOST_WEIGHT``, so pairs of short function words count less; each occurrence votes, with its weight, on the 64 bits of
the term's hash.  Near fingerprints are found with permuted block tables (see simhash.within_radius).

Neighbours in doc_id order need no global sort: the rows are cut into ranges of doc_id at values that occur, the row
at the upper end of each range is copied to the range above as a helper, and one shuffle by range serves the
neighbour's text, the votes and the neighbour's fingerprint.

Edge cases: null text is empty; a text without words has fingerprint zero; rows of equal doc_id are ordered by text;
null doc_ids come last in descending order; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simhash import hex16, likeness, vote_columns, vote_fingerprint, within_radius
from .util import materialize, words

MOST_WEIGHT = 24
RADIUS = 3
MOST_RANGES = 20_000
QUERY_EVERY = 50


def with_votes(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, fp) of each row; rows are told apart by ``key`` and stay in their partition if it is partitioned so."""
    split = rows.select(*key, words(F.col(text)).alias("w"))
    n = F.size("w")
    first = F.slice("w", F.lit(1), F.greatest(n - 1, F.lit(1)))
    second = F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(0)))
    terms = split.select(*key, F.explode_outer(F.arrays_zip(first.alias("a"), second.alias("b"))).alias("t"))
    a, b = F.col("t.a"), F.col("t.b")
    weight = F.least(F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0)), F.lit(MOST_WEIGHT))
    hashed = terms.select(*key, F.when(a.isNotNull(), F.xxhash64(a, b)).alias("h"), F.when(a.isNotNull(), weight).otherwise(0).alias("weight"))
    votes = hashed.groupBy(*key).agg(*vote_columns(F.col("h"), F.col("weight")))
    return votes.select(*key, vote_fingerprint().alias("fp"))


def ranges(docs: DataFrame) -> tuple[list[int], int | None]:
    """Ascending doc_ids that end ranges, each of which occurs, and the greatest doc_id."""
    row = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    n = min(MOST_RANGES, row[0] // 50, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2:
        return [], row[1]
    cuts = F.percentile_approx("doc_id", F.split(F.lit(",".join(str(i / n) for i in range(1, n))), ",").cast("array<double>"), F.lit(max(10_000, 10 * n)))
    found = docs.agg(cuts.alias("cuts")).first()[0]
    return sorted({c for c in found if c != row[1]}), row[1]


def range_number(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts lie below doc_id, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) < doc_id, at + s).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """(part, rn, helper, doc_id, text, next_text): each row with the text of the next by descending doc_id."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts, greatest = ranges(own.select("doc_id"))
    part = range_number(F.col("doc_id"), cuts)
    copies = [F.struct(part.alias("part"), F.lit(False).alias("helper"))]
    above = F.when(F.array_contains(F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), F.col("doc_id")), part + 1) if cuts else F.lit(None).cast("int")
    around = F.when(F.col("doc_id").eqNullSafe(F.lit(greatest)), F.lit(0))
    copies += [F.struct(above.alias("part"), F.lit(True).alias("helper")), F.struct(around.alias("part"), F.lit(True).alias("helper"))]
    placed = own.select("doc_id", "text", F.explode(F.filter(F.array(*copies), lambda c: c["part"].isNotNull())).alias("c")).select("doc_id", "text", "c.part", "c.helper")
    order = Window.partitionBy("part").orderBy("helper", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return placed.select("part", F.row_number().over(order).alias("rn"), "helper", "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) per row of ``docs(doc_id, text)``."""
    rows = with_next(docs).select("part", "rn", "helper", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    both = rows.select(
        "part", "rn", "helper", "doc_id", "n_chars", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("x"),
    ).select("part", "rn", "helper", "doc_id", "n_chars", "sha", "x.which", "x.body")
    key = ["part", "rn", "helper", "doc_id", "n_chars", "sha"]
    prints = with_votes(both, [*key, "which"], "body")
    paired = prints.groupBy(*key).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    order = Window.partitionBy("part").orderBy("rn")
    out = paired.select("helper", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fp", "edited_fp", F.lead("fp").over(order).alias("next_fp"))
    return out.where(~F.col("helper")).drop("helper")


def near_counts(prints: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near): for the fingerprints of rows with ``asked``, how many rows lie within the radius, themselves included."""
    classes = prints.groupBy("fp").agg(F.count("*").alias("n"))
    queries = prints.where(asked).select("fp").distinct()
    pairs = within_radius(queries, classes.select("fp"), radius)
    return pairs.join(classes.hint("merge"), "fp").groupBy(F.col("query_fp").alias("fp")).agg(F.sum("n").alias("n_near"))


def query(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and edited texts; n_near for every row whose doc_id is divisible by 50."""
    base = materialize(fingerprinted(docs), "fingerprints")
    asked = F.col("doc_id") % QUERY_EVERY == 0
    near = near_counts(base.select("doc_id", "fp"), asked)
    joined = base.join(near.hint("merge"), "fp", "left")  # both sides grow with the corpus: never broadcast
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asked, F.col("n_near") - 1).alias("n_near"),
    )
