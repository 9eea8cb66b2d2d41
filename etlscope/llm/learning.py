"""What the two trained scorers share: labelled documents, all or a bounded sample, and score columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import held_out

#: Bytes of the longest text that is learned from; longer ones are scored like any other.
LONGEST = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id as text, text, lang, y) of at most ``per_class`` labelled documents of each class, never held-out ones.

    The ids are chosen on the label table alone, by a hash of doc_id, and are few enough to broadcast (two times
    ``per_class``), so no text is shuffled.  A document with several labels counts as 1 if any is 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    lang = F.col("lang").cast("string") if "lang" in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    own = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"), lang.alias("lang"))
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    return own.join(chosen, own["doc_id"] == chosen["_id"].cast("string")).select("doc_id", "text", "lang", "y")


def labels_by_name(labels: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the id as text and the class, in order of the first hash, of every labelled document outside the held-out part."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("string").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    found = known.select(*id_names(F.col("_id")), F.col("y").cast("byte").alias("y")).toArrow()
    a, b, y = (found.column(i).to_numpy() for i in range(3))
    order = np.lexsort((b, a))
    return a[order], b[order], y[order]


def id_names(doc_id: Column) -> tuple[Column, Column]:
    text = doc_id.cast("string")
    return F.xxhash64(text).alias("_a"), F.xxhash64(text, F.lit("other")).alias("_b")


def classes_of(names: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The class of each document by the two hashes of its id, -1 without a label."""
    out = np.full(len(a), -1, np.int8)
    if not len(names[0]):
        return out
    at = np.searchsorted(names[0], a)
    todo = np.arange(len(a))
    while len(todo := todo[at[todo] < len(names[0])]) and len(todo := todo[names[0][at[todo]] == a[todo]]):
        hit = names[1][at[todo]] == b[todo]
        out[todo[hit]] = names[2][at[todo[hit]]]
        todo = todo[~hit]
        at[todo] += 1  # another id of the same first hash
    return out


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many labelled documents outside the held-out part have 0 and 1."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).groupBy("y").count().collect()
    found = {r["y"]: r["count"] for r in rows}
    return found.get(0, 0), found.get(1, 0)


def decided(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, 1).otherwise(0).cast("int")
