"""Mixing sources to target weights by iterative proportional fitting (raking).

Each document has a cell: source, language and topic.  Token sums per cell are raked until the weighted sums meet the
target share of every source, every language and every topic; a document's sampling probability is its cell's weight
times a common rate, 1 at most, with the rate solved so that the expected tokens meet the budget.  A document is
drawn if a uniform number made from its id lies below its probability, so runs repeat and order does not matter.

Unless given, targets are the corpus's own token shares, tempered (raised to ``SOURCE_POWER``/``LANG_POWER``/
``TOPIC_POWER`` and normalised), and a topic is the bucket of the hashed vocabulary (words of 7 bytes or more, 8
buckets) from which most of a document's words come.

Text never leaves its task: only cells are shuffled, after map-side sums.  Up to ``MAX_CELLS`` cells (a few MB) are
raked on the driver and joined back by broadcast; more are raked as a DataFrame, written in every sweep.  Both stop at
``TOLERANCE`` or after ``SWEEPS``, and warn if targets are then not met.

Edge cases: null source or language is a category of its own; empty and null texts have no tokens, topic 0 and their
cell's probability (the common rate where the cell has no tokens); rows of equal id share their fate; targets for
absent categories are spread over the present ones; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .util import find, fresh, materialize

TOPICS, TOPIC_BYTES = 8, 7
SOURCE_POWER, LANG_POWER, TOPIC_POWER = 0.7, 0.8, 0.5
KEEP_SHARE = 0.8
MAX_CELLS = 20_000
SWEEPS, TOLERANCE = 200, 1e-9
DIMENSIONS = ("_mix_source", "_mix_lang", "_mix_topic")
POWERS = dict(zip(DIMENSIONS, (SOURCE_POWER, LANG_POWER, TOPIC_POWER), strict=True))
NONE = "\x00none"


def added(docs: DataFrame) -> dict[str, str]:
    """Names for the columns that mixing adds, which ``docs`` does not have; their own unless taken."""
    return {n: fresh(docs, n) for n in ("_mix_tokens", *DIMENSIONS, "_mix_weight", "_mix_probability", "_mix_selected")}


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with the token count and the three cell columns added, named as in ``added``; nothing is shuffled."""
    place, names, bucket = docs.columns.index(find(docs, "text")), added(docs), fresh(docs, "_mix_bucket")

    def run(batches):
        for batch in batches:
            data, offsets = tb.buffers(batch.column(place))
            counts, topics = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for i, j in tb.groups(offsets):
                words = tb.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tb.space_class())
                long = words.end - words.start >= TOPIC_BYTES
                votes = np.bincount(words.doc[long] * TOPICS + (words.hash[long] >> np.uint64(61)).astype(np.int64), minlength=TOPICS * (j - i))
                counts.append(words.count())
                topics.append(votes.reshape(j - i, TOPICS).argmax(1).astype(np.int32))
            new = [pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(topics), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, names["_mix_tokens"], bucket])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names["_mix_tokens"], T.LongType()), T.StructField(bucket, T.IntegerType())]))
    has = {c.lower() for c in docs.columns}
    column = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(NONE)) if name in has else F.lit(NONE)
    values = (column("source"), column("lang"), F.coalesce(topic.cast("string"), F.lit(NONE)) if topic is not None else F.col(bucket).cast("string"))
    return out.withColumns({names[d]: v for d, v in zip(DIMENSIONS, values, strict=True)}).drop(bucket)


def tempered(sums: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in sums.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(codes: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], sweeps: int | None = None) -> tuple[np.ndarray, float]:
    """Cell weights whose token sums have the target shares of each dimension, and the largest error left.

    codes: cells x dimensions; targets: shares by code.
    """
    weight, total, error = np.ones(len(tokens)), max(tokens.sum(), 1e-300), 0.0
    for _ in range(sweeps or SWEEPS):
        error = 0.0
        for d, share in enumerate(targets):
            have = np.bincount(codes[:, d], tokens * weight, len(share)).astype(float)
            ratio = np.divide(share * total, have, out=np.ones_like(have), where=have > 0)
            error = max(error, float(np.abs(have / total - share)[have > 0].max(initial=0)))
            weight = weight * ratio[codes[:, d]]
        if error < TOLERANCE:
            break
    return weight, error


def report(error: float) -> None:
    """Warn of targets that raking did not meet."""
    if error >= TOLERANCE:
        warnings.warn(f"raking stopped after {SWEEPS} sweeps with marginal shares off by up to {error:.3g}", stacklevel=2)


def common_rate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """The rate for which the sum of tokens * min(1, rate * weight) is the budget; exact, by sorting."""
    live = (tokens > 0) & (weight > 0)
    t, w = tokens[live], weight[live]
    if not len(t) or budget >= t.sum():
        return float(1 / w.min()) if len(w) else 1.0
    order = np.argsort(-w)
    t, w = t[order], w[order]
    full = np.concatenate([[0.0], np.cumsum(t)])  # tokens of cells already at probability 1
    open_ = np.concatenate([np.cumsum((t * w)[::-1])[::-1], [0.0]])
    for i in range(len(t)):
        rate = (budget - full[i]) / open_[i]
        if rate * w[i] <= 1:
            return float(rate)
    return float(1 / w[-1])


def _driver_plan(cells: list, targets: dict[str, dict[str, float]] | None, keep_share: float) -> list[tuple]:
    tokens = np.array([float(c["tokens"]) for c in cells])
    codes, shares = np.zeros((len(cells), 3), np.int64), []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[name] for c in cells})
        index = {v: i for i, v in enumerate(values)}
        codes[:, d] = [index[c[name]] for c in cells]
        sums = dict(zip(values, np.bincount(codes[:, d], tokens, len(values)), strict=True))
        wanted = (targets or {}).get(name) or tempered(sums, POWERS[name])
        share = np.array([wanted.get(v, 0.0) if sums[v] > 0 else 0.0 for v in values])
        shares.append(share / share.sum() if share.sum() else share)
    weight, error = rake(codes, tokens, shares)
    report(error)
    rate = common_rate(tokens, weight, keep_share * tokens.sum())
    p = np.minimum(1, rate * np.where(tokens > 0, weight, 1.0))
    return [(*[c[n] for n in DIMENSIONS], float(w), float(x)) for c, w, x in zip(cells, weight, p, strict=True)]


def _table_rate(live: DataFrame, budget: float) -> float:
    """common_rate of (tokens, weight) as a DataFrame: each step puts more cells at probability 1, until none is added."""
    tokens, least = live.agg(F.sum("tokens"), F.min("weight")).first()
    if tokens is None or budget >= tokens:
        return 1 / least if least else 1.0
    rate, at_one = 0.0, -1
    while True:
        sure = rate * F.col("weight") > 1
        n, full, open_ = live.agg(F.count_if(sure), F.sum(F.when(sure, F.col("tokens"))), F.sum(F.when(~sure, F.col("tokens") * F.col("weight")))).first()
        if n == at_one or not open_:
            return rate
        rate, at_one = (budget - (full or 0)) / open_, n


def _table_plan(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep_share: float, sweeps: int | None = None) -> DataFrame:
    """The same as a DataFrame, for any number of cells."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {}
    for name in DIMENSIONS:
        if targets and targets.get(name):
            share = spark.createDataFrame(list(targets[name].items()), f"{name} string, share double")
            share = cells.groupBy(name).agg(F.sum("tokens").alias("t")).where("t > 0").join(share, name, "left").select(name, F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            share = cells.groupBy(name).agg(F.sum("tokens").alias("t")).where("t > 0").select(name, F.pow("t", F.lit(POWERS[name])).alias("share"))
        mass = share.agg(F.sum("share")).first()[0] or 1.0
        wanted[name] = materialize(share.select(name, (F.col("share") / mass).alias("share")), "targets")
    plan, error = cells.withColumn("weight", F.lit(1.0)), 0.0
    offs = [f"off_{d}" for d in range(len(DIMENSIONS))]
    for _ in range(sweeps or SWEEPS):
        plan = plan.drop(*offs)
        for name, off in zip(DIMENSIONS, offs, strict=True):
            have = plan.groupBy(name).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have")).join(wanted[name], name)
            have = have.where("have > 0").select(name, (F.col("share") * total / F.col("have")).alias("ratio"), F.abs(F.col("have") / total - F.col("share")).alias(off))
            plan = plan.join(have, name, "left").withColumn("weight", F.col("weight") * F.coalesce("ratio", F.lit(1.0))).drop("ratio")
        plan = materialize(plan, "raked")  # one write a sweep; its rows carry how far each marginal was off
        error = plan.agg(F.max(F.greatest(*[F.coalesce(o, F.lit(0.0)) for o in offs]))).first()[0] or 0.0
        if error < TOLERANCE:
            break
    report(error)
    rate = _table_rate(plan.where("tokens > 0 and weight > 0"), keep_share * total)
    return plan.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), rate * F.when(F.col("tokens") > 0, F.col("weight")).otherwise(1.0)).alias("probability"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_share: float = KEEP_SHARE, topic: Column | None = None, seed: int = 8, max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` with _mix_tokens, the cell columns, _mix_weight, _mix_probability and _mix_selected added (see ``added``).

    targets: ``{"_mix_source": {name: share}, "_mix_lang": ..., "_mix_topic": ...}``, each optional.
    """
    celled, names, has = with_cells(docs, topic), added(docs), {c.lower() for c in docs.columns}
    slim = with_cells(docs.select("text", *[c for c in ("source", "lang") if c in has]), topic) if topic is None else celled
    own = names if topic is not None else dict(zip(names, names, strict=True))
    cells = slim.groupBy(*[F.col(own[d]).alias(d) for d in DIMENSIONS]).agg(F.sum(own["_mix_tokens"]).alias("tokens"))
    head = cells.limit(max_cells + 1).collect() if max_cells else []
    if max_cells and len(head) <= max_cells:
        rows = _driver_plan(sorted(head, key=lambda r: tuple(r)[:3]), targets, keep_share)
        plan = F.broadcast(docs.sparkSession.createDataFrame(rows, "_mix_source string, _mix_lang string, _mix_topic string, weight double, probability double"))
    else:
        plan = _table_plan(materialize(cells, "cells"), targets, keep_share)
    joined = celled.join(plan, [celled[names[d]] == plan[d] for d in DIMENSIONS])
    uniform = F.shiftrightunsigned(F.xxhash64(celled["doc_id"], F.lit(seed)), 11) / F.lit(float(1 << 53))
    return joined.select(
        *[celled[c] for c in celled.columns], plan["weight"].alias(names["_mix_weight"]), plan["probability"].alias(names["_mix_probability"]), (uniform < plan["probability"]).alias(names["_mix_selected"])
    )


def query(docs: DataFrame) -> DataFrame:
    has = {c.lower() for c in docs.columns}
    out = mixed(docs.select("doc_id", "text", *[c for c in ("source", "lang") if c in has]))
    plain = lambda n: F.when(F.col(n) != NONE, F.col(n))
    return out.select(
        "doc_id", plain("_mix_source").alias("source"), plain("_mix_lang").alias("lang"), F.col("_mix_topic").cast("int").alias("topic"), F.col("_mix_tokens").alias("n_tokens"),
        F.col("_mix_weight").alias("weight"), F.col("_mix_probability").alias("probability"), F.col("_mix_selected").alias("selected"),
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns."""
    return mixed(docs, **options).where(F.col(added(docs)["_mix_selected"])).select(*docs.columns)
