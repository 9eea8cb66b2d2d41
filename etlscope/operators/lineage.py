"""Field lineage across rules: closure of field edges down to physical sources, exchange inheritance, join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_intermediate, short_name
from ..plans.cut import cut
from ..plans.facts import SELECT_TYPES, FactTables, priority

RANKS = ("unknown", "value", "direct", "expression", "fallback", "case_when", "aggregate", "pivot", "window")


def rank_name(rank: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in RANKS]), rank + 2)


def step_edges(edges: DataFrame, step: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """(to_table, to_field, from_table, from_field, transform, step_id): field edges with short table names.

    With ``outputs`` the edges of exchange steps are added.
    """
    joined = edges.join(step.select("rule_code", "step_id", "target"), "rule_code")
    own = joined.select(short_name(F.col("target")).alias("to_table"), F.col("output").alias("to_field"), short_name(F.col("source_table")).alias("from_table"), F.col("source_field").alias("from_field"), "transform", "step_id").distinct()
    return own if outputs is None else own.unionByName(exchange_edges(outputs, step))


def exchange_edges(outputs: DataFrame, step: DataFrame) -> DataFrame:
    """Fields that an exchange step takes over, unchanged, from the staging table it swaps in; also those without sources."""
    w = step.where(F.col("rule_type").isin(*SELECT_TYPES)).select("rule_code", short_name(F.col("target")).alias("from_table"))
    fields = outputs.where("scope = 1 and branch = 0").join(w, "rule_code").select("from_table", F.col("output").alias("to_field")).distinct()
    swap = step.where("is_exchange").select("step_id", short_name(F.col("target")).alias("to_table"), short_name(F.col("exchanged")).alias("from_table"))
    return swap.join(fields, "from_table").select("to_table", "to_field", "from_table", F.col("to_field").alias("from_field"), F.lit("direct").alias("transform"), "step_id")


def physical_sources(edges: DataFrame) -> DataFrame:
    """(table, field, source_table, source_field, transform, depth): every table that no step writes, per field.

    ``edges`` as from step_edges.  Ways are doubled: pairs at most 2**n steps apart are joined with themselves, so the number of rounds grows with
    the logarithm of the longest way.  Each pair of columns is one row with the heaviest transform on any way and the length of the shortest one, so
    neither diamonds nor cycles multiply rows; rounds end when nothing changes.
    """
    written = edges.select(F.col("to_table").alias("from_table")).distinct().withColumn("inner", F.lit(True))
    key = ["table", "field", "at_table", "at_field"]
    first = edges.select(F.col("to_table").alias("table"), F.col("to_field").alias("field"), F.col("from_table").alias("at_table"), F.col("from_field").alias("at_field"), priority(F.col("transform")).alias("rank"), F.lit(1).cast("long").alias("depth"), "from_table")
    first = first.join(written, "from_table", "left").withColumn("inner", F.coalesce("inner", F.lit(False))).drop("from_table")
    merged = lambda df: df.groupBy(*key).agg(F.max("rank").alias("rank"), F.min("depth").alias("depth"), F.max("inner").alias("inner"))
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum("rank"), F.sum("depth")).first())
    pairs = cut(merged(first))
    before = mark(pairs)
    while before[0]:
        on = pairs.select(F.col("table").alias("at_table"), F.col("field").alias("at_field"), F.col("at_table").alias("n_table"), F.col("at_field").alias("n_field"), F.col("rank").alias("n_rank"), F.col("depth").alias("n_depth"), F.col("inner").alias("n_inner"))
        longer = pairs.where("inner").join(on, ["at_table", "at_field"]).select(
            "table", "field", F.col("n_table").alias("at_table"), F.col("n_field").alias("at_field"), F.greatest("rank", "n_rank").alias("rank"), (F.col("depth") + F.col("n_depth")).alias("depth"), F.col("n_inner").alias("inner")
        )
        pairs = cut(merged(pairs.unionByName(longer)))
        now = mark(pairs)
        if now == before:
            break
        before = now
    return pairs.where("not inner").select("table", "field", F.col("at_table").alias("source_table"), F.col("at_field").alias("source_field"), rank_name(F.col("rank")).alias("transform"), F.col("depth").cast("int").alias("depth"))


def producing_steps(step: DataFrame, read: DataFrame, parity: bool = False) -> DataFrame:
    """(step_id, table, producer): for each table a step reads, the step that made what it sees.

    The latest writer of a lower sequence, else the first writer at all; with ``parity`` always the first in order.
    """
    w = step.where(F.col("rule_type").isin(*SELECT_TYPES, 9)).select(short_name(F.col("target")).alias("table"), F.col("step_id").alias("producer"), F.col("step_no").alias("no"), F.col("exec_sequence").alias("seq"))
    r = read.select("step_id", "exec_sequence", short_name(F.col("source")).alias("table")).distinct()
    before = F.lit(False) if parity else F.col("seq") < F.col("exec_sequence")
    order = [before.desc(), F.when(before, -F.col("seq")), F.when(before, -F.col("no")), "no"]
    pairs = r.join(w, "table").where("producer <> step_id")
    return pairs.withColumn("rk", F.row_number().over(Window.partitionBy("step_id", "table").orderBy(*order))).where("rk = 1").select("step_id", "table", "producer")


def join_keys(facts: FactTables, step: DataFrame, parity: bool = False) -> DataFrame:
    """(step_id, table, field): columns of tables made inside the catalog that a step joins on, seen through CTEs and derived tables.

    With ``parity`` a table counts as made inside if its name says it is temporary.
    """
    keys = facts.keys.join(step.select("rule_code", "step_id"), "rule_code").select("step_id", short_name(F.col("table")).alias("table"), F.col("source_field").alias("field")).distinct()
    if parity:
        return keys.where(is_intermediate(F.col("table")))
    made = step.where(F.col("rule_type").isin(*SELECT_TYPES, 9)).select(short_name(F.col("target")).alias("table")).distinct()
    return keys.join(made, "table", "left_semi").select("step_id", "table", "field")


def join_key_lineage(keys: DataFrame, producers: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(step_id, table, field, producer, source_table, source_field, transform, depth): where the join keys come from.

    The first hop is through the producing step alone, the rest through the closure ``sources``.
    """
    hop = edges.select(F.col("step_id").alias("producer"), F.col("to_table").alias("table"), F.col("to_field").alias("field"), "from_table", "from_field", priority(F.col("transform")).alias("rank"))
    first = keys.join(producers, ["step_id", "table"]).join(hop, ["producer", "table", "field"])
    far = sources.select(F.col("table").alias("from_table"), F.col("field").alias("from_field"), "source_table", "source_field", priority(F.col("transform")).alias("far_rank"), F.col("depth").alias("far_depth"))
    made = edges.select(F.col("to_table").alias("from_table")).distinct()
    inner = first.join(far, ["from_table", "from_field"]).select("step_id", "table", "field", "producer", "source_table", "source_field", F.greatest("rank", "far_rank").alias("rank"), (F.col("far_depth") + 1).alias("depth"))
    leaf = first.join(made, "from_table", "left_anti").select("step_id", "table", "field", "producer", F.col("from_table").alias("source_table"), F.col("from_field").alias("source_field"), "rank", F.lit(1).alias("depth"))
    out = inner.unionByName(leaf).groupBy("step_id", "table", "field", "producer", "source_table", "source_field").agg(F.max("rank").alias("rank"), F.min("depth").alias("depth"))
    return out.select("step_id", "table", "field", "producer", "source_table", "source_field", rank_name(F.col("rank")).alias("transform"), "depth")


def join_relations(facts: FactTables, step: DataFrame) -> DataFrame:
    """(step_id, table, field, other_table, other_field): the equalities between tables that each step joins on."""
    rows = facts.pairs.where("table is not null and other_table is not null").join(step.select("rule_code", "step_id"), "rule_code")
    return rows.select("step_id", short_name(F.col("table")).alias("table"), "field", short_name(F.col("other_table")).alias("other_table"), "other_field").distinct()


def table_catalog(step: DataFrame, read: DataFrame, ddl: DataFrame) -> DataFrame:
    """(table, column, type, role): known columns of all tables that steps write, swap or read."""
    names = step.select(short_name(F.col("target")).alias("table"), F.lit("target").alias("role")).unionByName(step.where("is_exchange").select(short_name(F.col("exchanged")).alias("table"), F.lit("exchange").alias("role")))
    names = names.unionByName(read.select(short_name(F.col("source")).alias("table"), F.lit("source").alias("role"))).groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("role")), "/").alias("role"))
    return ddl.select("table", F.lower("column").alias("column"), "type").distinct().join(names, "table").select("table", "column", "type", "role")


def typed_fields(outputs: DataFrame, step: DataFrame, ddl: DataFrame) -> DataFrame:
    """(rule_code, field, transform, type): output fields with the type of their target column, null where unknown."""
    own = outputs.where("scope = 1 and branch = 0").join(step.select("rule_code", short_name(F.col("target")).alias("table")), "rule_code")
    types = ddl.select("table", F.lower("column").alias("field"), "type").dropDuplicates(["table", "field"])
    return own.select("rule_code", "table", F.col("output").alias("field"), "transform").join(types, ["table", "field"], "left").select("rule_code", "field", "transform", "type")
