"""Steps, schedule, dependencies between writers and readers, write groups, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import full_name, is_intermediate, layer, short_name
from ..plans.facts import SELECT_TYPES, FactTables, step_tables

PARTITION_MODES = ("3", "5")


def steps(rules: DataFrame) -> DataFrame:
    """(step_id, step_no, rule_code, rule_type, exec_sequence, target, written, is_exchange, ...), in input order.

    An exchange (type 9) writes its exchange_source_table from the table it names as target.
    """
    kept = rules.where(F.col("rule_type").isin(*SELECT_TYPES, 2, 9))
    order = Window.orderBy("row_ord")  # rules of one catalog: thousands of rows
    exchange = F.col("rule_type") == 9
    own = full_name(F.col("target_schema"), F.col("target_table"))
    return kept.withColumn("step_no", F.row_number().over(order)).select(
        F.concat(F.lit("step_"), F.col("step_no").cast("string")).alias("step_id"), "step_no", "rule_code", "rule_type", "exec_sequence",
        F.when(exchange, F.lower("exchange_source_table")).otherwise(own).alias("target"), F.when(exchange, own).alias("exchanged"), exchange.alias("is_exchange"),
        "delete_mode", "delete_condition", F.coalesce("rule_group_code", F.concat(F.lit("_SOLO_"), F.col("rule_code"))).alias("group_code"), "is_view_step", "query_sql",
    )


def schedule(step: DataFrame) -> DataFrame:
    """(group_code, exec_sequence, steps): steps of each sequence, in order, comma-joined."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step_id"))), lambda x: x["step_id"])
    return step.groupBy("group_code", "exec_sequence").agg(F.array_join(ids, ",").alias("steps"), F.count("*").alias("n_steps"))


def reads(facts: FactTables, step: DataFrame) -> DataFrame:
    """(step_id, step_no, exec_sequence, source): tables that each step reads."""
    return step_tables(facts).join(step.select("rule_code", "step_id", "step_no", "exec_sequence", "target", "rule_type"), "rule_code").withColumnRenamed("name", "source")


def target_tables(step: DataFrame) -> DataFrame:
    """(written, k): the tables that steps write, with their short names."""
    return step.select(F.col("target").alias("written"), short_name(F.col("target")).alias("k")).distinct()


def dependencies(step: DataFrame, read: DataFrame) -> DataFrame:
    """(from_step, to_step, table, kind): writer to reader by short table name, and staging writer to exchange."""
    w = step.where(F.col("rule_type").isin(*SELECT_TYPES)).select(F.col("step_id").alias("from_step"), F.col("target").alias("written"))
    w = w.withColumn("k", short_name(F.col("written")))
    data = read.withColumn("k", short_name(F.col("source"))).join(w, "k").where("from_step <> step_id")
    data = data.select("from_step", F.col("step_id").alias("to_step"), F.col("source").alias("table"), F.lit("data").alias("kind"))
    swap = step.where("is_exchange").withColumn("k", short_name(F.col("exchanged"))).join(w, "k").where("from_step <> step_id")
    swap = swap.select("from_step", F.col("step_id").alias("to_step"), F.col("exchanged").alias("table"), F.lit("exchange").alias("kind"))
    return data.unionByName(swap).distinct()


def delete_before_write(step: DataFrame, known: DataFrame) -> DataFrame:
    """Delete rule to each later writer of the same table, unless that edge exists."""
    d = step.where("rule_type = 2").select(F.col("step_id").alias("from_step"), F.col("exec_sequence").alias("seq_d"), F.col("target").alias("t"))
    w = step.where(F.col("rule_type").isin(*SELECT_TYPES)).select(F.col("step_id").alias("to_step"), F.col("exec_sequence").alias("seq_w"), F.col("target").alias("table"))
    pairs = d.join(w, short_name(F.col("t")) == short_name(F.col("table"))).where("seq_w > seq_d")
    return pairs.select("from_step", "to_step", "table", F.lit("delete_before_write").alias("kind")).join(known.select("from_step", "to_step"), ["from_step", "to_step"], "left_anti")


def self_references(step: DataFrame, read: DataFrame) -> DataFrame:
    """(step_id, table, pattern): steps whose own SQL reads their target; EXISTS, IN or FROM."""
    own = read.where((F.col("rule_type") != 2) & (short_name(F.col("source")) == short_name(F.col("target"))))
    text = F.upper("query_sql")
    pattern = F.when(F.contains(text, F.lit("EXISTS")), "EXISTS").when(text.rlike(r"\bIN\s*\("), "IN").otherwise("FROM")
    return own.join(step.select("step_id", "query_sql"), "step_id").select("step_id", F.col("target").alias("table"), pattern.alias("pattern")).distinct()


def implicit_dependencies(step: DataFrame, read: DataFrame, selfs: DataFrame, known: DataFrame) -> DataFrame:
    """(from_step, to_step, table, kind): order that no known edge states.

    reader: all writers of a table to a step of a later sequence that reads it, unless any known edge ends at that step.
    self: earlier writers of a table to a writer that reads it; writer: earlier writers to a later one; both unless a known edge
    from one of the earlier writers ends there.
    """
    w = step.where(F.col("rule_type").isin(*SELECT_TYPES)).select(F.col("step_id").alias("from_step"), F.col("exec_sequence").alias("seq"), F.col("target").alias("table"), short_name(F.col("target")).alias("k"))
    last = w.groupBy("k").agg(F.max("seq").alias("last"))
    r = read.select(F.col("step_id").alias("to_step"), F.col("exec_sequence").alias("to_seq"), short_name(F.col("source")).alias("k")).distinct()
    r = r.join(last, "k").where("to_seq > last").join(w.select(F.col("from_step").alias("to_step"), "k"), ["to_step", "k"], "left_anti")
    r = r.join(known.select("to_step").distinct(), "to_step", "left_anti")
    readers = r.join(w, "k").select("from_step", "to_step", "table", F.lit("reader").alias("kind"))
    later = w.select(F.col("from_step").alias("to_step"), F.col("seq").alias("to_seq"), "table")
    pairs = w.join(later, "table").where("seq < to_seq").select("from_step", "to_step", "table")
    stated = pairs.join(known.select("from_step", "to_step").distinct(), ["from_step", "to_step"]).select("to_step", "table").distinct()
    open_ = pairs.join(stated, ["to_step", "table"], "left_anti")
    own = selfs.select(F.col("step_id").alias("to_step"), "table", F.lit(True).alias("own")).distinct()
    writers = open_.join(own, ["to_step", "table"], "left").select("from_step", "to_step", "table", F.when(F.col("own"), "self").otherwise("writer").alias("kind"))
    return readers.unionByName(writers)


def write_groups(step: DataFrame, selfs: DataFrame) -> DataFrame:
    """(table, steps, pattern) of tables with several writers."""
    w = step.where(F.col("rule_type").isin(*SELECT_TYPES)).join(selfs.select("step_id", F.lit(True).alias("own")).distinct(), "step_id", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step_id"))), lambda x: x["step_id"])
    g = w.groupBy(F.col("target").alias("table")).agg(F.count("*").alias("n_writers"), F.count_distinct("exec_sequence").alias("n_seq"), F.max(F.coalesce("own", F.lit(False))).alias("own"), F.array_join(ids, ",").alias("steps"))
    pattern = F.when(F.col("n_seq") == 1, "parallel").when(F.col("own"), "parallel_then_serial_with_self_ref").otherwise("parallel_then_serial")
    return g.where("n_writers > 1").select("table", "n_writers", "steps", pattern.alias("pattern"))


def over_constraints(step: DataFrame, edges: DataFrame) -> DataFrame:
    """(step_id, n_waits, n_needed): steps whose sequence makes them wait for steps they do not need.

    Waits are counted by running sums over the sequences of a group, so steps are never paired with all those before them.
    """
    level = step.groupBy("group_code", "exec_sequence").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group_code").orderBy("exec_sequence").rowsBetween(Window.unboundedPreceding, -1)
    waits = step.join(level.select("group_code", "exec_sequence", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_waits")), ["group_code", "exec_sequence"])
    own = step.select(F.col("step_id").alias("to_step"), "group_code", F.col("exec_sequence").alias("seq"))
    other = step.select(F.col("step_id").alias("from_step"), "group_code", F.col("exec_sequence").alias("seq_b"))
    real = edges.select("from_step", "to_step").distinct().join(own, "to_step").join(other, ["from_step", "group_code"]).where("seq_b < seq")
    real = real.groupBy(F.col("to_step").alias("step_id")).agg(F.count("*").alias("n_needed"), F.min((F.col("seq_b") == F.col("seq") - 1).cast("int")).alias("all_near"))
    g = waits.join(real, "step_id", "left").select("step_id", "n_waits", F.coalesce("n_needed", F.lit(0)).alias("n_needed"), "all_near")
    return g.where("n_needed < n_waits and (n_needed = 0 or all_near = 0)").select("step_id", "n_waits", "n_needed")


def scenarios(step: DataFrame) -> DataFrame:
    """(step_id, group_code, scenario): partition-mode steps by condition where a group has several, else default/common."""
    parted = F.col("delete_mode").isin(*PARTITION_MODES) & (F.coalesce(F.trim("delete_condition"), F.lit("")) != "")
    tagged = step.withColumn("cond", F.when(parted, F.trim("delete_condition")))
    n = tagged.groupBy("group_code").agg(F.count_distinct("cond").alias("n"))
    out = F.when(F.col("n") <= 1, "default").when(F.col("cond").isNull(), "common").otherwise(F.col("cond"))
    return tagged.join(n, "group_code").select("step_id", "group_code", out.alias("scenario"))


def table_roles(step: DataFrame, read: DataFrame) -> DataFrame:
    """(table, role, layer): target, intermediate or source; a written table is never a source."""
    w = step.select(F.col("target").alias("table"))
    r = read.select(F.col("source").alias("table"))
    inter = is_intermediate(F.col("table"))
    written = w.distinct().select("table", F.when(inter, "intermediate").otherwise("target").alias("role"))
    only = r.distinct().join(w.distinct().select(short_name(F.col("table")).alias("k")).distinct(), short_name(F.col("table")) == F.col("k"), "left_anti")
    return written.unionByName(only.select("table", F.lit("source").alias("role"))).withColumn("layer", layer(F.col("table")))


def load_strategy(rules: DataFrame) -> DataFrame:
    """(group_code, rule_code, delete_mode, strategy) by the last final, non-view rule of each group."""
    final = rules.where(F.col("rule_type").isin(*SELECT_TYPES, 9) & ~F.col("is_view_step") & ((F.col("rule_type") == 9) | ~is_intermediate(F.col("target_table"))))
    code = F.coalesce("rule_group_code", F.concat(F.lit("_SOLO_"), F.col("rule_code")))
    last = final.withColumn("group_code", code).withColumn("rk", F.row_number().over(Window.partitionBy("group_code").orderBy(F.desc("exec_sequence"), F.desc("row_ord")))).where("rk = 1")
    staged = rules.where(F.col("rule_type").isin(*SELECT_TYPES)).select(short_name(F.col("target_table")).alias("k"), F.col("delete_mode").alias("staged_mode"), F.col("rule_code").alias("staged_rule"))
    last = last.join(staged, (F.col("rule_type") == 9) & (short_name(F.col("target_table")) == F.col("k")), "left")
    mode = F.coalesce("staged_mode", "delete_mode")
    strategy = F.when(mode == "1", "full").when(mode.isin("2", "4", "6"), "incremental").when(mode.isin(*PARTITION_MODES), "partition").otherwise("unknown")
    return last.select("group_code", F.coalesce("staged_rule", "rule_code").alias("rule_code"), mode.alias("delete_mode"), strategy.alias("strategy"))
