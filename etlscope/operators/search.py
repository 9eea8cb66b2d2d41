"""Field search, rule groups, target index, upstream tracing and renumbering of chained groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import full_name, short_name
from ..plans.cut import cut
from ..plans.facts import FactTables, output_columns, usages


def field_search(facts: FactTables, step: DataFrame, keywords: list[str]) -> DataFrame:
    """(rule_code, target, field, roles): where keywords occur in a rule, case ignored, ordered by table and field.

    An output field is found by its name or by a source field that feeds it; join, where and group columns by their name; roles target/join/where/group
    are '/'-joined.  A rule whose text alone holds a keyword has one row with a null field and the role sql.
    """
    hit = lambda c: F.exists(F.array(*[F.lit(k.strip().lower()) for k in keywords]), lambda k: F.contains(F.lower(c), k))
    fed = facts.edges.where(hit(F.coalesce("source_field", F.lit("")))).select("rule_code", F.col("output").alias("field"))
    named = output_columns(facts).where("scope = 1").select("rule_code", F.col("output").alias("field")).where(hit(F.col("field")))
    cols = named.unionByName(fed).select("rule_code", "field", F.lit("1target").alias("role"))
    order = F.create_map(F.lit("join"), F.lit("2"), F.lit("where"), F.lit("3"), F.lit("group"), F.lit("4"))
    used = usages(facts).where("kind in ('join', 'where', 'group')").where(hit(F.col("field"))).select("rule_code", "field", F.concat(F.element_at(order, F.col("kind")), F.col("kind")).alias("role"))
    roles = F.transform(F.array_sort(F.collect_set("role")), lambda r: F.substring(r, 2, 20))
    found = cols.unionByName(used).groupBy("rule_code", "field").agg(F.array_join(roles, "/").alias("roles"))
    text = facts.rules.where(hit(F.coalesce("query_sql", F.lit("")))).select("rule_code").join(found, "rule_code", "left_anti").select("rule_code", F.lit(None).cast("string").alias("field"), F.lit("sql").alias("roles"))
    return found.unionByName(text).join(step.select("rule_code", "target"), "rule_code").select("rule_code", "target", "field", "roles").orderBy("target", "roles", "field", "rule_code")


def rule_groups(rules: DataFrame) -> DataFrame:
    """(group_code, name, n_rules, n_select): rules without a group code are groups of their own.

    name is the group's English name, or its code; groups of one name are told apart by a number from the second on.
    """
    code = F.coalesce("rule_group_code", F.concat(F.lit("_SOLO_"), F.col("rule_code")))
    groups = rules.groupBy(code.alias("group_code")).agg(F.min(F.nullif("rule_group_en", F.lit(""))).alias("en"), F.count("*").alias("n_rules"), F.sum(F.col("rule_type").isin(1, 14).cast("long")).alias("n_select"))
    n = F.row_number().over(Window.partitionBy(F.coalesce("en", "group_code")).orderBy("group_code"))
    name = F.concat(F.coalesce("en", "group_code"), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""))
    return groups.select("group_code", name.alias("name"), "n_rules", "n_select")


def batch_status(facts: FactTables) -> DataFrame:
    """(group_code, n_rules, n_parsed, n_failed, errors): what became of each group; a broken rule leaves the others alone."""
    code = F.coalesce("rule_group_code", F.concat(F.lit("_SOLO_"), F.col("rule_code")))
    rows = facts.rules.select("rule_code", code.alias("group_code")).join(facts.status.select("rule_code", "ok"), "rule_code", "left")
    errors = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("rule_code")))), ",")
    return rows.groupBy("group_code").agg(F.count("*").alias("n_rules"), F.count_if("ok").alias("n_parsed"), F.count_if(~F.col("ok")).alias("n_failed"), errors.alias("errors"))


def target_index(rules: DataFrame) -> DataFrame:
    """(table, group_code): which groups write each table."""
    code = F.coalesce("rule_group_code", F.concat(F.lit("_SOLO_"), F.col("rule_code")))
    return rules.where("rule_type in (1, 9, 14)").select(F.when(F.col("rule_type") == 9, F.lower("exchange_source_table")).otherwise(full_name(F.col("target_schema"), F.col("target_table"))).alias("table"), code.alias("group_code")).distinct()


def group_edges(step: DataFrame, read: DataFrame, index: DataFrame) -> DataFrame:
    """(reader, writer): group that reads a table, group that writes it; initial loads (``..._init``) are no writers."""
    r = read.join(step.select("step_id", "group_code"), "step_id").select(F.col("group_code").alias("reader"), short_name(F.col("source")).alias("k"))
    w = index.where(~F.col("group_code").rlike("(?i)_init$")).select(F.col("group_code").alias("writer"), short_name(F.col("table")).alias("k"))
    return r.join(w, "k").where("reader <> writer").select("reader", "writer").distinct()


def upstream(edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """(group_code, depth): groups reachable upstream of ``start``, with the least depth; one join a level, until none is new."""
    spark = edges.sparkSession
    seen = level = spark.createDataFrame([(start, 0)], "group_code string, depth int")
    while max_depth is None or max_depth > 0:
        level = cut(level.join(edges, F.col("group_code") == F.col("reader")).select(F.col("writer").alias("group_code"), (F.col("depth") + 1).alias("depth")).distinct().join(seen.select("group_code"), "group_code", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        max_depth = max_depth and max_depth - 1
    return seen.groupBy("group_code").agg(F.min("depth").alias("depth"))


def chain_schedule(groups: DataFrame, tasks: DataFrame) -> DataFrame:
    """(group_code, depth, task_name, schedule_cron): the scheduler tasks of each group of a chain, null where there is none."""
    return groups.join(tasks.select("group_code", "task_name", "schedule_cron"), "group_code", "left").select("group_code", "depth", "task_name", "schedule_cron")


def not_found(groups: DataFrame, step: DataFrame, read: DataFrame, index: DataFrame) -> DataFrame:
    """(table): what the groups read and no group writes, the sources of the whole chain."""
    r = read.join(step.select("step_id", "group_code"), "step_id").join(groups.select("group_code"), "group_code", "left_semi")
    w = index.select(short_name(F.col("table")).alias("k")).distinct()
    return r.select(F.col("source").alias("table"), short_name(F.col("source")).alias("k")).distinct().join(w, "k", "left_anti").select("table")


def renumbered(step: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(step_id, group_code, exec_sequence, chain_sequence, delete_condition): sequences of chained groups, each after those it reads.

    A group starts behind the last sequence of every group it depends on; independent groups overlap.  Offsets grow until nothing
    changes; groups that read each other in a ring are given up after as many rounds as there are groups.
    """
    own = step.join(groups.select("group_code"), "group_code").groupBy("group_code").agg(F.max("exec_sequence").alias("length"))
    inner = edges.join(own.select(F.col("group_code").alias("reader")), "reader").join(own.select(F.col("group_code").alias("writer"), F.col("length").alias("w_length")), "writer")
    inner = cut(inner)
    offset, rounds = cut(own.select("group_code", F.lit(0).alias("offset"))), 0
    n = offset.count()
    while rounds < n:
        pushed = inner.join(offset.select(F.col("group_code").alias("writer"), F.col("offset").alias("w_offset")), "writer").groupBy(F.col("reader").alias("group_code")).agg(F.max(F.col("w_offset") + F.col("w_length")).alias("pushed"))
        moved = cut(offset.join(pushed, "group_code", "left").select("group_code", F.greatest("offset", F.coalesce("pushed", F.lit(0))).alias("offset"), (F.col("pushed") > F.col("offset")).alias("grew")))
        offset, rounds = moved.drop("grew"), rounds + 1
        if moved.where("grew").isEmpty():
            break
    return step.join(offset, "group_code").select("step_id", "group_code", "exec_sequence", (F.col("exec_sequence") + F.col("offset")).alias("chain_sequence"), "delete_condition")
