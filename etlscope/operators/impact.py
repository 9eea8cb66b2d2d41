"""What a list of source changes does to the fields of the analysed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import compatible, short_name

# Change types as users enter them, and their default assessment.
HIGH, ASK, NONE, MISS = "impact", "confirm", "no_impact", "not_hit"
FIELD_DEFAULTS = {
    "0:1新增字段": MISS, "1:0废弃字段": HIGH, "1:0解耦到其他表": HIGH, "字段下线/删除": HIGH, "1:1完全一致": NONE, "字段值语义变化": ASK, "字段名称变化": ASK, "1:1数据内容变化": ASK, "新增字段": MISS,
}
TYPE_CHANGES = ("字段类型及长度变化", "1:1数据类型/长度变化")
TABLE_DEFAULTS = {
    "表/视图下线": HIGH, "表/视图替换": HIGH, "表/视图主键变化": HIGH, "表/视图名称或者schema变化": ASK, "平切": ASK, "表/视图数据归档": ASK, "表/视图取消权限": HIGH, "表/视图数据硬删除": HIGH,
}
INIT_REFRESHED = ("字段数据初始化（刷时间戳）", "表/视图数据初始化（刷时间戳）")
INIT_SILENT = ("字段数据初始化（不刷时间戳）", "表/视图初始化（不刷时间戳）", "表/视图数据初始化（不刷时间戳）")
#: Status in report language.
LABELS = {HIGH: "🔴有影响", ASK: "🟡待确认", NONE: "🟢无影响", MISS: "⚪未命中"}


def _lookup(column, table: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _init(change, strategy):
    """Full loads are safe; others miss silent rewrites and must confirm refreshed ones."""
    return F.when(change.isin(*INIT_REFRESHED, *INIT_SILENT) & (strategy == "full"), NONE).when(change.isin(*INIT_REFRESHED), ASK).when(change.isin(*INIT_SILENT), HIGH)


def table_status(changes: DataFrame, read: DataFrame, strategy: DataFrame, step: DataFrame) -> DataFrame:
    """(before_table, step_id, status): each table change at each reading step; step_id null where no step reads it."""
    hits = read.select("step_id", short_name(F.col("source")).alias("k")).join(step.select("step_id", "group_code"), "step_id").join(strategy.select("group_code", "strategy"), "group_code", "left")
    c = changes.withColumn("kind", F.coalesce(F.nullif("change_type", F.lit("")), F.when(F.col("is_ping_cut"), "平切").when(F.coalesce("after_table", F.lit("")) == "", "表/视图下线").when(F.col("before_table") != F.col("after_table"), "表/视图替换")))
    j = c.join(hits, short_name(F.col("before_table")) == F.col("k"), "left")
    status = F.when(F.col("step_id").isNull(), MISS).otherwise(F.coalesce(_init(F.col("kind"), F.coalesce("strategy", F.lit("unknown"))), _lookup(F.col("kind"), TABLE_DEFAULTS), F.lit(ASK)))
    return j.select("before_table", "step_id", status.alias("status")).distinct()


def field_status(changes: DataFrame, table_changes: DataFrame, sources: DataFrame, read: DataFrame, ddl: DataFrame, strategy: DataFrame, stars: DataFrame | None = None, casts: DataFrame | None = None) -> DataFrame:
    """(before_table, before_field, change_type, table, field, status) of each field change at each affected field.

    ``sources``: physical_sources (table, field, source_table, source_field, transform, depth), so a change reaches every
    field fed by it at any distance, by the exact column.  Changes of tables that table_status handles are left out.
    A new type must fit every gate it meets: the target's type in the DDL and ``casts`` (cast_gates); without any it is to be confirmed.
    ``stars``: star_reads; which fields a SELECT * passes on is unknown, so its target is to be confirmed, field null.
    """
    c = changes.withColumn("k", short_name(F.col("before_table"))).join(table_changes.select(short_name(F.col("before_table")).alias("k")).distinct(), "k", "left_anti")
    readers = read.select(short_name(F.col("source")).alias("k")).distinct().withColumn("is_read", F.lit(True))
    hit = sources.select(F.col("source_table").alias("k"), F.col("source_field").alias("before_field"), "table", "field", "transform")
    j = c.join(readers, "k", "left").join(hit, ["k", "before_field"], "left")
    gate = ddl.select(F.col("table").alias("table"), F.col("column").alias("field"), F.col("type").alias("gate"))
    if casts is not None:
        gate = gate.unionByName(casts.select("table", "field", F.col("cast_type").alias("gate")))
    gates = gate.groupBy("table", "field").agg(F.collect_set("gate").alias("gates"))  # types of one field: few
    j = j.join(gates, ["table", "field"], "left").join(strategy.select("table", "strategy"), "table", "left")
    typed = F.when(F.col("gates").isNull(), ASK).when(F.forall("gates", lambda g: compatible(F.col("after_type"), g)), NONE).otherwise(HIGH)
    status = (
        F.when(F.col("is_read").isNull() | F.col("table").isNull(), MISS)
        .when(F.col("change_type").isin(*TYPE_CHANGES), typed)
        .otherwise(F.coalesce(_init(F.col("change_type"), F.coalesce("strategy", F.lit("unknown"))), _lookup(F.col("change_type"), FIELD_DEFAULTS), F.lit(ASK)))
    )
    out = j.select("before_table", "before_field", "change_type", "table", "field", status.alias("status")).distinct()
    if stars is None:
        return out
    asked = c.join(stars.select("k", "table"), "k").select("before_table", "before_field", "change_type", "table", F.lit(None).cast("string").alias("field"), F.lit(ASK).alias("status")).distinct()
    key = [F.col(f"o.{n}").eqNullSafe(F.col(f"s.{n}")) for n in ("before_table", "before_field", "change_type")]
    found = out.alias("o").join(asked.select("before_table", "before_field", "change_type").distinct().alias("s"), [(F.col("o.status") == MISS) & F.col("o.table").isNull(), *key], "left_anti")
    return found.unionByName(asked)


def star_reads(status: DataFrame, read: DataFrame) -> DataFrame:
    """(k, table): short names of the tables that rules with SELECT * read, and of what those rules write."""
    return read.join(status.where("star").select("rule_code"), "rule_code", "left_semi").select(short_name(F.col("source")).alias("k"), short_name(F.col("target")).alias("table")).distinct()


def summary(status: DataFrame) -> DataFrame:
    """(status, n, listed): counts; red and yellow are listed, the others filtered out."""
    return status.groupBy("status").agg(F.count("*").alias("n")).withColumn("listed", F.col("status").isin(HIGH, ASK))


def cast_gates(edges: DataFrame, step: DataFrame) -> DataFrame:
    """(table, field, cast_type): types that rules cast their output fields to."""
    return edges.where("cast_type is not null").join(step.select("rule_code", short_name(F.col("target")).alias("table")), "rule_code").select("table", F.col("output").alias("field"), "cast_type").distinct()


def touched_fields(changes: DataFrame, edges: DataFrame, step: DataFrame, read: DataFrame) -> DataFrame:
    """(before_table, step_id, table, field): every field of every step that reads a changed table, step by step."""
    hits = read.select("step_id", short_name(F.col("source")).alias("k")).distinct()
    fields = edges.join(step.select("rule_code", "step_id", short_name(F.col("target")).alias("table")), "rule_code").select("step_id", "table", F.col("output").alias("field")).distinct()
    return changes.select("before_table", short_name(F.col("before_table")).alias("k")).distinct().join(hits, "k").join(fields, "step_id").select("before_table", "step_id", "table", "field")


def cross_asset(affected: DataFrame, index: DataFrame, status: DataFrame) -> DataFrame:
    """(table_name, asset, found, n_impact, n_confirm, n_no_impact): the assets (rule groups) that write each affected table.

    ``affected(table_name)``; ``index`` as from target_index; ``status`` from field_status, of which an asset has the rows of
    the tables it writes.  A table that no group writes is listed as not found.
    """
    own = index.select(F.col("group_code").alias("asset"), short_name(F.col("table")).alias("k"))
    counts = status.where("table is not null").select(F.col("table").alias("k"), "status").join(own, "k").groupBy("asset").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (HIGH, ASK, NONE)])
    located = affected.select("table_name", short_name(F.col("table_name")).alias("k")).distinct().join(own, "k", "left").join(counts, "asset", "left")
    zero = lambda s: F.coalesce(f"n_{s}", F.lit(0)).cast("long").alias(f"n_{s}")
    return located.select("table_name", "asset", F.col("asset").isNotNull().alias("found"), zero(HIGH), zero(ASK), zero(NONE))
