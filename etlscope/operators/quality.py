"""Complexity, issues, processing patterns, type consistency, and the mapping of declared to computed fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import compatible, short_name
from ..plans.facts import FactTables, output_columns

MOST_JOINS, MOST_CTES, MOST_CASES, MOST_DIFFERENCES = 16, 3, 20, 4


def complexity(facts: FactTables) -> DataFrame:
    """(rule_code, n_joins, n_ctes, n_subqueries, n_columns, n_tables, n_cases) of each parsed rule."""
    ctes = facts.scopes.groupBy("rule_code").agg(F.sum(F.when(F.col("kind") == "cte", 1).otherwise(0)).alias("n_ctes"))
    cols = output_columns(facts).where("scope = 1 and branch = 0").groupBy("rule_code").agg(F.count("*").alias("n_columns"))
    tables = facts.refs.where("kind = 'table'").groupBy("rule_code").agg(F.count_distinct("name").alias("n_tables"))
    out = facts.status.where("ok").select("rule_code", F.col("joins").cast("long").alias("n_joins"), F.col("subqueries").cast("long").alias("n_subqueries"), F.col("case_branches").cast("long").alias("n_cases"))
    for part in (ctes, cols, tables):
        out = out.join(part, "rule_code", "left")
    return out.na.fill(0).select("rule_code", "n_joins", "n_ctes", "n_subqueries", "n_columns", "n_tables", "n_cases")


def transform_histogram(facts: FactTables) -> DataFrame:
    """(rule_code, transform, n) over the output columns of each rule."""
    return output_columns(facts).where("scope = 1").groupBy("rule_code", "transform").agg(F.count("*").alias("n"))


def field_mapping(facts: FactTables, declared: DataFrame, parity: bool = False) -> DataFrame:
    """(rule_code, field, state, transform): declared target fields against computed columns, by lower-case name.

    state: matched, only_declared or only_in_sql.  With ``parity`` an upper-case declaration does not match.
    """
    cols = output_columns(facts).where("scope = 1 and branch = 0").select("rule_code", F.col("output").alias("field"), "transform", F.lit(True).alias("in_sql"))
    want = declared.select("rule_code", (F.col("target_field") if parity else F.lower("target_field")).alias("field"), F.lit(True).alias("declared")).distinct()
    cols = cols.join(want.select("rule_code").distinct(), "rule_code", "left_semi")
    both = cols.join(want, ["rule_code", "field"], "full")
    state = F.when(F.col("in_sql").isNull(), "only_declared").when(F.col("declared").isNull(), "only_in_sql").otherwise("matched")
    return both.select("rule_code", "field", state.alias("state"), F.coalesce("transform", F.lit("unknown")).alias("transform"))


def issues(facts: FactTables, mapping: DataFrame, selfs: DataFrame, over: DataFrame, step: DataFrame) -> DataFrame:
    """(issue_id, rule_code, rule, severity), numbered in the order of the rules below."""
    cx = complexity(facts)
    code = step.select("step_id", "rule_code")
    bare = facts.refs.where("kind = 'table' and not contains(name, '.')").select("rule_code").distinct()
    no_on = facts.refs.where("kind = 'table' and bare").select("rule_code").distinct()
    many = facts.refs.groupBy("rule_code", "scope").agg(F.count("*").alias("n"))
    loose = facts.sources.where("alias = ''").join(many, ["rule_code", "scope"])
    differ = mapping.where("state <> 'matched'").groupBy("rule_code").count().where(F.col("count") > MOST_DIFFERENCES)
    marked = facts.rules.where(F.contains("query_sql", F.lit("(+)")))
    rows = [
        (no_on, "missing_on", "critical"), (marked, "oracle_join", "medium"), (facts.status.where("star"), "select_star", "critical"), (facts.status.where("not ok"), "parse_error", "critical"),
        (cx.where(F.col("n_joins") > MOST_JOINS), "many_joins", "medium"), (cx.where(F.col("n_ctes") > MOST_CTES), "many_ctes", "medium"), (cx.where(F.col("n_cases") > MOST_CASES), "many_cases", "medium"),
        (bare, "no_schema", "medium"), (differ, "field_differences", "info"), (loose.where("n > 1"), "no_alias_many", "medium"), (loose.where("n = 1"), "no_alias", "info"),
        (over.join(code, "step_id"), "over_constraint", "info"), (selfs.join(code, "step_id"), "self_reference", "info"),
    ]
    parts = [x.select("rule_code", F.lit(i).alias("o"), F.lit(name).alias("rule"), F.lit(severity).alias("severity")).distinct() for i, (x, name, severity) in enumerate(rows)]
    every = reduce(DataFrame.unionByName, parts)
    n = F.row_number().over(Window.orderBy("o", "rule_code"))  # issues of one catalog: few
    return every.select(F.concat(F.lit("ISS_"), F.lpad(n.cast("string"), 3, "0")).alias("issue_id"), "rule_code", "rule", "severity")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(F.when(F.col("severity") == "high", "medium").otherwise(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))


#: Pattern key to its label in reports (fixed values of the report language).
PATTERNS = {
    "cte_aggregate": "CTE预聚合", "cte": "CTE预处理", "pivot": "行转列", "window": "窗口函数", "aggregate": "聚合汇总", "case_when": "条件加工", "fallback": "NULL兼容",
    "incremental_dedup": "增量去重", "not_exists": "NOT EXISTS排除", "audit": "审计字段", "serial": "多步骤串行", "parallel": "多步骤并行",
    "scd2_latest": "SCD2取最新",
}


def patterns(facts: FactTables, step: DataFrame, selfs: DataFrame) -> DataFrame:
    """(group_code, pattern): processing patterns of each rule group."""
    code = step.select("rule_code", "group_code", "step_id")
    t = facts.columns.join(code, "rule_code").groupBy("group_code").agg(F.collect_set("transform").alias("t"))
    c = facts.scopes.join(code, "rule_code").groupBy("group_code").agg(F.max(F.col("kind") == "cte").alias("cte"))
    s = step.groupBy("group_code").agg(F.count_distinct("exec_sequence").alias("n_seq"), F.count("*").alias("n"), F.max(F.contains(F.upper(F.coalesce("query_sql", F.lit(""))), F.lit("NOT EXISTS"))).alias("ne"))
    own = selfs.join(code, "step_id").select("group_code", F.lit(True).alias("own")).distinct()
    cte_columns = output_columns(facts).join(facts.scopes.where("kind = 'cte'").select("rule_code", "scope"), ["rule_code", "scope"])
    latest = cte_columns.where((F.col("transform") == "window") & F.contains(F.upper("expression"), F.lit("ROW_NUMBER"))).join(code, "rule_code").select("group_code", F.lit(True).alias("latest")).distinct()
    g = s.join(t, "group_code", "left").join(c, "group_code", "left").join(own, "group_code", "left").join(latest, "group_code", "left")
    has = lambda x: F.coalesce(F.array_contains("t", x), F.lit(False))
    cte, ne, me = F.coalesce("cte", F.lit(False)), F.col("ne"), F.coalesce("own", F.lit(False))
    flags = {
        "cte_aggregate": cte & has("aggregate"), "cte": cte & ~has("aggregate"), "pivot": has("pivot"), "window": has("window"), "aggregate": has("aggregate"), "case_when": has("case_when"), "fallback": has("fallback"),
        "incremental_dedup": ne & me, "not_exists": ne & ~me, "audit": has("value"), "serial": F.col("n_seq") > 1, "parallel": (F.col("n_seq") < F.col("n")),
        "scd2_latest": F.coalesce("latest", F.lit(False)),
    }
    return g.select("group_code", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in flags.items()]))).alias("pattern"))


def type_checks(facts: FactTables, step: DataFrame, ddl: DataFrame) -> DataFrame:
    """(rule_code, output, kind, source_table, source_field, source_type, target_type, compatible) against the target's DDL.

    kind: direct columns and SUM, MIN, MAX, AVG by the source column's type; cast by the type cast to; case by each THEN and ELSE that is a column
    or a literal.  COUNT, windows, pivots and other expressions say nothing about types.
    """
    tgt = step.select("rule_code", short_name(F.col("target")).alias("tt")).join(ddl.select(F.col("table").alias("tt"), F.col("column").alias("output"), F.col("type").alias("target_type")), "tt")
    src = ddl.select(F.col("table").alias("source_table"), F.col("column").alias("source_field"), F.col("type").alias("source_type"))
    e = facts.edges
    kind = F.when(F.col("transform") == "direct", "direct").when((F.col("transform") == "aggregate") & F.col("root").isin("sum", "min", "max", "avg"), F.col("root"))
    moved = e.select("rule_code", "output", kind.alias("kind"), short_name(F.col("source_table")).alias("source_table"), "source_field").where("kind is not null").join(src, ["source_table", "source_field"])
    roots = facts.outputs.where("scope = 1")
    cast = roots.where("root = 'cast' and transform = 'expression'").select("rule_code", "output", F.lit("cast").alias("kind"), F.lit(None).cast("string").alias("source_table"), F.lit(None).cast("string").alias("source_field"), F.col("cast_type").alias("source_type"))
    cases = facts.results.join(roots.where("transform = 'case_when'").select("rule_code", "output").distinct(), ["rule_code", "output"], "left_semi")
    column = cases.where("field is not null").select("rule_code", "output", F.lit("case").alias("kind"), short_name(F.col("table")).alias("source_table"), F.col("field").alias("source_field")).join(src, ["source_table", "source_field"])
    literal = cases.where("constant is not null").select("rule_code", "output", F.lit("case").alias("kind"), F.lit(None).cast("string").alias("source_table"), F.lit(None).cast("string").alias("source_field"), F.col("constant").alias("source_type"))
    every = moved.unionByName(cast).unionByName(column).unionByName(literal).join(tgt, ["rule_code", "output"])
    return every.select("rule_code", "output", "kind", "source_table", "source_field", "source_type", "target_type", compatible(F.col("source_type"), F.col("target_type")).alias("compatible")).distinct()


def constant_checks(facts: FactTables, step: DataFrame, ddl: DataFrame) -> DataFrame:
    """(rule_code, output, constant, target_type, compatible): literal columns against the target's DDL."""
    lit = output_columns(facts).where("scope = 1 and constant is not null").select("rule_code", "output", "constant").join(step.select("rule_code", "target"), "rule_code")
    tgt = ddl.select(F.col("table").alias("tt"), F.col("column").alias("output"), F.col("type").alias("target_type"))
    typed = lit.withColumn("tt", short_name(F.col("target"))).join(tgt, ["tt", "output"])
    return typed.select("rule_code", "output", "constant", "target_type", compatible(F.col("constant"), F.col("target_type")).alias("compatible"))


def mapping_statistics(mapping: DataFrame) -> DataFrame:
    """(rule_code, n_fields, n_matched, n_only_declared, n_only_in_sql, n_differences) of field_mapping."""
    count = lambda state: F.count_if(F.col("state") == state)
    return mapping.groupBy("rule_code").agg(
        F.count("*").alias("n_fields"), count("matched").alias("n_matched"), count("only_declared").alias("n_only_declared"), count("only_in_sql").alias("n_only_in_sql"), F.count_if(F.col("state") != "matched").alias("n_differences")
    )


def blocks(facts: FactTables) -> DataFrame:
    """(rule_code, block, parent, kind, role, name, alias, join_type, condition, fields, ops): the data blocks of each query as a tree.

    A block is a relation of a select (table, cte, subquery), a set operation (union) or one of its branches; ``parent`` is the
    block around it.  fields: columns that the select around takes from it; ops: filter, aggregate, union.
    """
    name = lambda scope, n=None: F.concat_ws(".", F.lit("s") if n is None else F.lit("r"), F.col(scope).cast("string"), *([] if n is None else [F.col(n).cast("string")]))
    used = facts.usage.where("field is not null").groupBy("rule_code", "scope").agg(F.max(F.col("kind") == "where").alias("f"), F.max(F.col("kind") == "group").alias("g"))
    where = facts.usage.where("kind in ('where', 'having')").select("rule_code", "scope").distinct().withColumn("w", F.lit(True))
    agg = facts.columns.where("transform in ('aggregate', 'pivot')").select("rule_code", "scope").distinct().withColumn("a", F.lit(True))
    sets = facts.scopes.where("kind = 'branch'").select("rule_code", F.col("parent").alias("scope")).distinct().withColumn("u", F.lit(True))
    ops = facts.scopes.select("rule_code", "scope", "kind", "parent", "ord").join(used, ["rule_code", "scope"], "left").join(where, ["rule_code", "scope"], "left").join(agg, ["rule_code", "scope"], "left").join(sets, ["rule_code", "scope"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ops = ops.withColumn("ops", F.array_join(F.array_compact(F.array(F.when(yes("w"), "filter"), F.when(yes("g") | yes("a"), "aggregate"), F.when(yes("u"), "union"))), "/"))
    parent = facts.refs.where("kind = 'derived' and child is not null").select("rule_code", F.col("child").alias("scope"), name("scope", "ord").alias("ref"))
    kind = F.when(F.col("kind") == "branch", "union_branch").when(F.col("kind") == "select", "query").otherwise(F.col("kind"))
    null = F.lit(None).cast("string")
    scopes = ops.join(parent, ["rule_code", "scope"], "left").select(
        "rule_code", name("scope").alias("block"), F.coalesce("ref", F.when(F.col("parent").isNotNull(), name("parent"))).alias("parent"), F.when(yes("u"), "union").otherwise(kind).alias("kind"), F.lit("main").alias("role"),
        null.alias("name"), null.alias("alias"), null.alias("join_type"), null.alias("condition"), F.lit("").alias("fields"), "ops",
    )
    taken = facts.sources.select("rule_code", "scope", "alias", "field").unionByName(facts.usage.where("field is not null").select("rule_code", "scope", "alias", "field"))
    taken = taken.groupBy("rule_code", "scope", "alias").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    refs = facts.refs.join(taken, ["rule_code", "scope", "alias"], "left")
    shown = F.when(F.col("kind") == "derived", "subquery").otherwise(F.col("kind"))
    return scopes.unionByName(
        refs.select(
            "rule_code", name("scope", "ord").alias("block"), name("scope").alias("parent"), shown.alias("kind"), F.when((F.col("ord") == 0) & (F.col("role") == "main"), "main").otherwise("secondary").alias("role"), F.nullif("name", F.lit("")).alias("name"),
            "alias", "join_type", F.coalesce("condition", F.when(F.col("using") != "", F.concat(F.lit("USING ("), F.col("using"), F.lit(")")))).alias("condition"), F.coalesce("fields", F.lit("")).alias("fields"), F.lit("").alias("ops"),
        )
    )


def descriptions(facts: FactTables, step: DataFrame, read: DataFrame) -> DataFrame:
    """(step_id, text): what each step does, in a sentence made of its facts."""
    tables = read.groupBy("step_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("tables"))
    n = transform_histogram(facts).groupBy("rule_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("transform", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["transform"])), ", ").alias("made"))
    rows = step.join(tables, "step_id", "left").join(n, "rule_code", "left")
    verb = F.when(F.col("is_exchange"), F.concat(F.lit("exchanges "), F.col("exchanged"), F.lit(" into "))).when(F.col("rule_type") == 2, "deletes from ").otherwise("writes ")
    return rows.select("step_id", F.concat(verb, F.col("target"), F.coalesce(F.concat(F.lit(" from "), F.col("tables")), F.lit("")), F.coalesce(F.concat(F.lit(": "), F.col("made")), F.lit(""))).alias("text"))
