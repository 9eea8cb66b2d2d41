"""Registered queries over rule catalogs that grow with the tables: rules are made from rows, and their facts follow from the row numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import short_name
from .operators import impact, lineage, quality, topology
from .plans import facts
from .plans.cut import cut, local

Query = Callable[[SparkSession, str], DataFrame]
FIELDS = [c.strip().split(" ") for c in facts.RULE.replace("\n", " ").split(",")]


def as_rules(rows: DataFrame, **columns: Column) -> DataFrame:
    """A rule table with the given columns; the others have their usual values."""
    usual = {"rule_type": F.lit(1), "exec_sequence": F.lit(1), "target_schema": F.lit("dws"), "delete_mode": F.lit("1"), "delete_condition": F.lit(""), "is_view_step": F.lit(False), "rule_group_code": F.lit("G"), "exchange_source_table": F.lit("")}
    columns = usual | columns
    return rows.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS])


# --- chains of ten rules, one rule a supplier -------------------------------------------------------------------------

#: Position in the chain -> SQL; {s} is the table before.
CHAIN = {
    0: "SELECT x.a AS a, x.b AS b FROM {s} x",
    1: "SELECT x.a AS a, SUM(x.b) AS b FROM {s} x GROUP BY x.a",
    2: "WITH c AS (SELECT y.a, NVL(y.b, 0) AS b FROM {s} y) SELECT c.a, c.b FROM c",
    3: "SELECT q.* FROM (SELECT x.a, CASE WHEN x.b > 0 THEN x.b ELSE 0 END AS b FROM {s} x) q",
    4: "SELECT x.a, x.b FROM {s} x UNION ALL SELECT z.k, z.v FROM src.extra z",
    5: "SELECT x.a, x.b FROM {s} x WHERE EXISTS (SELECT 1 FROM src.extra z WHERE z.k = x.a)",
    6: "SELECT x.a, SUM(CASE WHEN x.b > 1 THEN x.b ELSE 0 END) AS b FROM {s} x GROUP BY x.a",
    7: "SELECT x.a, x.b FROM {s} x",
    8: "SELECT j.a, j.b FROM {s} j LEFT JOIN src.extra z USING (a)",
    9: "SELECT * FROM {s}",
}


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ten rules in a row; the eighth writes the table of the seventh once more, from the base."""
    k = F.col("s_suppkey").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("k"), F.expr("int(s_suppkey div 10)").alias("g"), (k % 10).alias("p"))
    table = lambda p: F.concat(F.lit("s"), F.col("g").cast("string"), F.lit("_t"), p.cast("string"))
    base = F.concat(F.lit("src.base"), (F.col("g") % 7).cast("string"))
    source = F.when(F.col("p").isin(0, 7), base).otherwise(F.concat(F.lit("dws."), table(F.when(F.col("p") == 8, 6).otherwise(F.col("p") - 1))))
    sql = F.lit(None).cast("string")
    for p, text in CHAIN.items():
        sql = F.when(F.col("p") == p, F.replace(F.lit(text), F.lit("{s}"), source)).otherwise(sql)
    return as_rules(
        rows, rule_code=F.concat(F.lit("c"), F.col("k").cast("string")), exec_sequence=F.col("p") + 1, target_table=table(F.when(F.col("p") == 7, 6).otherwise(F.col("p"))), query_sql=sql,
        rule_group_code=F.concat(F.lit("C"), F.col("g").cast("string")), row_ord=F.col("k"),
    )


CHAIN_SQL = """
WITH RECURSIVE r AS (SELECT k, k // 10 AS g, k % 10 AS p FROM (SELECT s_suppkey AS k FROM supplier)),
step AS (SELECT 'step_' || (row_number() OVER (ORDER BY k)) AS step_id, row_number() OVER (ORDER BY k) AS no, 'c' || k AS rule_code, g, p, p + 1 AS seq, 's' || g || '_t' || CASE p WHEN 7 THEN 6 ELSE p END AS t,
  CASE WHEN p IN (0, 7) THEN 'base' || (g % 7) WHEN p = 8 THEN 's' || g || '_t6' ELSE 's' || g || '_t' || (p - 1) END AS s FROM r),
edges AS (SELECT rule_code, t AS tt, 'a' AS tf, s AS st, 'a' AS sf, 1 AS rk FROM step
  UNION ALL SELECT rule_code, t, 'b', s, 'b', CASE p WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 6 THEN 6 ELSE 1 END FROM step
  UNION ALL SELECT rule_code, t, 'a', 'extra', 'k', 1 FROM step WHERE p = 4 UNION ALL SELECT rule_code, t, 'b', 'extra', 'v', 1 FROM step WHERE p = 4),
reads AS (SELECT step_id, seq, no, s FROM step UNION SELECT step_id, seq, no, 'extra' FROM step WHERE p IN (4, 5, 8)),
dep AS (SELECT DISTINCT w.step_id AS a, r.step_id AS b, w.t FROM reads r JOIN step w ON w.t = r.s AND w.step_id <> r.step_id),
flow(tt, tf, st, sf, rk, d) AS (SELECT tt, tf, st, sf, rk, 1 FROM edges UNION SELECT f.tt, f.tf, e.st, e.sf, greatest(f.rk, e.rk), f.d + 1 FROM flow f JOIN edges e ON e.tt = f.st AND e.tf = f.sf)
"""

class Chains:
    def __init__(self, spark: SparkSession, sf_dir: str):
        rules = chains(spark, sf_dir)
        self.facts = facts.extract(spark, rules)
        self.step = cut(topology.steps(rules))

    def read(self) -> DataFrame:
        return topology.reads(self.facts, self.step)


def _chains(f: Callable[[Chains], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Chains(spark, sf_dir))


def _implicit(c: Chains) -> DataFrame:
    read = cut(c.read())
    return topology.implicit_dependencies(c.step, read, topology.self_references(c.step, read), topology.dependencies(c.step, read)).select("from_step", "to_step", short_name(F.col("table")).alias("tab"), "kind")


# --- joins: one rule a nation -----------------------------------------------------------------------------------------


def joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule n joins 1 to 4 tables to the first one: in a row if n is odd, all to the first if it is even."""
    n = F.col("n_nationkey").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("n"))
    text = F.lit("SELECT t0.v AS v FROM s.a0 t0")
    for i in range(1, 5):
        on = F.when(F.col("n") % 2 == 1, f"t{i}.k = t{i - 1}.k").otherwise(f"t{i}.k = t0.k")
        text = F.concat(text, F.when(F.col("n") % 4 + 1 >= i, F.concat(F.lit(f" LEFT JOIN s.a{i} t{i} ON "), on)).otherwise(""))
    text = F.concat(text, F.when(F.col("n") % 3 == 0, " WHERE t0.w > 1").otherwise(""))
    return as_rules(rows, rule_code=F.concat(F.lit("j"), F.col("n").cast("string")), target_table=F.concat(F.lit("j"), F.col("n").cast("string")), query_sql=text, row_ord=F.col("n"))


JOIN_SQL = "WITH RECURSIVE j AS (SELECT 'j' || n_nationkey AS rule_code, n_nationkey AS n, unnest(range(1, n_nationkey % 4 + 2)) AS i FROM nation), e AS (SELECT *, CASE WHEN n % 2 = 1 THEN i - 1 ELSE 0 END AS before FROM j)"


# --- shapes: one rule a region and shape ------------------------------------------------------------------------------

#: Shape -> SQL ({r}: region key) and, in DuckDB, its (output, source table, source field, transform) rows.
SHAPES = {
    "star_derived": ("SELECT q.* FROM (SELECT x.a, x.b + 1 AS c FROM s.t{r} x) q", [("a", "s.t{r}", "a", "direct"), ("c", "s.t{r}", "b", "expression")]),
    "star_cte": ("WITH c AS (SELECT x.a, MAX(x.b) AS m FROM s.t{r} x GROUP BY x.a) SELECT * FROM c", [("a", "s.t{r}", "a", "direct"), ("m", "s.t{r}", "b", "aggregate")]),
    "star_ddl": ("SELECT d.*, u.z FROM s.known d JOIN s.u{r} u ON u.k = d.a", [("a", "s.known", "a", "direct"), ("b", "s.known", "b", "direct"), ("z", "s.u{r}", "z", "direct")]),
    "star_except": ("SELECT * EXCEPT (a) FROM s.known", [("b", "s.known", "b", "direct")]),
    "star_using": ("SELECT * FROM s.known k JOIN (SELECT y.a, y.e FROM s.t{r} y) z USING (a)", [("a", "s.known", "a", "direct"), ("b", "s.known", "b", "direct"), ("e", "s.t{r}", "e", "direct")]),
    "unqualified": ("SELECT b, e FROM s.known k JOIN (SELECT y.a AS aa, y.e FROM s.t{r} y) z ON z.aa = k.a", [("b", "s.known", "b", "direct"), ("e", "s.t{r}", "e", "direct")]),
    "lateral_view": ("SELECT x.a, v.item FROM s.t{r} x LATERAL VIEW explode(x.items) v AS item", [("a", "s.t{r}", "a", "direct"), ("item", "s.t{r}", "items", "expression")]),
    "correlated": ("SELECT x.a, (SELECT MAX(y.v) FROM s.u{r} y WHERE y.k = x.k) AS m FROM s.t{r} x", [("a", "s.t{r}", "a", "direct")]),
    "rollup": ("SELECT x.a, SUM(x.b) AS b FROM s.t{r} x GROUP BY ROLLUP(x.a, x.c)", [("a", "s.t{r}", "a", "direct"), ("b", "s.t{r}", "b", "aggregate")]),
    "sample": ("SELECT x.a FROM s.t{r} TABLESAMPLE (10 PERCENT) x", [("a", "s.t{r}", "a", "direct")]),
}
SHAPE_USAGE = [
    ("star_ddl", "join", "k", "s.u{r}"), ("star_ddl", "join", "a", "s.known"), ("star_using", "join", "a", "s.known"), ("star_using", "join", "a", None), ("unqualified", "join", "aa", None), ("unqualified", "join", "a", "s.known"),
    ("star_cte", "group", "a", "s.t{r}"), ("correlated", "where", "k", "s.u{r}"), ("correlated", "where", "k", "s.t{r}"), ("rollup", "group", "a", "s.t{r}"), ("rollup", "group", "c", "s.t{r}"),
]
TYPES = {
    "t_cast": ("SELECT CAST(x.a AS VARCHAR(30)) AS c1, CAST(x.b AS INT) AS c2 FROM s.known x", [("c1", "cast", None, "varchar(30)"), ("c2", "cast", None, "integer")]),
    "t_case": ("SELECT CASE WHEN x.b > 1 THEN x.a WHEN x.b = 1 THEN 'many letters' ELSE x.b END AS c1 FROM s.known x", [("c1", "case", "a", "varchar(10)"), ("c1", "case", None, "varchar(12)"), ("c1", "case", "b", "bigint")]),
    "t_sum": ("SELECT SUM(x.b) AS c2, COUNT(x.a) AS c1 FROM s.known x", [("c2", "sum", "b", "bigint")]),
    "t_max_cte": ("WITH c AS (SELECT MAX(y.a) AS m FROM s.known y) SELECT c.m AS c1 FROM c", [("c1", "max", "a", "varchar(10)")]),
    "t_direct": ("SELECT x.a AS c1, x.b AS c2 FROM s.known x", [("c1", "direct", "a", "varchar(10)"), ("c2", "direct", "b", "bigint")]),
}
KNOWN = [("known", "a", "varchar(10)"), ("known", "b", "bigint"), ("typed", "c1", "varchar(20)"), ("typed", "c2", "int")]
JOINED = {  # joins and whether they lack a condition
    "left_using": ("SELECT a.x FROM s.a a LEFT JOIN s.b b USING (k)", False), "inner_bare": ("SELECT a.x FROM s.a a JOIN s.b b", True), "left_bare": ("SELECT a.x FROM s.a a LEFT JOIN s.b", True), "comma": ("SELECT a.x FROM s.a a, s.b b WHERE a.k = b.k", False),
    "cross": ("SELECT a.x FROM s.a a CROSS JOIN s.b b", False), "plus": ("SELECT a.x FROM s.a a, s.b b WHERE a.k = b.k(+)", False), "natural": ("SELECT a.x FROM s.a a NATURAL JOIN s.b b", False), "on": ("SELECT a.x FROM s.a a INNER JOIN s.b AS b ON a.k = b.k", False),
    "second": ("SELECT a.x FROM s.a a JOIN s.b b ON a.k = b.k JOIN s.c c WHERE a.x > 1", True), "derived": ("SELECT a.x FROM s.a a JOIN (SELECT k FROM s.b) q ON q.k = a.k", False),
}


def _regions(spark: SparkSession, sf_dir: str, shapes: dict[str, str], target: str | None = None) -> DataFrame:
    r = F.col("r_regionkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.explode(F.create_map(*[F.lit(x) for pair in shapes.items() for x in pair])).alias("shape", "text"))
    code = F.concat("shape", F.lit("_"), r)
    return as_rules(rows, rule_code=code, target_table=F.lit(target) if target else code, query_sql=F.replace("text", F.lit("{r}"), r), row_ord=F.col("r_regionkey"))


def _shapes(spark: SparkSession, sf_dir: str) -> facts.FactTables:
    return facts.extract(spark, _regions(spark, sf_dir, {n: t for n, (t, _) in SHAPES.items()}), ddl=local(spark, KNOWN, "table string, column string, type string"))


def _literal(v: str | None) -> str:
    return "NULL" if v is None else "replace('" + v.replace("'", "''") + "', '{r}', CAST(r_regionkey AS VARCHAR))"


def _rows_sql(rows: list[tuple], columns: str) -> str:
    """Rows for every region, {r} replaced."""
    return " UNION ALL ".join(f"SELECT {', '.join(f'{_literal(v)} AS {c}' for v, c in zip((r[0] + '_{r}', *r[1:]), columns.split(', '), strict=True))} FROM region" for r in rows)


def a31_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).edges.select("rule_code", "output", "source_table", "source_field", "transform")


def a24_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.usages(_shapes(spark, sf_dir)).select("rule_code", "kind", "field", F.col("table").alias("tab"))


def b45_type_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, ddl = _regions(spark, sf_dir, {n: t for n, (t, _) in TYPES.items()}, "typed"), local(spark, KNOWN, "table string, column string, type string")
    found = quality.type_checks(facts.extract(spark, rules, ddl=ddl), topology.steps(rules), ddl)
    return found.select("rule_code", "output", "kind", "source_field", "source_type", "target_type", "compatible")


def b67_cast_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source columns become varchar(10 * region); rules cast them to varchar(25), and every second target has varchar(15) in its DDL."""
    r = F.col("r_regionkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.explode(F.array(F.concat(F.lit("k"), r), F.concat(F.lit("d"), r))).alias("t"), F.col("r_regionkey").alias("n"))
    rules = as_rules(rows, rule_code=F.col("t"), target_table=F.concat(F.lit("out_"), F.col("t")), query_sql=F.concat(F.lit("SELECT CAST(x.a AS VARCHAR(25)) AS c FROM s."), F.col("t"), F.lit(" x")), row_ord=F.col("n"))
    ddl = rows.where("startswith(t, 'd')").select(F.concat(F.lit("out_"), F.col("t")).alias("table"), F.lit("c").alias("column"), F.lit("varchar(15)").alias("type"))
    f, step = facts.extract(spark, rules), topology.steps(rules)
    text = lambda v, n: F.lit(v).alias(n)
    wider = F.concat(F.lit("varchar("), ((F.col("n") + 1) * 10).cast("string"), F.lit(")")).alias("after_type")
    changes = rows.select(F.col("t").alias("before_table"), text("a", "before_field"), text("varchar(5)", "before_type"), F.col("t").alias("after_table"), text("a", "after_field"), wider, text("字段类型及长度变化", "change_type"))
    none, strategy = changes.select("before_table", "change_type").limit(0), rows.select(F.concat(F.lit("out_"), F.col("t")).alias("table"), text("full", "strategy"))
    sources = lineage.physical_sources(lineage.step_edges(f.edges, step))
    return impact.field_status(changes, none, sources, topology.reads(f, step), ddl, strategy, None, impact.cast_gates(f.edges, step)).select("before_table", F.col("table").alias("tab"), "field", "status")


def b41_missing_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _regions(spark, sf_dir, {n: t for n, (t, _) in JOINED.items()})
    f, step = facts.extract(spark, rules), topology.steps(rules)
    read = topology.reads(f, step)
    none = local(spark, [], "rule_code string, field string, state string, transform string")
    found = quality.issues(f, none, topology.self_references(step, read), local(spark, [], "step_id string"), step)
    return found.where("rule = 'missing_on'").select("rule_code", "severity")


def a27_bridge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.extract(spark, joins(spark, sf_dir)).paths.select("rule_code", "alias", "hop", "from_alias", "to_alias", "from_table", "to_table", "join_type", "condition")


def a32_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.blocks(facts.extract(spark, joins(spark, sf_dir))).select("rule_code", "kind", "role", "name", "join_type", "condition", "fields", "ops")


def a32_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the chained rules and the kind of block around each."""
    b = quality.blocks(facts.extract(spark, chains(spark, sf_dir)))
    up = b.select("rule_code", F.col("block").alias("parent"), F.col("kind").alias("around"))
    return b.join(up, ["rule_code", "parent"], "left").groupBy("kind", "around", "ops").agg(F.count("*").alias("n"))


def a25_field_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.field_usage(facts.extract(spark, joins(spark, sf_dir)))


QUERIES: dict[str, tuple[Query, str]] = {
    "a23_roles": (
        _chains(lambda c: c.facts.refs.where("kind = 'table'").select("rule_code", short_name(F.col("name")).alias("tab"), "role", "join_type")),
        CHAIN_SQL + "SELECT rule_code, s AS tab, 'main' AS role, 'FROM' AS join_type FROM step UNION ALL SELECT rule_code, 'extra', CASE p WHEN 4 THEN 'main' ELSE 'secondary' END, CASE p WHEN 8 THEN 'LEFT JOIN' ELSE 'FROM' END FROM step WHERE p IN (4, 5, 8)",
    ),
    "a25_field_usage": (
        a25_field_usage,
        JOIN_SQL + ", c AS (SELECT rule_code, i, before, 't' || i || '.k = t' || before || '.k' AS cond FROM e), u AS (SELECT rule_code, 'join' AS kind, 'k' AS field, i, 'LEFT JOIN' AS join_type, cond FROM c UNION ALL SELECT rule_code, 'join', 'k', before, 'LEFT JOIN', cond FROM c UNION ALL SELECT DISTINCT rule_code, 'where', 'w', 0, '', 't0.w > 1' FROM j WHERE n % 3 = 0) "
        "SELECT rule_code, kind, field, 't' || i AS alias, join_type, min(cond) AS condition, 's.a' || i AS tables FROM u GROUP BY rule_code, kind, field, i, join_type",
    ),
    "a24_usage": (a24_usage, _rows_sql(SHAPE_USAGE, "rule_code, kind, field, tab")),
    "a27_bridge_paths": (
        a27_bridge_paths,
        JOIN_SQL + ", w(rule_code, n, i, cur, before) AS (SELECT rule_code, n, i, i, before FROM e UNION ALL SELECT w.rule_code, w.n, w.i, e.i, e.before FROM w JOIN e ON e.rule_code = w.rule_code AND e.i = w.before) "
        "SELECT rule_code, 't' || i AS alias, CAST(row_number() OVER (PARTITION BY rule_code, i ORDER BY cur) AS INT) AS hop, 't' || before AS from_alias, 't' || cur AS to_alias, 's.a' || before AS from_table, 's.a' || cur AS to_table, 'LEFT JOIN' AS join_type, 't' || cur || '.k = t' || before || '.k' AS condition FROM w",
    ),
    "a31_stars": (a31_stars, _rows_sql([(n, *x) for n, (_, rows) in SHAPES.items() for x in rows], "rule_code, output, source_table, source_field, transform")),
    "a32_blocks": (
        a32_blocks,
        JOIN_SQL + ", q AS (SELECT DISTINCT rule_code, n FROM j), f AS (SELECT rule_code, before AS i, 'k' AS f FROM e UNION SELECT rule_code, i, 'k' FROM e UNION SELECT rule_code, 0, 'v' FROM q UNION SELECT rule_code, 0, 'w' FROM q WHERE n % 3 = 0), g AS (SELECT rule_code, i, string_agg(f, ',' ORDER BY f) AS fields FROM f GROUP BY 1, 2) "
        "SELECT rule_code, 'query' AS kind, 'main' AS role, NULL AS name, NULL AS join_type, NULL AS condition, '' AS fields, CASE WHEN n % 3 = 0 THEN 'filter' ELSE '' END AS ops FROM q "
        "UNION ALL SELECT q.rule_code, 'table', 'main', 's.a0', 'FROM', NULL, g.fields, '' FROM q JOIN g ON g.rule_code = q.rule_code AND g.i = 0 "
        "UNION ALL SELECT e.rule_code, 'table', 'secondary', 's.a' || e.i, 'LEFT JOIN', 't' || e.i || '.k = t' || e.before || '.k', g.fields, '' FROM e JOIN g ON g.rule_code = e.rule_code AND g.i = e.i",
    ),
    "a32_block_tree": (
        a32_block_tree,
        CHAIN_SQL + ", b(p, kind, around, ops) AS (VALUES (0, 'query', NULL, ''), (0, 'table', 'query', ''), (1, 'query', NULL, 'aggregate'), (1, 'table', 'query', ''), (2, 'query', NULL, ''), (2, 'cte', 'query', ''), (2, 'cte', 'query', ''), (2, 'table', 'cte', ''), "
        "(3, 'query', NULL, ''), (3, 'subquery', 'query', ''), (3, 'derived', 'subquery', ''), (3, 'table', 'derived', ''), (4, 'union', NULL, 'union'), (4, 'union_branch', 'union', ''), (4, 'union_branch', 'union', ''), (4, 'table', 'union_branch', ''), (4, 'table', 'union_branch', ''), "
        "(5, 'query', NULL, 'filter'), (5, 'table', 'query', ''), (5, 'subquery', 'query', 'filter'), (5, 'table', 'subquery', ''), (6, 'query', NULL, 'aggregate'), (6, 'table', 'query', ''), (7, 'query', NULL, ''), (7, 'table', 'query', ''), (8, 'query', NULL, ''), (8, 'table', 'query', ''), (8, 'table', 'query', ''), (9, 'query', NULL, ''), (9, 'table', 'query', '')) "
        "SELECT kind, around, ops, count(*) AS n FROM step JOIN b USING (p) GROUP BY 1, 2, 3",
    ),
    "b41_missing_on": (b41_missing_on, _rows_sql([(n, "critical") for n, (_, bare) in JOINED.items() if bare], "rule_code, severity")),
    "b45_type_kinds": (
        b45_type_kinds,
        "SELECT rule_code, output, kind, source_field, source_type, CASE output WHEN 'c1' THEN 'varchar(20)' ELSE 'int' END AS target_type, CASE WHEN output = 'c2' THEN source_type IN ('integer', 'bigint') ELSE source_type LIKE 'varchar%' AND TRY_CAST(regexp_extract(source_type, '([0-9]+)', 1) AS INT) <= 20 END AS compatible FROM ("
        + _rows_sql([(n, *x) for n, (_, rows) in TYPES.items() for x in rows], "rule_code, output, kind, source_field, source_type") + ")",
    ),
    "b67_cast_gates": (
        b67_cast_gates,
        "SELECT t || r_regionkey AS before_table, 'out_' || t || r_regionkey AS tab, 'c' AS field, CASE WHEN 10 * (r_regionkey + 1) <= CASE t WHEN 'd' THEN least(15, 25) ELSE 25 END THEN 'no_impact' ELSE 'impact' END AS status FROM region, (VALUES ('k'), ('d')) v(t)",
    ),
    "b_chain_edges": (_chains(lambda c: c.facts.edges.select("rule_code", "output", short_name(F.col("source_table")).alias("source_table"), "source_field", "transform")), CHAIN_SQL + "SELECT rule_code, tf AS output, st AS source_table, sf AS source_field, ['direct','expression','fallback','case_when','aggregate','pivot'][rk] AS transform FROM edges"),
    "b_chain_sources": (
        _chains(lambda c: lineage.physical_sources(lineage.step_edges(c.facts.edges, c.step)).withColumnRenamed("table", "tab")),
        CHAIN_SQL + "SELECT tt AS tab, tf AS field, st AS source_table, sf AS source_field, ['direct','expression','fallback','case_when','aggregate','pivot'][max(rk)] AS transform, CAST(min(d) AS INT) AS depth FROM flow WHERE st NOT IN (SELECT t FROM step) GROUP BY 1, 2, 3, 4",
    ),
    "b_chain_dependencies": (_chains(lambda c: topology.dependencies(c.step, c.read()).select("from_step", "to_step", short_name(F.col("table")).alias("tab"), "kind")), CHAIN_SQL + "SELECT a AS from_step, b AS to_step, t AS tab, 'data' AS kind FROM dep"),
    "b_chain_implicit": (_chains(_implicit), CHAIN_SQL + "SELECT x.step_id AS from_step, y.step_id AS to_step, x.t AS tab, 'writer' AS kind FROM step x JOIN step y ON x.t = y.t AND x.seq < y.seq"),
    "b_chain_write_groups": (
        _chains(lambda c: topology.write_groups(c.step, topology.self_references(c.step, c.read())).select(short_name(F.col("table")).alias("tab"), "n_writers", "steps", "pattern")),
        CHAIN_SQL + "SELECT t AS tab, count(*) AS n_writers, string_agg(step_id, ',' ORDER BY no) AS steps, 'parallel_then_serial' AS pattern FROM step GROUP BY t HAVING count(*) > 1",
    ),
    "b_chain_producers": (
        _chains(lambda c: lineage.producing_steps(c.step, c.read()).withColumnRenamed("table", "tab")),
        CHAIN_SQL + "SELECT step_id, tab, producer FROM (SELECT r.step_id, r.s AS tab, w.step_id AS producer, row_number() OVER (PARTITION BY r.step_id, r.s ORDER BY w.seq < r.seq DESC, w.seq DESC) AS rn FROM reads r JOIN step w ON w.t = r.s AND w.step_id <> r.step_id) WHERE rn = 1",
    ),
}
