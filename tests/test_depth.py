"""Lineage at any depth."""

from etlscope.operators import lineage
from etlscope.plans import facts

FIELDS = [x.split()[0] for x in facts.RULE.replace("\n", " ").split(", ")]


def rule(code, target, sql, order=0):
    x = {"rule_code": code, "rule_type": 1, "exec_sequence": order, "target_schema": "dws", "target_table": target, "query_sql": sql, "rule_group_code": "G", "is_view_step": False, "row_ord": order}
    return tuple(x.get(f) for f in FIELDS)


def test_twelve_nested_ctes(spark):
    ctes = ["c0 AS (SELECT n.n_name AS f FROM nation n)"] + [f"c{i} AS (SELECT p.f FROM c{i - 1} p)" for i in range(1, 12)]
    f = facts.extract(spark, spark.createDataFrame([rule("deep", "t", f"WITH {', '.join(ctes)} SELECT x.f FROM c11 x")], facts.RULE))
    got = [(r["output"], r["source_table"], r["source_field"], r["path_depth"]) for r in facts.field_edges(f).collect()]
    assert got == [("f", "nation", "n_name", 13)]


def test_eighteen_chained_rules(spark):
    edges = [(f"t{i}", "f", f"t{i + 1}" if i < 17 else "nation", "f", "direct", f"step_{i}") for i in range(18)]
    df = spark.createDataFrame(edges, "to_table string, to_field string, from_table string, from_field string, transform string, step_id string")
    got = {r["table"]: (r["source_table"], r["depth"]) for r in lineage.physical_sources(df).collect()}
    assert got == {f"t{i}": ("nation", 18 - i) for i in range(18)}


def test_cycles_end(spark):
    edges = [("a", "f", "b", "f", "direct", "s1"), ("b", "f", "a", "f", "direct", "s2"), ("b", "f", "nation", "f", "direct", "s3")]
    df = spark.createDataFrame(edges, "to_table string, to_field string, from_table string, from_field string, transform string, step_id string")
    assert {(r["table"], r["source_table"]) for r in lineage.physical_sources(df).collect()} == {("a", "nation"), ("b", "nation")}
