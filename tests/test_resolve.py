"""Resolution inside a rule, batches of facts, and closures that must not multiply rows."""

import pytest

from etlscope.operators import lineage, topology
from etlscope.plans import facts, frontend
from test_depth import rule


def extracted(spark, *sqls, ddl=None, batch=facts.BATCH):
    rules = spark.createDataFrame([rule(f"r{i}", f"t{i}", sql, i) for i, sql in enumerate(sqls)], facts.RULE)
    known = spark.createDataFrame(ddl, "table string, column string, type string") if ddl else None
    return facts.extract(spark, rules, ddl=known, batch=batch)


def edges(f):
    return {(r["rule_code"], r["output"], r["source_table"], r["source_field"], r["transform"]) for r in f.edges.collect()}


def test_star_over_a_table_that_a_later_rule_writes(spark):
    f = extracted(spark, "SELECT * FROM dws.t1", "SELECT * FROM dws.t2", "SELECT a.x, a.y + 1 AS z FROM s.u a", "SELECT * FROM s.nowhere")
    assert {e for e in edges(f) if e[0] in ("r0", "r1")} == {(r, c, t, c, "direct") for r, t in (("r0", "dws.t1"), ("r1", "dws.t2")) for c in ("x", "z")}
    assert not {e for e in edges(f) if e[0] == "r3"}


def test_batches_give_the_same_facts(spark):
    sqls = [f"SELECT a.c{i % 3} AS c, SUM(a.v) AS s FROM s.u{i} a GROUP BY a.c{i % 3}" for i in range(7)] + ["SELECT * FROM dws.t0"]
    whole, parts = extracted(spark, *sqls), extracted(spark, *sqls, batch=3)
    for name in facts.SCHEMAS:
        assert sorted(map(str, getattr(whole, name).collect())) == sorted(map(str, getattr(parts, name).collect())), name


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT t.a, v.x FROM s.t t LATERAL VIEW explode(t.arr) v AS x",
        "SELECT * FROM (SELECT a, b, c FROM s.t) PIVOT (sum(c) FOR b IN ('x', 'y'))",
        "SELECT p.a FROM s.t p, LATERAL (SELECT q.b FROM s.t q WHERE q.k = p.k) l",
        "SELECT x.a FROM s.t TABLESAMPLE (5 PERCENT) x",
        "SELECT r.id, t.a FROM range(10) r JOIN s.t t ON t.k = r.id",
        "SELECT t.a FROM s.t t JOIN VALUES (1, 2) AS v(k, w) ON v.k = t.k",
    ],
)
def test_unknown_nodes_keep_the_tables(spark, sql):
    f = frontend.parse(spark, sql)
    assert f.status[0], f.status[1]
    assert "s.t" in {r[3] for r in f.refs}


def test_diamonds_do_not_multiply(spark):
    rows = []
    for i in range(40):  # 2 ** 40 paths
        for side in ("l", "r"):
            rows += [(f"t{i}", "f", f"{side}{i}", "f", "direct", "s"), (f"{side}{i}", "f", f"t{i + 1}", "f", "direct", "s")]
    df = spark.createDataFrame(rows[:48], "to_table string, to_field string, from_table string, from_field string, transform string, step_id string")
    got = {r["table"]: (r["source_table"], r["depth"]) for r in lineage.physical_sources(df).collect()}
    assert got["t0"] == ("t12", 24)


def test_a_heavier_way_is_found_after_a_lighter_one(spark):
    rows = [("a", "f", "p", "f", "direct", "s"), ("a", "f", "b", "f", "direct", "s"), ("b", "f", "p", "f", "aggregate", "s")]
    df = spark.createDataFrame(rows, "to_table string, to_field string, from_table string, from_field string, transform string, step_id string")
    got = {r["table"]: (r["transform"], r["depth"]) for r in lineage.physical_sources(df).collect()}
    assert got == {"a": ("aggregate", 1), "b": ("aggregate", 1)}


def test_implicit_kinds(spark):
    """Readers and self references without the explicit edges that normally state them."""
    sqls = ["SELECT a.x FROM s.u a", "SELECT b.x FROM dws.w b", "SELECT c.x FROM dws.w c"]
    rows = [rule("r0", "w", sqls[0], 1), rule("r1", "w", sqls[1], 2), rule("r2", "v", sqls[2], 3)]
    rules = spark.createDataFrame(rows, facts.RULE)
    f = facts.extract(spark, rules)
    step = topology.steps(rules)
    read, none = topology.reads(f, step), topology.dependencies(step, topology.reads(f, step))
    got = {(r["from_step"], r["to_step"], r["kind"]) for r in topology.implicit_dependencies(step, read, topology.self_references(step, read), none.limit(0)).collect()}
    assert got == {("step_1", "step_2", "self"), ("step_1", "step_3", "reader"), ("step_2", "step_3", "reader")}
    assert topology.implicit_dependencies(step, read, topology.self_references(step, read), none).isEmpty()
