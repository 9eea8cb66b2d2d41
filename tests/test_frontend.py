"""Pre-pass, front end and scope resolution: structure by structure."""

import pytest

from etlscope.plans import facts, frontend, prepass


def edges(spark, sql):
    rule = ("r", "", 1, 1, "s", "t", "1", "", sql, "", "", "", "g", "g", "", False, 0)
    f = facts.extract(spark, spark.createDataFrame([rule], facts.RULE))
    return {(r["output"], r["source_table"], r["source_field"], r["transform"], r["branch"]) for r in facts.field_edges(f).collect()}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a.x AS o FROM s.t a", {("o", "s.t", "x", "direct", 0)}),
        ("SELECT x FROM s.t", {("x", "s.t", "x", "direct", 0)}),
        ("SELECT a.x, b.y FROM s.t a LEFT JOIN s.u b ON a.k = b.k", {("x", "s.t", "x", "direct", 0), ("y", "s.u", "y", "direct", 0)}),
        ("SELECT a.x FROM s.t a UNION ALL SELECT b.y FROM s.u b", {("x", "s.t", "x", "direct", 0), ("x", "s.u", "y", "direct", 1)}),
        ("WITH c AS (SELECT k, SUM(v) AS sv FROM s.t GROUP BY k) SELECT c.sv AS o FROM c", {("o", "s.t", "v", "aggregate", 0)}),
        ("WITH c AS (SELECT a.x FROM s.t a UNION SELECT b.y FROM s.u b) SELECT c.x AS o FROM c", {("o", "s.t", "x", "direct", 0), ("o", "s.u", "y", "direct", 0)}),
        ("WITH a AS (SELECT x, y FROM s.t), b AS (SELECT NVL(a.x, 0) AS z FROM a), c AS (SELECT b.z AS w FROM b) SELECT c.w AS o FROM c", {("o", "s.t", "x", "fallback", 0)}),
        ("SELECT q.m AS o FROM (SELECT MAX(i.v) AS m FROM (SELECT t.v FROM s.t t) i) q", {("o", "s.t", "v", "aggregate", 0)}),
        ("SELECT q.x FROM (SELECT a.x FROM s.t a UNION ALL SELECT b.y FROM s.u b) q JOIN s.v v ON v.k = q.x", {("x", "s.t", "x", "direct", 0), ("x", "s.u", "y", "direct", 0)}),
        ("SELECT a.x, q.n FROM s.t a LEFT JOIN (SELECT k, COUNT(u.z) AS n FROM s.u u GROUP BY k) q ON q.k = a.k", {("x", "s.t", "x", "direct", 0), ("n", "s.u", "z", "aggregate", 0)}),
    ],
)
def test_structures(spark, sql, want):
    assert edges(spark, sql) == want


@pytest.mark.parametrize(
    ("expression", "kind"),
    [
        ("'N'", "value"), ("SYSDATE", "value"), ("${X}", "value"), ("ROW_NUMBER() OVER (ORDER BY a.x)", "window"), ("SUM(CASE WHEN a.x = 1 THEN a.y END)", "pivot"), ("MAX(a.x)", "aggregate"), ("CASE WHEN a.x = 1 THEN 2 END", "case_when"),
        ("NVL(a.x, 0)", "fallback"), ("COALESCE(a.x, a.y)", "fallback"), ("a.x + NVL(a.y, 0)", "fallback"), ("a.x", "direct"), ("a.x || 'z'", "expression"), ("LISTAGG(a.x, ';')", "expression"), ("CAST(a.x AS INT)", "expression"),
    ],
)
def test_transforms(spark, expression, kind):
    f = frontend.parse(spark, f"SELECT {expression} AS o FROM s.t a")
    assert f.status[0], f.status[1]
    assert f.columns[0][4] == kind


@pytest.mark.parametrize("sql", ["", "garbage ((", "SELECT 1; SELECT 2", "DELETE FROM t", "SELECT \x00 FROM", "SELECT " + "(" * 50])
def test_failures_become_status(spark, sql):
    assert frontend.parse(spark, sql).status[0] is False


def test_joins_and_roles(spark):
    f = frontend.parse(spark, "SELECT a.x FROM s.t a, s.u b, s.v c WHERE a.k = b.k(+) AND a.j = c.j AND b.z(+) = 1 AND NOT EXISTS (SELECT 1 FROM s.w w WHERE w.k = a.k)")
    got = {r[3]: (r[5], r[6]) for r in f.refs}
    assert got["s.u"] == ("LEFT JOIN", "a.k = b.k AND b.z = 1")
    assert got["s.w"][0] == "FROM" and [r[7] for r in f.refs if r[3] == "s.w"] == ["secondary"]


def test_aliases(spark):
    f = frontend.parse(spark, "SELECT a.b, a.c AS D, a.e + 1 /* named */, 'N', CURRENT_TIMESTAMP, a.f * 2 FROM s.t a")
    assert [c[2] for c in f.columns] == ["b", "d", "named", "del_flag", "dw_last_update_date", "_col_5"]


def test_count_star_is_no_star(spark):
    assert frontend.parse(spark, "SELECT COUNT(*) AS n FROM s.t").status[2] is False
    assert frontend.parse(spark, "SELECT a.* FROM s.t a").status[2] is True


def test_literals_are_never_rewritten():
    sql = "SELECT 'SYSDATE PARTITION(p) ${x} ; -- (+)' AS a FROM t"
    assert prepass.clean(sql) == sql


def test_cycles_end(spark):
    from etlscope.operators.lineage import physical_sources

    rows = [("a", "x", "b", "x", "direct", "s1"), ("b", "x", "a", "x", "direct", "s2"), ("b", "x", "p", "y", "aggregate", "s2")]
    got = physical_sources(spark.createDataFrame(rows, "to_table string, to_field string, from_table string, from_field string, transform string, step_id string")).collect()
    assert {tuple(r) for r in got} == {("a", "x", "p", "y", "aggregate", 2), ("b", "x", "p", "y", "aggregate", 1)}


def test_stream_takes_each_run_once(spark, tmp_path):
    from etlscope.streaming.usage import ingest

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "run_id long, t string").selectExpr("run_id", "CAST(t AS TIMESTAMP) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, ts timestamp").parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
