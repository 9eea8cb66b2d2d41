"""The SCD2 pattern: a CTE that numbers rows to take the latest."""

from etlscope.operators import quality, topology
from etlscope.plans import facts
from test_depth import rule


def test_scd2_latest(spark):
    numbered = "SELECT n.n_name AS f, ROW_NUMBER() OVER (PARTITION BY n.n_regionkey ORDER BY n.n_nationkey DESC) AS rn FROM nation n"
    for sql, want in ((f"WITH x AS ({numbered}) SELECT x.f FROM x WHERE x.rn = 1", True), (f"SELECT x.f FROM ({numbered}) x WHERE x.rn = 1", False)):
        rules = spark.createDataFrame([rule("r", "t", sql)], facts.RULE)
        f = facts.extract(spark, rules)
        step = topology.steps(rules)
        got = quality.patterns(f, step, topology.self_references(step, topology.reads(f, step)))
        assert ("scd2_latest" in {r["pattern"] for r in got.collect()}) == want
