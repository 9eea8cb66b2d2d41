"""Field changes of tables that a SELECT * reads."""

from etlscope.operators import impact
from etlscope.queries import _analysis


def test_star_readers_are_to_be_confirmed(spark):
    a = _analysis(spark)
    schema = "before_table string, before_field string, before_type string, after_table string, after_field string, after_type string, change_type string"
    rows = [("part", "p_name", "text", "part", "p_name", "text", "1:0废弃字段"), ("part", "p_new", "", "part", "p_new", "int", "0:1新增字段"), ("web_log", "url", "text", "web_log", "url", "text", "字段名称变化")]
    got = impact.field_status(spark.createDataFrame(rows, schema), a.table_changes.limit(0), a.sources(), a.read, a.ddl, a.table_strategy(), impact.star_reads(a.facts.status, a.read))
    assert {tuple(r) for r in got.select("before_field", "table", "field", "status").collect()} == {("p_name", "ads_all_f", None, "confirm"), ("p_new", "ads_all_f", None, "confirm"), ("url", None, None, "not_hit")}
