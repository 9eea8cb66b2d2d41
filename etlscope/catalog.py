"""A small rule catalog over the benchmark tables: three groups of warehouse rules, executable and parseable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.cut import local
from .plans.facts import RULE

R01 = """
SELECT o.o_orderkey AS order_id, o.o_custkey AS cust_id, SUM(l.l_extendedprice * (1 - l.l_discount)) AS rev, COUNT(*) AS n_lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey  -- one row an order; not ${a} parameter
GROUP BY o.o_orderkey, o.o_custkey
"""
R02 = """
SELECT c.c_custkey AS cust_id, c.c_name AS cust_name, NVL(n.n_name, 'none') AS nation, n.n_regionkey AS region_id
FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey(+) AND n.n_nationkey(+) < 20
"""
R03 = """
SELECT b.cust_id, b.cust_name, b.nation, b.region_id, SUM(t.rev) AS total_rev, SUM(CASE WHEN t.n_lines > 3 THEN t.rev ELSE 0 END) AS big_rev,
       DECODE(b.region_id, 0, 'A', 1, 'B', 'C') AS grade, 'N', SYSDATE
FROM tmp_order_rev PARTITION(p_main) t LEFT JOIN tmp_cust_base b ON t.cust_id = b.cust_id
WHERE t.rev > 0
GROUP BY b.cust_id, b.cust_name, b.nation, b.region_id
DISTRIBUTE BY HASH(cust_id)
"""
R05 = """
SELECT c.c_custkey AS cust_id, c.c_name AS cust_name, 'none' AS nation, c.c_nationkey AS region_id, 0 AS total_rev
FROM customer c WHERE NOT EXISTS (SELECT 1 FROM dws.dwb_customer_rev_f f WHERE f.cust_id = c.c_custkey)
"""
R06 = "SELECT f.cust_id, f.total_rev, f.nation FROM dws.dwb_customer_rev_f f"
R07 = """
WITH per_region AS (SELECT f.region_id, SUM(f.total_rev) AS rev, COUNT(DISTINCT f.cust_id) AS n_cust FROM dws.dwb_customer_rev_f f GROUP BY f.region_id),
named AS (SELECT p.region_id, p.rev, p.n_cust, r.r_name AS region FROM per_region p JOIN region r ON p.region_id = r.r_regionkey)
SELECT n.region_id, n.region, n.rev AS region_rev, n.n_cust /* customers */ FROM named n
"""
R08 = """
SELECT u.region, u.amount, ROW_NUMBER() OVER (PARTITION BY u.kind ORDER BY u.amount DESC, u.region) AS pos
FROM (SELECT m.region AS region, m.region_rev AS amount, 'r' AS kind FROM ads.dws_region_mid_f m
      UNION ALL SELECT x.n_name, x.n_nationkey, 'n' FROM nation x) u
"""
R10 = "SELECT m.region_id, m.region_rev FROM ads.dws_region_mid_f m WHERE m.region_rev > 10"
R11 = """
SELECT e.user_id, MAX(CASE WHEN e.event_type = 'click' THEN e.value END) AS last_click, LAG(MAX(e.value)) OVER (PARTITION BY MOD(e.user_id, 16) ORDER BY e.user_id) AS before_value,
       COALESCE(MIN(e.value), 0) AS least
FROM events e GROUP BY e.user_id HAVING COUNT(*) > 1
"""
R13 = "SELECT FROM WHERE ((("
R14 = "SELECT * FROM part p, supplier s WHERE p.p_size > ${MIN_SIZE}"

_COLUMNS = ("rule_code", "rule_name", "rule_type", "exec_sequence", "target_schema", "target_table", "delete_mode", "delete_condition", "query_sql", "rule_group_code", "rule_group_en", "exchange_source_table", "is_view_step")
_ROWS = [
    ("r01", "order revenue", 1, 1, "dws", "tmp_order_rev", "1", "", R01, "G1", "customers", "", False),
    ("r02", "customer base", 1, 1, "dws", "TMP_CUST_BASE", "1", "", R02, "G1", "customers", "", False),
    ("r04", "clear target", 2, 1, "dws", "dwb_customer_rev_f", "4", "dt = 1", "", "G1", "customers", "", False),
    ("r03", "customer revenue", 1, 2, "dws", "dwb_customer_rev_f", "5", "p_main", R03, "G1", "customers", "", False),
    ("r05", "customers without orders", 1, 3, "dws", "dwb_customer_rev_f", "5", "p_rest", R05, "G1", "customers", "", False),
    ("r06", "view", 1, 4, "dws", "dwb_customer_rev_i", "2", "", R06, "G1", "customers", "", True),
    ("r07", "region revenue", 1, 1, "ads", "dws_region_mid_f", "1", "", R07, "G2", "regions", "", False),
    ("r08", "region report", 1, 2, "ads", "ads_region_rpt_f", "1", "", R08, "G2", "regions", "", False),
    ("r10", "exchange staging", 1, 2, "ads", "tmp_region_x", "1", "", R10, "G2", "regions", "", False),
    ("r09", "exchange", 9, 3, "ads", "tmp_region_x", "5", "", "", "G2", "regions", "ads.ads_region_x_f", False),
    ("r11", "event users", 1, 1, "ads", "dwb_event_f", "4", "", R11, "G3", "events", "", False),
    ("r13", "broken", 1, 2, "ads", "broken_f", "1", "", R13, "G3", "events", "", False),
    ("r14", "everything", 14, 2, "ads", "ads_all_f", "1", "", R14, None, "solo", "", False),
]


def rules(spark: SparkSession) -> DataFrame:
    rows = []
    for i, r in enumerate(_ROWS):
        x = dict(zip(_COLUMNS, r, strict=True)) | {"project_code": "P1", "data_source": "DS1", "business_owner": "owner", "row_ord": i}
        rows.append(tuple(x[c.split()[0]] for c in RULE.replace("\n", " ").split(", ")))
    return local(spark, rows, RULE)


TARGET_FIELDS = [
    ("r03", "cust_id", "cust_id", "bigint"), ("r03", "cust_name", "cust_name", "varchar(10)"), ("r03", "nation", "nation", "varchar(30)"), ("r03", "region_id", "region_id", "int"),
    ("r03", "total_rev", "total_rev", "numeric(18,2)"), ("r03", "grade_cd", "grade", "varchar(1)"), ("r03", "DEL_FLAG", "", "varchar(1)"), ("r08", "region", "region", "varchar(25)"), ("r08", "amount", "amount", "numeric(18,2)"),
]
#: DDL columns: table, column, type.
DDL = [
    ("customer", "c_custkey", "bigint"), ("customer", "c_name", "varchar(25)"), ("customer", "c_nationkey", "int"), ("customer", "c_mktsegment", "varchar(10)"),
    ("nation", "n_name", "varchar(25)"), ("nation", "n_regionkey", "int"), ("nation", "n_nationkey", "int"), ("region", "r_name", "varchar(25)"), ("region", "r_regionkey", "int"),
    ("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"), ("lineitem", "l_extendedprice", "numeric(15,2)"), ("lineitem", "l_discount", "numeric(15,2)"),
    ("dwb_customer_rev_f", "cust_id", "bigint"), ("dwb_customer_rev_f", "cust_name", "varchar(10)"), ("dwb_customer_rev_f", "nation", "varchar(30)"), ("dwb_customer_rev_f", "region_id", "smallint"),
    ("dwb_customer_rev_f", "total_rev", "numeric(18,2)"), ("dwb_customer_rev_f", "del_flag", "varchar(1)"), ("tmp_cust_base", "cust_name", "varchar(25)"), ("tmp_cust_base", "cust_id", "bigint"),
    ("tmp_cust_base", "nation", "varchar(25)"), ("tmp_cust_base", "region_id", "int"), ("dws_region_mid_f", "region_id", "int"), ("dws_region_mid_f", "region_rev", "numeric(38,2)"),
]
TABLE_CHANGES = [
    ("nation", "", False, "", None), ("part_old", "part_new", False, "", None), ("supplier", "supplier2", True, "", None), ("region", "region", False, "", "表/视图数据归档"),
]
FIELD_CHANGES = [
    ("customer", "c_name", "varchar(25)", "customer", "c_name", "varchar(60)", "字段类型及长度变化"), ("customer", "c_custkey", "bigint", "customer", "c_custkey", "varchar(20)", "字段类型及长度变化"),
    ("orders", "o_custkey", "bigint", "orders", "o_custkey", "bigint", "字段值语义变化"), ("lineitem", "l_discount", "numeric(15,2)", "", "", "", "1:0废弃字段"),
    ("orders", "o_clerk", "varchar(15)", "orders", "o_clerk", "varchar(30)", "字段类型及长度变化"), ("web_log", "url", "text", "web_log", "url", "text", "字段名称变化"),
    ("customer", "c_nationkey", "int", "customer", "c_nationkey", "int", "字段数据初始化（不刷时间戳）"), ("nation", "n_name", "varchar(25)", "", "", "", "1:0废弃字段"),
]
