"""Registered queries and their SQL equivalents: executed vendor SQL (a_), rule metadata (b_), usage analytics (c_)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, catalog
from .functions import names
from .operators import impact, lineage, quality, search, topology, usage
from .plans import execute, facts
from .plans.cut import cut, local

Query = Callable[[SparkSession, str], DataFrame]

# --- executed vendor SQL: name -> (vendor text, the same in standard SQL) ------------------------------------------

D = "CAST({} AS DECIMAL(18,2))"
EXECUTED: dict[str, tuple[str, str]] = {
    "a08_table_alias": ("SELECT n_name, nation.n_regionkey FROM nation WHERE n_nationkey < 7", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 7"),
    "a02_comments": (
        "SELECT /* all of it; */ r_name AS name, '-- not a comment; ' || r_name AS label -- tail ; \n FROM region /* x */ WHERE r_name <> ';'",
        "SELECT r_name AS name, '-- not a comment; ' || r_name AS label FROM region WHERE r_name <> ';'",
    ),
    "a03_vendor_clauses": (
        "SELECT o.o_orderpriority AS prio, COUNT(*) AS n FROM orders PARTITION(p_2020) o GROUP BY o.o_orderpriority DISTRIBUTE BY HASH(prio) TO GROUP g1",
        "SELECT o_orderpriority AS prio, COUNT(*) AS n FROM orders GROUP BY 1",
    ),
    "a04_placeholders": (
        "SELECT n.n_nationkey AS k, '${CYCLE}' AS c1, ${RUN_ID} AS c2, #tag# AS c3 FROM nation n WHERE n.n_name <> ${NAME}",
        "SELECT n_nationkey AS k, '${CYCLE}' AS c1, '${RUN_ID}' AS c2, '#tag#' AS c3 FROM nation WHERE n_name <> '${NAME}'",
    ),
    "a05_statement_guard": ("  ; SELECT r_regionkey AS k, 'a;b' AS s FROM region; ;", "SELECT r_regionkey AS k, 'a;b' AS s FROM region"),
    "a09_join_kinds": (
        "SELECT n.n_name AS nation, r.r_name AS region, COUNT(c.c_custkey) AS n_cust, COUNT(s.s_suppkey) AS n_supp FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey "
        "LEFT OUTER JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000 LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name",
        "SELECT n.n_name AS nation, r.r_name AS region, COUNT(c.c_custkey) AS n_cust, COUNT(s.s_suppkey) AS n_supp FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey "
        "LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000 LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2",
    ),
    "a09_full_join": (
        "SELECT a.k AS ka, b.k AS kb FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 9) a FULL OUTER JOIN (SELECT r_regionkey * 4 AS k FROM region) b ON a.k = b.k",
        "SELECT a.k AS ka, b.k AS kb FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 9) a FULL JOIN (SELECT r_regionkey * 4 AS k FROM region) b ON a.k = b.k",
    ),
    "a10_comma_join": (
        "SELECT r.r_name AS region, COUNT(*) AS n FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        "SELECT r_name AS region, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "a11_outer_plus": (
        "SELECT n.n_name AS nation, COUNT(s.s_suppkey) AS n FROM nation n, supplier s, region r WHERE n.n_nationkey = s.s_nationkey(+) AND s.s_acctbal(+) > 0 AND n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3 GROUP BY n.n_name",
        "SELECT n_name AS nation, COUNT(s_suppkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 WHERE r_regionkey < 3 GROUP BY 1",
    ),
    "a12_alias_rules": ("SELECT n.n_nationkey, n.n_name AS Title, n.n_regionkey + 1 /* next_key */, 'N', 7 FROM nation n", "SELECT n_nationkey, n_name AS title, n_regionkey + 1 AS next_key, 'N' AS del_flag, 7 AS _col_4 FROM nation"),
    "a15_group_having": (
        "SELECT o.o_orderstatus AS st, COUNT(*) AS n, MAX(o.o_custkey) AS m FROM orders o WHERE o.o_totalprice > 1000 GROUP BY o.o_orderstatus HAVING COUNT(*) > 5",
        "SELECT o_orderstatus AS st, COUNT(*) AS n, MAX(o_custkey) AS m FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING COUNT(*) > 5",
    ),
    "a17_union_all": (
        "SELECT c.c_nationkey AS k, 'c' AS src FROM customer c UNION ALL SELECT s.s_nationkey, 's' FROM supplier s",
        "SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
    ),
    "a17_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "a17_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "a17_minus": ("SELECT c_custkey AS k FROM customer MINUS SELECT s_suppkey * 2 FROM supplier", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey * 2 FROM supplier"),
    "a18_union_in_subquery": (
        "SELECT u.src AS src, SUM(u.n) AS total FROM (SELECT 'c' AS src, COUNT(*) AS n FROM customer c GROUP BY c.c_nationkey UNION ALL SELECT 's', COUNT(*) FROM supplier s GROUP BY s.s_nationkey) u GROUP BY u.src",
        "SELECT 'c' AS src, CAST(COUNT(*) AS BIGINT) AS total FROM customer UNION ALL SELECT 's', COUNT(*) FROM supplier",
    ),
    "a19_cte": (
        f"WITH rev AS (SELECT l.l_suppkey AS k, SUM({D.format('l.l_extendedprice')}) AS v FROM lineitem l GROUP BY l.l_suppkey) SELECT s.s_name AS name, CAST(rev.v AS DOUBLE) AS revenue FROM supplier s LEFT JOIN rev ON rev.k = s.s_suppkey",
        f"SELECT s_name AS name, CAST(SUM({D.format('l_extendedprice')}) AS DOUBLE) AS revenue FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name",
    ),
    "a21_nested_cte": (
        "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT a.n AS orders_per, COUNT(*) AS customers FROM a GROUP BY a.n) SELECT b.orders_per, b.customers FROM b WHERE b.customers > 1",
        "SELECT n AS orders_per, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) GROUP BY n HAVING COUNT(*) > 1",
    ),
    "a22_from_subquery": (
        "SELECT q.region AS region, q.best AS best FROM (SELECT x.region AS region, MAX(x.bal) AS best FROM (SELECT r.r_name AS region, c.c_acctbal AS bal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey) x GROUP BY x.region) q",
        "SELECT r_name AS region, MAX(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
    "a24_exists": (
        "SELECT c.c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
        "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    ),
    "a28_pivot": (
        "SELECT e.user_id AS u, SUM(CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END) AS clicks, SUM(CASE WHEN e.event_type = 'view' THEN 1 ELSE 0 END) AS views, SUM(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END) AS buys FROM events e GROUP BY e.user_id",
        "SELECT user_id AS u, COUNT(*) FILTER (event_type = 'click') AS clicks, COUNT(*) FILTER (event_type = 'view') AS views, COUNT(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY 1",
    ),
    "a28_window_latest": (
        "SELECT q.u, q.event_id, q.prev_id, q.rk FROM (SELECT e.user_id AS u, e.event_id, ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rn, LAG(e.event_id) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS prev_id, DENSE_RANK() OVER (PARTITION BY e.event_type ORDER BY e.user_id) AS rk FROM events e) q WHERE q.rn = 1",
        "SELECT u, event_id, prev_id, rk FROM (SELECT user_id AS u, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id, DENSE_RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS rk FROM events) WHERE rn = 1",
    ),
    "a30_fallbacks": (
        "SELECT n.n_name AS name, NVL(s.k, -1) AS a, COALESCE(s.k, n.n_regionkey) AS b, IFNULL(s.k, 0) AS c FROM nation n LEFT JOIN (SELECT s_nationkey AS nk, MIN(s_suppkey) AS k FROM supplier GROUP BY s_nationkey) s ON s.nk = n.n_nationkey",
        "SELECT n_name AS name, COALESCE(k, -1) AS a, COALESCE(k, n_regionkey) AS b, COALESCE(k, 0) AS c FROM nation LEFT JOIN (SELECT s_nationkey AS nk, MIN(s_suppkey) AS k FROM supplier GROUP BY 1) s ON nk = n_nationkey",
    ),
    "a_scalar_functions": (
        "SELECT o.o_orderkey AS k, DECODE(o.o_orderstatus, 'F', 'done', 'O', 'open', 'other') AS st, TO_CHAR(o.o_orderdate, 'YYYYMM') AS ym, SUBSTR(o.o_orderpriority, 1, 1) AS p, CAST(TO_NUMBER(SUBSTR(o.o_orderpriority, 1, 1)) AS INT) AS pn, CONVERT(INT, o.o_custkey / 2) AS half FROM orders o",
        "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS st, strftime(o_orderdate, '%Y%m') AS ym, substr(o_orderpriority, 1, 1) AS p, CAST(substr(o_orderpriority, 1, 1) AS INT) AS pn, CAST(trunc(o_custkey / 2) AS INT) AS half FROM orders",
    ),
    "a_listagg": (
        "SELECT r.r_name AS region, LISTAGG(n.n_name, ';') WITHIN GROUP (ORDER BY n.n_name) AS nations FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
        "SELECT r_name AS region, string_agg(n_name, ';' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
    "a_top_k": ("SELECT c.c_custkey AS k, c.c_acctbal AS bal FROM customer c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer ORDER BY 2 DESC, 1 LIMIT 10"),
    "a_recursive_cte": (
        "WITH RECURSIVE t(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT t.k + 3, t.d + 1 FROM t WHERE t.k + 3 < 25) SELECT k, d FROM t",
        "WITH RECURSIVE t(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT t.k + 3, t.d + 1 FROM t WHERE t.k + 3 < 25) SELECT k, d FROM t",
    ),
}


def _executed(vendor: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        execute.register(spark, sf_dir)
        return execute.run_sql(spark, vendor)

    return run


def _rule_rows() -> list[dict]:
    columns = [*catalog._COLUMNS, "row_ord"]
    return [dict(zip(columns, (*r, i), strict=True)) for i, r in enumerate(catalog._ROWS)]


def a_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules r01, r02 and r03, run in sequence through the front end; revenue is summed exactly, as it may end in a half that rounds."""
    execute.register(spark, sf_dir)
    execute.exact(spark, "lineitem", "l_extendedprice", "l_discount")
    out = execute.run_rules(spark, [r for r in _rule_rows() if r["rule_code"] in ("r01", "r02", "r03")], "r03")
    return out.select("cust_id", "cust_name", "nation", "region_id", F.round("total_rev", 0).cast("long").alias("total_rev"), F.round("big_rev", 0).cast("long").alias("big_rev"), "grade", "del_flag")


A_PIPELINE = """
WITH o AS (SELECT o_orderkey, o_custkey AS cust_id, SUM(l_extendedprice * (1 - l_discount)) AS rev, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT c_custkey AS cust_id, c_name AS cust_name, COALESCE(n_name, 'none') AS nation, n_regionkey AS region_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20)
SELECT b.cust_id, cust_name, nation, region_id, CAST(round(SUM(rev), 0) AS BIGINT) AS total_rev, CAST(round(SUM(CASE WHEN n > 3 THEN rev ELSE 0 END), 0) AS BIGINT) AS big_rev,
  CASE region_id WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS grade, 'N' AS del_flag
FROM o LEFT JOIN b ON o.cust_id = b.cust_id WHERE rev > 0 GROUP BY 1, 2, 3, 4, 7
"""

def a_pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule groups in a row: the customer table with its second writer, then the region tables up to the report."""
    execute.register(spark, sf_dir)
    rules = [r | {"exec_sequence": r["exec_sequence"] + (10 if r["rule_group_code"] == "G2" else 0)} for r in _rule_rows() if r["rule_code"] in ("r01", "r02", "r03", "r05", "r06", "r07", "r08")]
    return execute.run_rules(spark, rules, "r08").select("region", F.round("amount", 2).cast("double").alias("amount"), "pos")


A_PIPELINE_REPORT = """
WITH o AS (SELECT o_orderkey, o_custkey AS cust_id, SUM(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT c_custkey AS cust_id, n_regionkey AS region_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20),
f AS (SELECT b.cust_id, region_id, SUM(rev) AS total_rev FROM o LEFT JOIN b ON o.cust_id = b.cust_id WHERE rev > 0 GROUP BY 1, 2),
g AS (SELECT * FROM f UNION ALL SELECT c_custkey, c_nationkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT cust_id FROM f WHERE cust_id IS NOT NULL)),
u AS (SELECT r_name AS region, SUM(total_rev) AS amount, 'r' AS kind FROM g JOIN region ON region_id = r_regionkey GROUP BY 1 UNION ALL SELECT n_name, n_nationkey, 'n' FROM nation)
SELECT region, round(amount, 2) AS amount, CAST(row_number() OVER (PARTITION BY kind ORDER BY amount DESC, region) AS INT) AS pos FROM u
"""

# --- rule metadata ---------------------------------------------------------------------------------------------------

#: The input facts of the catalog, written by hand from its SQL, for the equivalents below.
FACTS = """
WITH RECURSIVE step(step_id, step_no, rule_code, rule_type, seq, target, mode, cond, grp, exchanged) AS (VALUES
 ('step_1',1,'r01',1,1,'dws.tmp_order_rev','1','','G1',NULL), ('step_2',2,'r02',1,1,'dws.tmp_cust_base','1','','G1',NULL), ('step_3',3,'r04',2,1,'dws.dwb_customer_rev_f','4','dt = 1','G1',NULL),
 ('step_4',4,'r03',1,2,'dws.dwb_customer_rev_f','5','p_main','G1',NULL), ('step_5',5,'r05',1,3,'dws.dwb_customer_rev_f','5','p_rest','G1',NULL), ('step_6',6,'r06',1,4,'dws.dwb_customer_rev_i','2','','G1',NULL),
 ('step_7',7,'r07',1,1,'ads.dws_region_mid_f','1','','G2',NULL), ('step_8',8,'r08',1,2,'ads.ads_region_rpt_f','1','','G2',NULL), ('step_9',9,'r10',1,2,'ads.tmp_region_x','1','','G2',NULL),
 ('step_10',10,'r09',9,3,'ads.ads_region_x_f','5','','G2','ads.tmp_region_x'), ('step_11',11,'r11',1,1,'ads.dwb_event_f','4','','G3',NULL), ('step_12',12,'r13',1,2,'ads.broken_f','1','','G3',NULL),
 ('step_13',13,'r14',14,2,'ads.ads_all_f','1','','_SOLO_r14',NULL)),
reads(step_id, source) AS (VALUES ('step_1','lineitem'), ('step_1','orders'), ('step_2','customer'), ('step_2','nation'), ('step_4','tmp_order_rev'), ('step_4','tmp_cust_base'), ('step_5','customer'), ('step_5','dws.dwb_customer_rev_f'),
 ('step_6','dws.dwb_customer_rev_f'), ('step_7','dws.dwb_customer_rev_f'), ('step_7','region'), ('step_8','ads.dws_region_mid_f'), ('step_8','nation'), ('step_9','ads.dws_region_mid_f'), ('step_11','events'), ('step_13','part'), ('step_13','supplier')),
edges(rule_code, tt, tf, st, sf, rk) AS (VALUES
 ('r01','tmp_order_rev','order_id','orders','o_orderkey',1), ('r01','tmp_order_rev','cust_id','orders','o_custkey',1), ('r01','tmp_order_rev','rev','lineitem','l_extendedprice',5), ('r01','tmp_order_rev','rev','lineitem','l_discount',5),
 ('r02','tmp_cust_base','cust_id','customer','c_custkey',1), ('r02','tmp_cust_base','cust_name','customer','c_name',1), ('r02','tmp_cust_base','nation','nation','n_name',3), ('r02','tmp_cust_base','region_id','nation','n_regionkey',1),
 ('r03','dwb_customer_rev_f','cust_id','tmp_cust_base','cust_id',1), ('r03','dwb_customer_rev_f','cust_name','tmp_cust_base','cust_name',1), ('r03','dwb_customer_rev_f','nation','tmp_cust_base','nation',1), ('r03','dwb_customer_rev_f','region_id','tmp_cust_base','region_id',1),
 ('r03','dwb_customer_rev_f','total_rev','tmp_order_rev','rev',5), ('r03','dwb_customer_rev_f','big_rev','tmp_order_rev','rev',6), ('r03','dwb_customer_rev_f','big_rev','tmp_order_rev','n_lines',6), ('r03','dwb_customer_rev_f','grade','tmp_cust_base','region_id',2),
 ('r05','dwb_customer_rev_f','cust_id','customer','c_custkey',1), ('r05','dwb_customer_rev_f','cust_name','customer','c_name',1), ('r05','dwb_customer_rev_f','region_id','customer','c_nationkey',1),
 ('r06','dwb_customer_rev_i','cust_id','dwb_customer_rev_f','cust_id',1), ('r06','dwb_customer_rev_i','total_rev','dwb_customer_rev_f','total_rev',1), ('r06','dwb_customer_rev_i','nation','dwb_customer_rev_f','nation',1),
 ('r07','dws_region_mid_f','region_id','dwb_customer_rev_f','region_id',1), ('r07','dws_region_mid_f','region','region','r_name',1), ('r07','dws_region_mid_f','region_rev','dwb_customer_rev_f','total_rev',5), ('r07','dws_region_mid_f','n_cust','dwb_customer_rev_f','cust_id',5),
 ('r08','ads_region_rpt_f','region','dws_region_mid_f','region',1), ('r08','ads_region_rpt_f','region','nation','n_name',1), ('r08','ads_region_rpt_f','amount','dws_region_mid_f','region_rev',1), ('r08','ads_region_rpt_f','amount','nation','n_nationkey',1),
 ('r08','ads_region_rpt_f','pos','dws_region_mid_f','region_rev',7), ('r08','ads_region_rpt_f','pos','nation','n_nationkey',7), ('r08','ads_region_rpt_f','pos','dws_region_mid_f','region',7), ('r08','ads_region_rpt_f','pos','nation','n_name',7),
 ('r10','tmp_region_x','region_id','dws_region_mid_f','region_id',1), ('r10','tmp_region_x','region_rev','dws_region_mid_f','region_rev',1), ('r09','ads_region_x_f','region_id','tmp_region_x','region_id',1), ('r09','ads_region_x_f','region_rev','tmp_region_x','region_rev',1),
 ('r11','dwb_event_f','user_id','events','user_id',1), ('r11','dwb_event_f','last_click','events','event_type',6), ('r11','dwb_event_f','last_click','events','value',6), ('r11','dwb_event_f','before_value','events','value',7), ('r11','dwb_event_f','before_value','events','user_id',7), ('r11','dwb_event_f','least','events','value',5)),
keys(step_id, tab, fld) AS (VALUES ('step_4','tmp_order_rev','cust_id'), ('step_4','tmp_cust_base','cust_id'), ('step_7','dwb_customer_rev_f','region_id')),
used(rule_code, kind, field) AS (VALUES ('r01','join','l_orderkey'), ('r01','join','o_orderkey'), ('r01','group','o_orderkey'), ('r01','group','o_custkey'), ('r02','join','c_nationkey'), ('r02','join','n_nationkey'), ('r03','join','cust_id'), ('r03','where','rev'),
 ('r03','group','cust_id'), ('r03','group','cust_name'), ('r03','group','nation'), ('r03','group','region_id'), ('r05','where','cust_id'), ('r05','where','c_custkey'), ('r07','group','region_id'), ('r07','join','region_id'), ('r07','join','r_regionkey'), ('r10','where','region_rev'),
 ('r11','group','user_id'), ('r14','where','p_size')),
histogram(rule_code, transform, n) AS (VALUES ('r01','aggregate',2), ('r01','direct',2), ('r02','direct',3), ('r02','fallback',1), ('r03','aggregate',1), ('r03','direct',4), ('r03','expression',1), ('r03','pivot',1), ('r03','value',2), ('r05','direct',3), ('r05','value',2), ('r06','direct',3),
 ('r07','direct',4), ('r08','direct',2), ('r08','window',1), ('r10','direct',2), ('r11','aggregate',1), ('r11','direct',1), ('r11','pivot',1), ('r11','window',1), ('r14','expression',1)),
outs AS (SELECT rule_code, tf AS field FROM edges WHERE rule_code <> 'r09' UNION SELECT * FROM (VALUES ('r01','n_lines'), ('r03','del_flag'), ('r03','dw_last_update_date'), ('r05','nation'), ('r05','total_rev'), ('r14','_col_0'))),
dep AS (
 SELECT DISTINCT w.step_id AS from_step, r.step_id AS to_step, r.source AS tab, 'data' AS kind FROM reads r JOIN step w ON w.rule_type IN (1, 14) AND split_part('.' || r.source, '.', -1) = split_part('.' || w.target, '.', -1) AND w.step_id <> r.step_id
 UNION SELECT w.step_id, x.step_id, x.exchanged, 'exchange' FROM step x JOIN step w ON w.rule_type IN (1, 14) AND w.target = x.exchanged AND w.step_id <> x.step_id),
flow(tt, tf, st, sf, rk, d, seen) AS (
 SELECT DISTINCT tt, tf, st, sf, rk, 1, [tt || '.' || tf, st || '.' || sf] FROM edges
 UNION ALL SELECT f.tt, f.tf, e.st, e.sf, greatest(f.rk, e.rk), f.d + 1, list_append(f.seen, e.st || '.' || e.sf) FROM flow f JOIN edges e ON e.tt = f.st AND e.tf = f.sf WHERE NOT list_contains(f.seen, e.st || '.' || e.sf) AND f.d < 15),
leaf AS (SELECT tt, tf, st, sf, max(rk) AS rk, min(d) AS d FROM flow WHERE st NOT IN (SELECT tt FROM edges) GROUP BY 1, 2, 3, 4)
"""
RANK_NAME = "['unknown','value','direct','expression','fallback','case_when','aggregate','pivot','window'][{} + 2]"


def _family_sql(c: str) -> str:
    base = f"trim(regexp_extract(lower({c}), '^[a-z0-9 ]+'))"
    return "CASE " + " ".join(f"WHEN {base} IN ({', '.join(repr(x) for x in spellings)}) THEN '{family}'" for family, spellings in names.FAMILIES.items()) + " ELSE 'unknown' END"


def _compatible_sql(s: str, t: str) -> str:
    """The type compatibility rule in standard SQL, over two columns of type text."""
    length = lambda c: f"TRY_CAST(regexp_extract({c}, '\\(\\s*(\\d+)', 1) AS INT)"
    scale = lambda c: f"TRY_CAST(regexp_extract({c}, ',\\s*(\\d+)', 1) AS INT)"
    digits = f"CASE WHEN {s} = 'bigint' THEN 19 WHEN {s} = 'smallint' THEN 5 WHEN {s} = 'tinyint' THEN 3 ELSE 10 END"
    sf, tf, sl, tl = _family_sql(s), _family_sql(t), length(s), length(t)
    return (
        f"CASE WHEN ({sf}) = 'integer' AND ({tf}) = 'integer' THEN true WHEN ({sf}) = 'integer' AND ({tf}) = 'numeric' THEN {tl} IS NULL OR {tl} >= coalesce({sl}, {digits}) WHEN ({sf}) <> ({tf}) THEN false "
        f"WHEN {tl} IS NULL OR {sl} IS NULL THEN true WHEN ({sf}) = 'varchar' THEN {tl} >= {sl} WHEN ({sf}) = 'numeric' THEN {tl} >= {sl} AND coalesce({scale(t)} >= {scale(s)}, true) ELSE true END"
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


class Analysis:
    """The catalog's facts and what most operators need of them; each made when first asked for, once a session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rules = catalog.rules(spark)
        self.ddl = local(spark, catalog.DDL, "table string, column string, type string")
        self.facts = facts.extract(spark, self.rules, ddl=self.ddl)
        self.edges = self.facts.edges
        self.strategy = topology.load_strategy(self.rules)

    @cached_property
    def step(self) -> DataFrame:
        return cut(topology.steps(self.rules))

    @cached_property
    def read(self) -> DataFrame:
        return cut(topology.reads(self.facts, self.step))

    @cached_property
    def dep(self) -> DataFrame:
        return cut(topology.dependencies(self.step, self.read))

    @cached_property
    def selfs(self) -> DataFrame:
        return topology.self_references(self.step, self.read)

    @cached_property
    def over(self) -> DataFrame:
        return topology.over_constraints(self.step, self.dep)

    @cached_property
    def declared(self) -> DataFrame:
        return local(self.spark, catalog.TARGET_FIELDS, "rule_code string, target_field string, source_field string, field_type string")

    @cached_property
    def mapping(self) -> DataFrame:
        return quality.field_mapping(self.facts, self.declared)

    @cached_property
    def table_changes(self) -> DataFrame:
        return local(self.spark, catalog.TABLE_CHANGES, "before_table string, after_table string, is_ping_cut boolean, note string, change_type string")

    @cached_property
    def field_changes(self) -> DataFrame:
        return local(self.spark, catalog.FIELD_CHANGES, "before_table string, before_field string, before_type string, after_table string, after_field string, after_type string, change_type string")

    @cached_property
    def hops(self) -> DataFrame:
        return lineage.step_edges(self.edges, self.step, self.facts.outputs)

    @cached_property
    def traced(self) -> DataFrame:
        return cut(lineage.physical_sources(self.hops))

    def sources(self) -> DataFrame:
        return self.traced

    def issues(self) -> DataFrame:
        return quality.issues(self.facts, self.mapping, self.selfs, self.over, self.step)

    @cached_property
    def chained(self) -> DataFrame:
        return cut(search.group_edges(self.step, self.read, search.target_index(self.rules)))

    def group_edges(self) -> DataFrame:
        return self.chained

    def table_strategy(self) -> DataFrame:
        owners = self.step.select(names.short_name(F.col("target")).alias("table"), "group_code").distinct()
        return owners.join(self.strategy.select("group_code", "strategy"), "group_code").groupBy("table").agg(F.max("strategy").alias("strategy"))

    def field_impact(self) -> DataFrame:
        stars, casts = impact.star_reads(self.facts.status, self.read), impact.cast_gates(self.edges, self.step)
        return impact.field_status(self.field_changes, self.table_changes, self.sources(), self.read, self.ddl, self.table_strategy(), stars, casts)

    def result(self) -> api.Result:
        return api.Result(self.facts, self.step, self.read, self.dep, self.edges, self.sources(), self.mapping, self.issues(), self.strategy, topology.scenarios(self.step))


@cache
def _analysis(spark: SparkSession) -> Analysis:
    return Analysis(spark)


def _meta(f: Callable[[Analysis], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_analysis(spark))


TYPE_GRID = [
    ("varchar(10)", "varchar(20)"), ("varchar(20)", "varchar(10)"), ("int", "bigint"), ("bigint", "int"), ("int", "numeric(10,0)"), ("int", "numeric(9,0)"), ("bigint", "numeric(18,0)"), ("bigint", "numeric(19,0)"), ("smallint", "numeric(5)"),
    ("numeric(10,2)", "numeric(12,2)"), ("numeric(10,2)", "numeric(12,1)"), ("numeric(12,2)", "numeric(10,2)"), ("int", "varchar(10)"), ("text", "varchar(10)"), ("character varying(30)", "nvarchar2(30)"), ("date", "timestamp"), ("date", "text"), ("boolean", "bool"),
]

AFFECTED = ("dws.dwb_customer_rev_f", "ADS.ads_region_rpt_f", "nowhere_f")
FIELD_IMPACT = f"""
 SELECT c.b AS before_table, c.f AS before_field, c.t AS change_type, l.tt AS tab, l.tf AS field, CASE WHEN l.tt IS NULL THEN 'not_hit' WHEN c.t LIKE '%初始化（不刷%' THEN CASE WHEN l.tt IN (SELECT split_part(target, '.', -1) FROM step WHERE grp = 'G2') THEN 'no_impact' ELSE 'impact' END
   WHEN c.t = '字段类型及长度变化' THEN CASE WHEN d.k IS NULL THEN 'confirm' WHEN {_compatible_sql('c.a', 'd.k')} THEN 'no_impact' ELSE 'impact' END WHEN c.t = '1:0废弃字段' THEN 'impact' ELSE 'confirm' END AS status
 FROM (SELECT col0 AS b, col1 AS f, col5 AS a, col6 AS t FROM (VALUES {_values(catalog.FIELD_CHANGES)}) WHERE col0 NOT IN ('nation', 'part_old', 'supplier', 'region')) c
 LEFT JOIN leaf l ON l.st = c.b AND l.sf = c.f LEFT JOIN (SELECT col0 AS t, col1 AS c, col2 AS k FROM (VALUES {_values(catalog.DDL)})) d ON d.t = l.tt AND d.c = l.tf"""

META: dict[str, tuple[Callable[[Analysis], DataFrame], str]] = {
    "b20_steps": (lambda a: a.step.select("step_id", "rule_code", "rule_type", "exec_sequence", "target", "exchanged", "group_code"), FACTS + "SELECT step_id, rule_code, rule_type, seq AS exec_sequence, target, exchanged, grp AS group_code FROM step"),
    "b20_step_tables": (lambda a: a.read.select("step_id", "source"), FACTS + "SELECT step_id, source FROM reads"),
    "b21_schedule": (lambda a: topology.schedule(a.step), FACTS + "SELECT grp AS group_code, seq AS exec_sequence, string_agg(step_id, ',' ORDER BY step_no) AS steps, count(*) AS n_steps FROM step GROUP BY 1, 2"),
    "b22_dependencies": (lambda a: a.dep.withColumnRenamed("table", "tab"), FACTS + "SELECT * FROM dep"),
    "b24_delete_before_write": (
        lambda a: topology.delete_before_write(a.step, a.dep).select("from_step", "to_step"),
        FACTS + "SELECT d.step_id AS from_step, w.step_id AS to_step FROM step d JOIN step w ON d.rule_type = 2 AND w.rule_type IN (1, 14) AND d.target = w.target AND w.seq > d.seq WHERE NOT EXISTS (SELECT 1 FROM dep WHERE from_step = d.step_id AND to_step = w.step_id)",
    ),
    "b25_self_references": (lambda a: a.selfs.select("step_id", F.col("table").alias("tab"), "pattern"), FACTS + "SELECT s.step_id, s.target AS tab, 'EXISTS' AS pattern FROM step s JOIN reads r ON r.step_id = s.step_id AND r.source = s.target WHERE s.rule_type <> 2"),
    "b26_implicit": (
        lambda a: topology.implicit_dependencies(a.step, a.read, a.selfs, a.dep.where("kind <> 'data' or to_step not in ('step_5', 'step_6')")).withColumnRenamed("table", "tab"),
        FACTS + ", kn AS (SELECT * FROM dep WHERE kind <> 'data' OR to_step NOT IN ('step_5', 'step_6')), w AS (SELECT step_id, seq, target, split_part(target, '.', -1) AS k FROM step WHERE rule_type IN (1, 14)), "
        "rd AS (SELECT DISTINCT r.step_id, s.seq, split_part('.' || r.source, '.', -1) AS k FROM reads r JOIN step s USING (step_id)), "
        "pr AS (SELECT x.step_id AS a, y.step_id AS b, x.target AS t FROM w x JOIN w y ON x.target = y.target AND x.seq < y.seq) "
        "SELECT w.step_id AS from_step, rd.step_id AS to_step, w.target AS tab, 'reader' AS kind FROM rd JOIN w USING (k) WHERE rd.seq > (SELECT max(seq) FROM w v WHERE v.k = rd.k) AND NOT EXISTS (SELECT 1 FROM w v WHERE v.k = rd.k AND v.step_id = rd.step_id) AND rd.step_id NOT IN (SELECT to_step FROM kn) "
        "UNION ALL SELECT a, b, t, CASE WHEN EXISTS (SELECT 1 FROM reads r WHERE r.step_id = b AND split_part('.' || r.source, '.', -1) = split_part(t, '.', -1)) THEN 'self' ELSE 'writer' END FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr p JOIN kn ON kn.from_step = p.a AND kn.to_step = p.b WHERE p.b = pr.b AND p.t = pr.t)",
    ),
    "b27_write_groups": (
        lambda a: topology.write_groups(a.step, a.selfs).withColumnRenamed("table", "tab"),
        FACTS + "SELECT target AS tab, count(*) AS n_writers, string_agg(step_id, ',' ORDER BY step_no) AS steps, CASE WHEN count(DISTINCT seq) = 1 THEN 'parallel' WHEN bool_or(step_id IN (SELECT s.step_id FROM step s JOIN reads r ON r.step_id = s.step_id AND r.source = s.target)) THEN 'parallel_then_serial_with_self_ref' ELSE 'parallel_then_serial' END AS pattern FROM step WHERE rule_type IN (1, 14) GROUP BY target HAVING count(*) > 1",
    ),
    "b28_over_constraints": (
        lambda a: a.over,
        FACTS + "SELECT a.step_id, count(*) AS n_waits, count(d.from_step) AS n_needed FROM step a JOIN step b ON a.grp = b.grp AND b.seq < a.seq LEFT JOIN (SELECT DISTINCT from_step, to_step FROM dep) d ON d.from_step = b.step_id AND d.to_step = a.step_id GROUP BY a.step_id HAVING count(d.from_step) < count(*) AND (count(d.from_step) = 0 OR NOT bool_and(b.seq = a.seq - 1) FILTER (d.from_step IS NOT NULL))",
    ),
    "b29_scenarios": (
        lambda a: topology.scenarios(a.step),
        FACTS + ", c AS (SELECT *, CASE WHEN mode IN ('3', '5') AND cond <> '' THEN cond END AS cc FROM step) SELECT step_id, c.grp AS group_code, CASE WHEN n <= 1 THEN 'default' ELSE coalesce(cc, 'common') END AS scenario FROM c JOIN (SELECT grp, count(DISTINCT cc) AS n FROM c GROUP BY grp) g ON g.grp = c.grp",
    ),
    "b30_field_mapping": (
        lambda a: a.mapping,
        "WITH s(rule_code, field, transform) AS (VALUES ('r03','cust_id','direct'),('r03','cust_name','direct'),('r03','nation','direct'),('r03','region_id','direct'),('r03','total_rev','aggregate'),('r03','big_rev','pivot'),('r03','grade','expression'),('r03','del_flag','value'),('r03','dw_last_update_date','value'),('r08','region','direct'),('r08','amount','direct'),('r08','pos','window')), "
        "t(rule_code, field) AS (VALUES ('r03','cust_id'),('r03','cust_name'),('r03','nation'),('r03','region_id'),('r03','total_rev'),('r03','grade_cd'),('r03','DEL_FLAG'),('r08','region'),('r08','amount')) "
        "SELECT coalesce(s.rule_code, t.rule_code) AS rule_code, coalesce(s.field, lower(t.field)) AS field, CASE WHEN s.field IS NULL THEN 'only_declared' WHEN t.field IS NULL THEN 'only_in_sql' ELSE 'matched' END AS state, coalesce(transform, 'unknown') AS transform FROM s FULL JOIN t ON s.rule_code = t.rule_code AND s.field = lower(t.field)",
    ),
    "b33_field_edges": (
        lambda a: a.edges.select("rule_code", "output", F.element_at(F.split("source_table", r"\."), -1).alias("source_table"), "source_field", "transform"),
        FACTS + f"SELECT rule_code, tf AS output, st AS source_table, sf AS source_field, {RANK_NAME.format('rk')} AS transform FROM edges WHERE rule_code <> 'r09'",
    ),
    "b31_exchange_fields": (
        lambda a: lineage.exchange_edges(a.facts.outputs, a.step).select("step_id", "to_table", "to_field", "from_table", "from_field"),
        FACTS + "SELECT DISTINCT x.step_id, split_part(x.target, '.', -1) AS to_table, o.field AS to_field, split_part(x.exchanged, '.', -1) AS from_table, o.field AS from_field FROM step x JOIN step w ON w.target = x.exchanged AND w.rule_type IN (1, 14) JOIN outs o ON o.rule_code = w.rule_code",
    ),
    "b32_typed_fields": (
        lambda a: lineage.typed_fields(a.facts.outputs, a.step, a.ddl).select("rule_code", "field", "type"),
        FACTS + f", ddl(t, c, k) AS (VALUES {_values(catalog.DDL)}) SELECT o.rule_code, o.field, k AS type FROM outs o JOIN step s USING (rule_code) LEFT JOIN ddl ON t = split_part(s.target, '.', -1) AND c = o.field",
    ),
    "b07_table_catalog": (
        lambda a: lineage.table_catalog(a.step, a.read, a.ddl).withColumnRenamed("table", "tab").withColumnRenamed("column", "col"),
        FACTS + f", ddl(t, c, k) AS (VALUES {_values(catalog.DDL)}), n AS (SELECT split_part(target, '.', -1) AS tab, 'target' AS r FROM step UNION SELECT split_part(exchanged, '.', -1), 'exchange' FROM step WHERE exchanged IS NOT NULL UNION SELECT split_part('.' || source, '.', -1), 'source' FROM reads) "
        "SELECT n.tab, c AS col, k AS type, string_agg(r, '/' ORDER BY r) AS role FROM n JOIN ddl ON t = n.tab GROUP BY 1, 2, 3",
    ),
    "b33_join_key_lineage": (
        lambda a: lineage.join_key_lineage(lineage.join_keys(a.facts, a.step), lineage.producing_steps(a.step, a.read), a.hops, a.sources()).withColumnRenamed("table", "tab"),
        FACTS + f""", pd AS (SELECT k.step_id, k.tab, k.fld, w.step_id AS producer, w.rule_code, row_number() OVER (PARTITION BY k.step_id, k.tab, k.fld ORDER BY w.seq < r.seq DESC, CASE WHEN w.seq < r.seq THEN -w.seq END, CASE WHEN w.seq < r.seq THEN -w.step_no END, w.step_no) AS rn
 FROM keys k JOIN step r ON r.step_id = k.step_id JOIN step w ON split_part(w.target, '.', -1) = k.tab AND w.rule_type IN (1, 9, 14) AND w.step_id <> k.step_id),
 hop AS (SELECT p.step_id, p.tab, p.fld, p.producer, e.st, e.sf, e.rk FROM pd p JOIN edges e ON p.rn = 1 AND e.rule_code = p.rule_code AND e.tf = p.fld),
 al AS (SELECT step_id, tab, fld, producer, l.st, l.sf, greatest(h.rk, l.rk) AS rk, l.d + 1 AS d FROM hop h JOIN leaf l ON l.tt = h.st AND l.tf = h.sf UNION ALL SELECT step_id, tab, fld, producer, st, sf, rk, 1 FROM hop WHERE st NOT IN (SELECT tt FROM edges))
 SELECT step_id, tab, fld AS field, producer, st AS source_table, sf AS source_field, {RANK_NAME.format('max(rk)')} AS transform, min(d) AS depth FROM al GROUP BY step_id, tab, fld, producer, st, sf""",
    ),
    "b34_producing_steps": (
        lambda a: lineage.producing_steps(a.step, a.read).withColumnRenamed("table", "tab"),
        FACTS + """, p AS (SELECT r.step_id, split_part('.' || r.source, '.', -1) AS tab, w.step_id AS producer, row_number() OVER (PARTITION BY r.step_id, split_part('.' || r.source, '.', -1) ORDER BY w.seq < s.seq DESC, CASE WHEN w.seq < s.seq THEN -w.seq END, CASE WHEN w.seq < s.seq THEN -w.step_no END, w.step_no) AS rn
 FROM reads r JOIN step s USING (step_id) JOIN step w ON split_part(w.target, '.', -1) = split_part('.' || r.source, '.', -1) AND w.rule_type IN (1, 9, 14) AND w.step_id <> r.step_id) SELECT step_id, tab, producer FROM p WHERE rn = 1""",
    ),
    "b35_join_keys": (lambda a: lineage.join_keys(a.facts, a.step).select("step_id", F.col("table").alias("tab"), "field"), FACTS + "SELECT step_id, tab, fld AS field FROM keys WHERE tab IN (SELECT split_part(target, '.', -1) FROM step WHERE rule_type IN (1, 9, 14))"),
    "b25_field_usage": (lambda a: facts.usages(a.facts).where("kind <> 'having'").select("rule_code", "kind", "field").distinct(), FACTS + "SELECT DISTINCT rule_code, kind, field FROM used"),
    "b36_physical_sources": (lambda a: a.sources().withColumnRenamed("table", "tab"), FACTS + f"SELECT tt AS tab, tf AS field, st AS source_table, sf AS source_field, {RANK_NAME.format('rk')} AS transform, d AS depth FROM leaf"),
    "b37_table_roles": (
        lambda a: topology.table_roles(a.step, a.read).withColumnRenamed("table", "tab"),
        FACTS + "SELECT DISTINCT target AS tab, CASE WHEN regexp_matches(target, '\\.tmp_') THEN 'intermediate' ELSE 'target' END AS role, CASE WHEN contains(target, '.dws_') OR starts_with(target, 'dws.') AND NOT contains(target, '.dwb_') THEN 'DWS' WHEN contains(target, '.dwb_') THEN 'DWB' ELSE 'ADS' END AS layer FROM step "
        "UNION SELECT source, 'source', 'UNKNOWN' FROM reads WHERE split_part('.' || source, '.', -1) NOT IN (SELECT split_part(target, '.', -1) FROM step)",
    ),
    "b30_mapping_statistics": (
        lambda a: quality.mapping_statistics(a.mapping),
        FACTS + f", t AS (SELECT col0 AS rule_code, lower(col1) AS field FROM (VALUES {_values(catalog.TARGET_FIELDS)})), m AS (SELECT coalesce(o.rule_code, t.rule_code) AS rule_code, o.field AS o, t.field AS t FROM (SELECT * FROM outs WHERE rule_code IN (SELECT rule_code FROM t)) o FULL JOIN t ON o.rule_code = t.rule_code AND o.field = t.field) "
        "SELECT rule_code, count(*) AS n_fields, count(*) FILTER (o IS NOT NULL AND t IS NOT NULL) AS n_matched, count(*) FILTER (o IS NULL) AS n_only_declared, count(*) FILTER (t IS NULL) AS n_only_in_sql, count(*) FILTER (o IS NULL OR t IS NULL) AS n_differences FROM m GROUP BY rule_code",
    ),
    "b49_descriptions": (
        lambda a: quality.descriptions(a.facts, a.step, a.read),
        FACTS + "SELECT s.step_id, CASE WHEN rule_type = 9 THEN 'exchanges ' || exchanged || ' into ' WHEN rule_type = 2 THEN 'deletes from ' ELSE 'writes ' END || target || coalesce(' from ' || (SELECT string_agg(source, ', ' ORDER BY source) FROM reads r WHERE r.step_id = s.step_id), '') || coalesce(': ' || (SELECT string_agg(n || ' ' || transform, ', ' ORDER BY transform) FROM histogram h WHERE h.rule_code = s.rule_code), '') AS text FROM step s",
    ),
    "b40_complexity": (
        lambda a: quality.complexity(a.facts),
        "SELECT * FROM (VALUES ('r01',1,0,0,4,2,0),('r02',1,0,0,4,2,0),('r03',1,0,0,9,2,1),('r05',0,0,1,5,2,0),('r06',0,0,0,3,1,0),('r07',1,2,0,4,2,0),('r08',0,0,1,3,2,0),('r10',0,0,0,2,1,0),('r11',0,0,0,4,1,1),('r14',1,0,0,1,2,0)) t(rule_code, n_joins, n_ctes, n_subqueries, n_columns, n_tables, n_cases)",
    ),
    "b40_transforms": (
        lambda a: quality.transform_histogram(a.facts).groupBy("transform").agg(F.sum("n").alias("n")),
        FACTS + "SELECT transform, CAST(sum(n) AS BIGINT) AS n FROM histogram GROUP BY transform",
    ),
    "b41_issues": (
        lambda a: a.issues().select("rule_code", "rule", "severity"),
        FACTS + "SELECT 'r02' AS rule_code, 'oracle_join' AS rule, 'medium' AS severity UNION ALL SELECT 'r14', 'select_star', 'critical' UNION ALL SELECT 'r13', 'parse_error', 'critical' "
        "UNION ALL SELECT DISTINCT rule_code, 'no_schema', 'medium' FROM step JOIN reads USING (step_id) WHERE NOT contains(source, '.') "
        "UNION ALL SELECT rule_code, 'self_reference', 'info' FROM step JOIN reads USING (step_id) WHERE source = target "
        "UNION ALL SELECT s.rule_code, 'field_differences', 'info' FROM (VALUES ('r03', 4), ('r08', 1)) s(rule_code, n) WHERE n > 4 "
        "UNION ALL SELECT rule_code, 'over_constraint', 'info' FROM step WHERE step_id IN ('step_6', 'step_12')",
    ),
    "b42_issue_counts": (lambda a: quality.issue_counts(a.issues()), "SELECT * FROM (VALUES ('critical', 2), ('medium', 9), ('info', 3)) t(severity, n)"),
    "b43_patterns": (
        lambda a: quality.patterns(a.facts, a.step, a.selfs),
        "SELECT * FROM (VALUES ('G1','pivot'),('G1','aggregate'),('G1','fallback'),('G1','incremental_dedup'),('G1','audit'),('G1','serial'),('G1','parallel'),('G2','cte_aggregate'),('G2','window'),('G2','aggregate'),('G2','audit'),('G2','serial'),('G2','parallel'),('G3','pivot'),('G3','window'),('G3','aggregate'),('G3','serial')) t(group_code, pattern)",
    ),
    "b44_load_strategy": (
        lambda a: a.strategy,
        FACTS + ", f AS (SELECT s.*, row_number() OVER (PARTITION BY grp ORDER BY seq DESC, step_no DESC) AS rk FROM step s WHERE rule_type IN (1, 14, 9) AND (rule_type = 9 OR NOT contains(target, '.tmp_')) AND rule_code <> 'r06'), "
        "g AS (SELECT f.grp AS group_code, coalesce(w.rule_code, f.rule_code) AS rule_code, coalesce(w.mode, f.mode) AS delete_mode FROM f LEFT JOIN step w ON w.target = f.exchanged WHERE rk = 1) "
        "SELECT *, CASE WHEN delete_mode = '1' THEN 'full' WHEN delete_mode IN ('2', '4', '6') THEN 'incremental' WHEN delete_mode IN ('3', '5') THEN 'partition' ELSE 'unknown' END AS strategy FROM g",
    ),
    "b45_type_checks": (
        lambda a: quality.type_checks(a.facts, a.step, a.ddl).where("kind in ('direct', 'sum')").select("rule_code", "output", "source_table", "source_field", "source_type", "target_type", "compatible"),
        FACTS + f", ddl(t, c, k) AS (VALUES {_values(catalog.DDL)}) SELECT DISTINCT rule_code, tf AS output, st AS source_table, sf AS source_field, a.k AS source_type, b.k AS target_type, {_compatible_sql('a.k', 'b.k')} AS compatible FROM edges JOIN ddl a ON a.t = st AND a.c = sf JOIN ddl b ON b.t = tt AND b.c = tf WHERE rule_code <> 'r09' AND (rk = 1 OR (rk = 5 AND tf IN ('total_rev', 'rev', 'region_rev')))",
    ),
    "b48_constants": (
        lambda a: quality.constant_checks(a.facts, a.step, a.ddl),
        f"WITH ddl(t, c, k) AS (VALUES {_values(catalog.DDL)}), x(rule_code, output, constant) AS (VALUES ('r03','del_flag','varchar(1)'), ('r05','nation','varchar(4)'), ('r05','total_rev','integer')) SELECT rule_code, output, constant, k AS target_type, {_compatible_sql('constant', 'k')} AS compatible FROM x JOIN ddl ON t = 'dwb_customer_rev_f' AND c = output",
    ),
    "b61_table_impact": (
        lambda a: impact.table_status(a.table_changes, a.read, a.strategy, a.step),
        FACTS + "SELECT DISTINCT c.b AS before_table, r.step_id, CASE WHEN r.step_id IS NULL THEN 'not_hit' ELSE c.s END AS status FROM (VALUES ('nation', 'impact'), ('part_old', 'impact'), ('supplier', 'confirm'), ('region', 'confirm')) c(b, s) LEFT JOIN reads r ON r.source = c.b",
    ),
    "b63_field_impact": (lambda a: a.field_impact().withColumnRenamed("table", "tab"), FACTS + ", st AS (" + FIELD_IMPACT + ") SELECT * FROM st"),
    "b69_impact_summary": (lambda a: impact.summary(a.field_impact()), FACTS + ", st AS (" + FIELD_IMPACT + ") SELECT status, count(*) AS n, status IN ('impact', 'confirm') AS listed FROM st GROUP BY status"),
    "b62_touched_fields": (
        lambda a: impact.touched_fields(a.table_changes, a.edges, a.step, a.read).withColumnRenamed("table", "tab"),
        FACTS + "SELECT DISTINCT c.b AS before_table, r.step_id, e.tt AS tab, e.tf AS field FROM (VALUES ('nation'), ('part_old'), ('supplier'), ('region')) c(b) JOIN reads r ON split_part('.' || r.source, '.', -1) = c.b JOIN step s USING (step_id) JOIN edges e ON e.rule_code = s.rule_code",
    ),
    "b70_cross_asset": (
        lambda a: impact.cross_asset(local(a.spark, [(t,) for t in AFFECTED], "table_name string"), search.target_index(a.rules), a.field_impact()),
        FACTS + f", st AS ({FIELD_IMPACT}), ix AS (SELECT DISTINCT split_part(target, '.', -1) AS k, grp FROM step WHERE rule_type IN (1, 9, 14)), n AS (SELECT grp, count(*) FILTER (status = 'impact') AS a, count(*) FILTER (status = 'confirm') AS b, count(*) FILTER (status = 'no_impact') AS c FROM st JOIN ix ON ix.k = st.tab GROUP BY grp) "
        "SELECT t.n AS table_name, ix.grp AS asset, ix.grp IS NOT NULL AS found, coalesce(n.a, 0) AS n_impact, coalesce(n.b, 0) AS n_confirm, coalesce(n.c, 0) AS n_no_impact FROM (VALUES ('dws.dwb_customer_rev_f'), ('ADS.ads_region_rpt_f'), ('nowhere_f')) t(n) LEFT JOIN ix ON ix.k = split_part(lower(t.n), '.', -1) LEFT JOIN n ON n.grp = ix.grp",
    ),
    "b80_field_search": (
        lambda a: search.field_search(a.facts, a.step, ["region_id", "REV"]),
        FACTS + f""", w(k) AS (VALUES ('region_id'), ('rev')), texts(rule_code, t) AS (VALUES {_values([(r[0], r[8]) for r in catalog._ROWS])}),
 f AS (SELECT o.rule_code, o.field, 1 AS o, 'target' AS role FROM outs o JOIN w ON contains(lower(o.field), k) UNION SELECT e.rule_code, e.tf, 1, 'target' FROM edges e JOIN w ON contains(lower(e.sf), k) WHERE e.rule_code <> 'r09'
   UNION SELECT u.rule_code, u.field, CASE kind WHEN 'join' THEN 2 WHEN 'where' THEN 3 ELSE 4 END, kind FROM used u JOIN w ON contains(lower(u.field), k)),
 g AS (SELECT rule_code, field, string_agg(role, '/' ORDER BY o) AS roles FROM f GROUP BY 1, 2 UNION ALL SELECT DISTINCT rule_code, NULL, 'sql' FROM texts JOIN w ON contains(lower(t), k) WHERE rule_code NOT IN (SELECT rule_code FROM f))
 SELECT rule_code, target, field, roles FROM g JOIN step USING (rule_code)""",
    ),
    "b82_rule_groups": (
        lambda a: search.rule_groups(a.rules),
        FACTS + ", n AS (SELECT grp, CASE grp WHEN 'G1' THEN 'customers' WHEN 'G2' THEN 'regions' WHEN 'G3' THEN 'events' ELSE 'solo' END AS en, count(*) AS n_rules, count(*) FILTER (rule_type IN (1, 14)) AS n_select FROM step GROUP BY 1, 2) SELECT grp AS group_code, en || CASE WHEN row_number() OVER (PARTITION BY en ORDER BY grp) > 1 THEN '_' || row_number() OVER (PARTITION BY en ORDER BY grp) ELSE '' END AS name, n_rules, n_select FROM n",
    ),
    "b84_not_found": (
        lambda a: search.not_found(search.upstream(a.group_edges(), "G2"), a.step, a.read, search.target_index(a.rules)).withColumnRenamed("table", "tab"),
        FACTS + "SELECT DISTINCT source AS tab FROM reads JOIN step USING (step_id) WHERE grp IN ('G1', 'G2') AND split_part('.' || source, '.', -1) NOT IN (SELECT split_part(target, '.', -1) FROM step WHERE rule_type IN (1, 9, 14))",
    ),
    "b86_chain_schedule": (
        lambda a: search.chain_schedule(search.upstream(a.group_edges(), "G2"), local(a.spark, [("G1", "LOAD_CUSTOMERS_F", "0 1 * * *"), ("G3", "LOAD_EVENTS_F", "0 2 * * *")], "group_code string, task_name string, schedule_cron string")),
        FACTS + ", ge AS (SELECT DISTINCT r.grp AS reader, w.grp AS writer FROM reads x JOIN step r ON r.step_id = x.step_id JOIN step w ON w.rule_type IN (1, 9, 14) AND split_part('.' || x.source, '.', -1) = split_part(w.target, '.', -1) WHERE r.grp <> w.grp), "
        "up(g, d) AS (SELECT 'G2', 0 UNION SELECT writer, d + 1 FROM up JOIN ge ON reader = g WHERE d < 6) SELECT g AS group_code, min(d) AS depth, t AS task_name, c AS schedule_cron FROM up LEFT JOIN (VALUES ('G1', 'LOAD_CUSTOMERS_F', '0 1 * * *'), ('G3', 'LOAD_EVENTS_F', '0 2 * * *')) s(k, t, c) ON k = g GROUP BY g, t, c",
    ),
    "b11_match_kind": (
        lambda a: a.read.join(topology.target_tables(a.step), names.short_name(F.col("source")) == F.col("k")).select("step_id", "source", "written", names.match_kind(F.col("source"), F.col("written")).alias("match_kind")).distinct(),
        FACTS + "SELECT DISTINCT r.step_id, r.source, w.target AS written, CASE WHEN r.source = w.target THEN 'full' ELSE 'short' END AS match_kind FROM reads r JOIN step w ON split_part('.' || r.source, '.', -1) = split_part(w.target, '.', -1)",
    ),
    "b87_batch_status": (
        lambda a: search.batch_status(a.facts),
        FACTS + "SELECT grp AS group_code, count(*) AS n_rules, count(*) FILTER (rule_type IN (1, 14) AND rule_code <> 'r13') AS n_parsed, count(*) FILTER (rule_code = 'r13') AS n_failed, coalesce(string_agg(rule_code, ',') FILTER (rule_code = 'r13'), '') AS errors FROM step GROUP BY grp",
    ),
    "b83_target_index": (lambda a: search.target_index(a.rules).withColumnRenamed("table", "tab"), FACTS + "SELECT DISTINCT target AS tab, grp AS group_code FROM step WHERE rule_type IN (1, 9, 14)"),
    "b84_upstream": (
        lambda a: search.upstream(a.group_edges(), "G2"),
        FACTS + ", ge AS (SELECT DISTINCT r.grp AS reader, w.grp AS writer FROM reads x JOIN step r ON r.step_id = x.step_id JOIN step w ON w.rule_type IN (1, 9, 14) AND split_part('.' || x.source, '.', -1) = split_part(w.target, '.', -1) WHERE r.grp <> w.grp), "
        "up(g, d) AS (SELECT 'G2', 0 UNION SELECT writer, d + 1 FROM up JOIN ge ON reader = g WHERE d < 6) SELECT g AS group_code, min(d) AS depth FROM up GROUP BY g",
    ),
    "b85_renumbered": (
        lambda a: search.renumbered(a.step, a.group_edges(), search.upstream(a.group_edges(), "G2")),
        FACTS + "SELECT step_id, grp AS group_code, seq AS exec_sequence, cond AS delete_condition, CASE grp WHEN 'G2' THEN seq + (SELECT max(seq) FROM step WHERE grp = 'G1') ELSE seq END AS chain_sequence FROM step WHERE grp IN ('G1', 'G2')",
    ),
    "b01_dialect": (
        lambda a: a.rules.groupBy(F.coalesce("rule_group_code", F.lit("solo")).alias("group_code")).agg(names.dialect(F.array_join(F.array_sort(F.collect_list("query_sql")), " ")).alias("dialect")),
        "SELECT * FROM (VALUES ('G1', 'oracle'), ('G2', 'oracle'), ('G3', 'dws'), ('solo', 'dws')) t(group_code, dialect)",
    ),
    "b46_type_grid": (
        lambda a: local(a.spark, TYPE_GRID, "s string, t string").select("s", "t", names.compatible(F.col("s"), F.col("t")).alias("ok")),
        f"WITH x(s, t) AS (VALUES {_values(TYPE_GRID)}) SELECT s, t, {_compatible_sql('s', 't')} AS ok FROM x",
    ),
    "b12_names": (
        lambda a: local(a.spark, [(x,) for x in NAME_GRID], "n string").select("n", names.short_name(F.col("n")).alias("short"), names.is_intermediate(F.col("n")).alias("inter"), names.layer(F.col("n")).alias("layer")),
        "SELECT * FROM (VALUES ('DWS.Tmp1','tmp1',true,'DWS'),('x_tmp2','x_tmp2',true,'UNKNOWN'),('tmp_x','tmp_x',true,'TMP'),('a_temp_b','a_temp_b',true,'UNKNOWN'),('s.a_mid_f','a_mid_f',false,'UNKNOWN'),('ods.orders','orders',false,'ODS'),('x.dim_date','dim_date',false,'DIM'),('x.dwd_a','dwd_a',false,'DWB'),('rpt.a','a',false,'ADS'),('tempo','tempo',false,'UNKNOWN')) t(n, short, inter, layer)",
    ),
}
NAME_GRID = ("DWS.Tmp1", "x_tmp2", "tmp_x", "a_temp_b", "s.a_mid_f", "ods.orders", "x.dim_date", "x.dwd_a", "rpt.a", "tempo")

# --- usage analytics -------------------------------------------------------------------------------------------------

LOG = """
WITH log AS (SELECT event_id AS run_id, user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, ts, user_id AS install_id, event_type AS command, CASE WHEN k % 2 = 0 THEN 'file' ELSE 'dir' END AS input_type, 'a' || (k % 7) AS asset,
 CASE WHEN k % 3 = 0 THEN 't' || (k % 11) END AS target_table, CAST(value AS DECIMAL(18,4)) AS elapsed_sec, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN event_type = 'error' THEN ['parse', 'missing', 'memory'][(k % 3) + 1] END AS error_type, '1.' || (k % 4) AS agent_version, ['linux', 'mac'][(k % 2) + 1] AS os, k
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))
"""


def _log(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(usage.usage_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))


#: Error texts of each kind, of several at once, and of none.
ERROR_TEXTS = ("Out of Memory", "Read TIMEOUT after 3 s", "bad DDL of t", "Syntax near FROM", "cannot tokenize", "File x missing", "[Errno 13] Permission", "no such key", "timeout while parsing the file", "Is a directory", "divided by zero")

USAGE: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "c01_ingest": (
        lambda u: usage.ingest(u.unionByName(u.withColumn("ts", F.col("ts") + F.expr("interval 1 day"))), u.where("run_id % 3 = 0")).select("run_id", "ts", "command", "asset", F.get_json_object(F.get_json_object("extra", "$.props"), "$.k").cast("int").alias("k")),
        LOG + "SELECT run_id, ts, command, asset, k FROM log WHERE run_id % 3 <> 0",
    ),
    "c02_overview": (
        usage.overview,
        LOG + "SELECT count(*) AS runs, count(DISTINCT install_id) AS installs, count(DISTINCT trace_id) AS sessions, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error, CAST(round(CAST(sum(elapsed_sec) AS DECIMAL(38,10)) / count(elapsed_sec), 2) AS DOUBLE) AS avg_sec, min(ts) AS first_ts, max(ts) AS last_ts FROM log",
    ),
    "c03_daily_active": (usage.daily_active, LOG + "SELECT CAST(ts AS DATE) AS day, count(*) AS runs, count(DISTINCT install_id) AS installs FROM log WHERE CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) FROM log) - 30 GROUP BY 1"),
    "c04_command_heat": (lambda u: usage.heat(u, "command"), LOG + "SELECT command, count(*) AS runs, max(ts) AS last_ts FROM log GROUP BY 1"),
    "c05_top_installs": (lambda u: usage.top(u, F.col("install_id"), "install_id", 50), LOG + "SELECT install_id, count(*) AS runs, max(ts) AS last_ts FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "c06_top_assets": (lambda u: usage.top(u, F.coalesce("target_table", "asset"), "subject", 10), LOG + "SELECT coalesce(target_table, asset) AS subject, count(*) AS runs, max(ts) AS last_ts FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "c07_errors": (usage.errors, LOG + "SELECT error_type, count(*) AS runs FROM log WHERE status = 'error' GROUP BY 1"),
    "c08_input_types": (lambda u: usage.input_types(u, "signup"), LOG + "SELECT input_type, count(*) AS runs FROM log WHERE command <> 'signup' GROUP BY 1"),
    "c09_versions": (lambda u: usage.spread(u, "agent_version"), LOG + "SELECT agent_version, count(*) AS runs, count(DISTINCT install_id) AS installs FROM log GROUP BY 1"),
    "c10_systems": (lambda u: usage.spread(u, "os"), LOG + "SELECT os, count(*) AS runs, count(DISTINCT install_id) AS installs FROM log GROUP BY 1"),
    "c11_trace_pairs": (
        lambda u: usage.trace_pairs(u, "view", "purch"),
        LOG + "SELECT trace_id, a.run_id AS first_run, b.run_id AS then_run, b.k, b.ts, CAST(round(a.elapsed_sec + b.elapsed_sec, 2) AS DOUBLE) AS total_sec FROM log b JOIN log a USING (trace_id) WHERE a.command = 'view' AND b.command LIKE 'purch%' ORDER BY b.ts DESC, then_run, first_run LIMIT 20",
    ),
    "c12_error_labels": (
        lambda u: u.select("run_id", usage.error_label(F.when(F.col("status") == "error", F.element_at(F.array(*[F.lit(x) for x in ERROR_TEXTS]), (F.col("run_id") % len(ERROR_TEXTS) + 1).cast("int")))).alias("label")),
        LOG + f""", x AS (SELECT run_id, CASE WHEN status = 'error' THEN lower([{', '.join("'" + x + "'" for x in ERROR_TEXTS)}][run_id % {len(ERROR_TEXTS)} + 1]) ELSE '' END AS t FROM log)
SELECT run_id, CASE WHEN t = '' THEN '' WHEN t LIKE '%memory%' THEN 'memory_error' WHEN t LIKE '%timeout%' THEN 'timeout' WHEN t LIKE '%ddl%' THEN 'ddl_error' WHEN regexp_matches(t, 'parse|sqlglot|syntax|tokenize') THEN 'parse_error'
 WHEN regexp_matches(t, 'io|file|permission|notfound|errno|is a directory') THEN 'io_error' ELSE 'unknown' END AS label FROM x""",
    ),
    "c13_columns_added": (
        lambda u: u.where("run_id % 2 = 0").select("run_id", "command").unionByName(u.where("run_id % 2 = 1").select("run_id", "command", "os"), allowMissingColumns=True),
        LOG + "SELECT run_id, command, CASE WHEN run_id % 2 = 1 THEN os END AS os FROM log",
    ),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which physical columns feed each field of the customer revenue table, and how many rows each source table has."""
    a = _analysis(spark)
    sources = a.sources().where("table = 'dwb_customer_rev_f'")
    counts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count("*").alias("source_rows")).select(F.lit(t).alias("source_table"), "source_rows") for t in ("customer", "nation", "orders", "lineitem")]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c)
    return sources.join(rows, "source_table", "left").select("field", "source_table", "source_field", "transform", "depth", "source_rows")


FLAGSHIP = FACTS + f""", n AS (SELECT 'customer' AS t, count(*) AS c FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem)
SELECT tf AS field, st AS source_table, sf AS source_field, {RANK_NAME.format("rk")} AS transform, d AS depth, c AS source_rows FROM leaf LEFT JOIN n ON t = st WHERE tt = 'dwb_customer_rev_f'"""


def queries() -> dict[str, Query]:
    from . import queries_files, queries_rules

    out: dict[str, Query] = {name: _executed(vendor) for name, (vendor, _) in EXECUTED.items()}
    out |= {"a_pipeline": a_pipeline, "a_pipeline_report": a_pipeline_report, "flagship": flagship}
    out |= {name: _meta(f) for name, (f, _) in META.items()}
    out |= {name: f for module in (queries_rules, queries_files) for name, (f, _) in module.QUERIES.items()}
    return out | {name: _log(f) for name, (f, _) in USAGE.items()}


def oracle_sql() -> dict[str, str]:
    from . import queries_files, queries_rules

    out = {name: sql for name, (_, sql) in EXECUTED.items()} | {"a_pipeline": A_PIPELINE, "a_pipeline_report": A_PIPELINE_REPORT, "flagship": FLAGSHIP}
    out |= {name: sql for module in (queries_rules, queries_files) for name, (_, sql) in module.QUERIES.items()}
    return out | {name: sql for name, (_, sql) in META.items()} | {name: sql for name, (_, sql) in USAGE.items()}
