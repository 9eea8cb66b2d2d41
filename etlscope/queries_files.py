"""Registered queries of readers and sinks: each writes files made from a table's rows to the shared folder and reads them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.cut import local, new_folder
from .sinks import render
from .sources import changes, repository, rules

Query = Callable[[SparkSession, str], DataFrame]


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file to any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows


def _files(spark: SparkSession, made: dict[str, str]) -> str:
    folder = new_folder(spark, "files")
    for name, text in made.items():
        put(spark, f"{folder}/{name}", text.encode())
    return folder


def b01_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = ["规则编码", "规则类型", "执行序列", "目标Schema", "目标表", "删除模式", "(生成的）查询语句1", "(生成的）查询语句2"]
    rows = [[f"n{r.n_nationkey}", "13" if r.n_nationkey % 9 == 8 else "1.0", f"{r.n_regionkey}.0", "dws", f" t_{r.n_name} ", "1", f"SELECT x.c AS k{r.n_nationkey} ", "" if r.n_nationkey % 7 == 6 else f"FROM s.u{r.n_regionkey} x"] for r in _nations(spark, sf_dir)]
    path = f"{new_folder(spark, 'book')}/p.xlsx"
    put(spark, path, render.workbook({"RULE": [head, *rows], "TargetFields": [["规则编码", "目标字段名称"]], "GroupVariables": [["规则编码"]]}))
    return rules.read_workbook(spark, path)[0].select("rule_code", "rule_type", "exec_sequence", "target_table", "query_sql")


def _yml(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = {}
    for r in _nations(spark, sf_dir):
        extra = f"  TargetFields:\n    - {{规则编码: n{r.n_nationkey}, 目标字段名称: f{r.n_regionkey}, 字段类型: int}}\n"
        head = "额外信息（其他sheet页信息）: |" if r.n_nationkey % 2 else "额外信息（其他sheet页信息）:"
        made[f"r{r.n_nationkey:02d}.yml"] = f"规则编码: n{r.n_nationkey}\n规则类型: '1'\n执行序列: '{r.n_regionkey}'\n目标表: t_{r.n_nationkey}\n(生成的)查询语句1: 'SELECT x.c '\n(生成的)查询语句2: 'FROM s.u x'\n{head}\n{extra}"
    return rules.read_yml(spark, _files(spark, made))


def b02_yml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yml(spark, sf_dir)[0].select("rule_code", "exec_sequence", "target_table", "query_sql", "row_ord")


def b02_yml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yml(spark, sf_dir)[1].select("rule_code", "target_field", "field_type")


def b03_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root found from a folder below it, for each region; one without marks finds nothing."""
    out = []
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect():
        marks = {"BFT/a/b/x.yml": "a: 1", "DDL/y.sql": ""} if r.r_regionkey % 2 == 0 else {"BFT/a/b/x.yml": "a: 1"}
        folder = _files(spark, marks)
        found = repository.find_root(spark, f"{folder}/BFT/a/b")
        out.append((r.r_regionkey, bool(found) and found.rstrip("/").endswith(folder.rsplit("/", 1)[-1])))
    return local(spark, out, "region int, found boolean")


def _ddl_folder(spark: SparkSession, sf_dir: str) -> str:
    made = {}
    for r in _nations(spark, sf_dir):
        k = r.n_nationkey
        body = f"id BIGINT NOT NULL PRIMARY KEY, -- key of {k}\n  name nvarchar2({k + 5}) DEFAULT 'a--b, c' /* the name */,\n  v numeric({k + 3}, 2)"
        made[f"DWS_EDW/dws/table/t_{k}.sql" if k % 3 else f"DWS_EDW/dws/table/t_{k}.v2.sql"] = f"CREATE TABLE IF NOT EXISTS dws.t_{k} (\n  {body}\n) WITH (ORIENTATION = COLUMN) DISTRIBUTE BY HASH(id);\nCOMMENT ON COLUMN dws.t_{k}.v IS 'value of ''{k}''';"
        if k % 4 == 0:
            made[f"DWS_RT_EDW/dws/table/t_{k}.sql"] = f"CREATE TABLE dws.t_{k} (other int);"
        made[f"view/v/t_{k}_i.sql" if k % 2 else f"view/v/w_{k}.sql"] = f"CREATE OR REPLACE VIEW dws.v{k} AS SELECT a.id, ';' AS s FROM dws.t_{k}_f a; COMMENT ON VIEW x IS 'y';"
    return _files(spark, made)


def b06_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repository.read_ddl(spark, f"{_ddl_folder(spark, sf_dir)}/DWS_EDW")
    return found.select(F.col("table").alias("tab"), F.col("column").alias("col"), "type", "comment", "nullable", "default_value", "is_pk")


def _name(path: str = "path") -> F.Column:
    return F.array_join(F.slice(F.split(path, "/"), -4, 4), "/")


def b05_file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _ddl_folder(spark, sf_dir)
    tables = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("DWS.T_"), F.col("n_nationkey").cast("string")).alias("table"))
    found = repository.match_files(tables, repository._texts(spark, f"{folder}/DWS_EDW", "*.sql").unionByName(repository._texts(spark, f"{folder}/DWS_RT_EDW", "*.sql")))
    return found.select(F.col("table").alias("tab"), _name().alias("file"))


def b04_ddl_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three rules: a temporary table, a final one, and for some an exchange into another table."""
    from .queries_rules import as_rules

    folder, n = _ddl_folder(spark, sf_dir), F.col("n_nationkey").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("n")).where("n < 24").select("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("p")).where("p < 2 or n % 5 = 0")
    text = lambda c: F.col(c).cast("string")
    target = F.when(F.col("p") == 1, F.concat(F.lit("t_"), text("n"))).otherwise(F.concat(F.lit("tmp_"), text("n")))
    made = as_rules(
        rows, rule_code=F.concat(F.lit("d"), text("n"), F.lit("_"), text("p")), rule_type=F.when(F.col("p") == 2, 9).otherwise(1), exec_sequence=F.col("p") + 1, target_table=target, query_sql=F.lit("SELECT 1 AS a"),
        rule_group_code=F.concat(F.lit("D"), text("n")), exchange_source_table=F.when(F.col("p") == 2, F.concat(F.lit("dws.t_"), (F.col("n") + 1).cast("string"))).otherwise(""), row_ord=F.col("n") * 3 + F.col("p"),
    )
    return repository.discover_ddl(made, repository._texts(spark, f"{folder}/DWS_EDW", "*.sql")).select("group_code", F.element_at(F.split("table", r"\."), -1).alias("tab"), _name().alias("file"))


def b08_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _ddl_folder(spark, sf_dir)
    tables = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("dws.t_"), F.col("n_nationkey").cast("string"), F.lit("_f")).alias("table"))
    files = repository._texts(spark, f"{folder}/view", "*.sql")
    return repository.find_views(tables, files).join(repository.view_queries(files), "path").select(F.col("table").alias("tab"), F.element_at(F.split("path", "/"), -1).alias("file"), "query")


def _tasks(spark: SparkSession, sf_dir: str) -> str:
    made = {}
    for r in _nations(spark, sf_dir):
        k, g = r.n_nationkey, r.n_regionkey
        made[f"f{k}.yml"] = f"'*taskName': LOAD_{k}_F\ncron: 0 {k} 2 * * ?\nowner: o{k}\ntaskParams: |\n  - {{name: V_GROUP_CODE, value: GR{g}}}\n"
        made[f"i{k}.yml"] = f"taskName: load_{k}_i\ncron: 0 {k} 5 * * ?\ngroup_code: GR{(g + 1) % 5}\nnote: after GR{g}\n" if k % 2 else f"taskName: load_{k}_i\n\t: broken [yml\ncron: 0 {k} 5 * * ?\ngroup_code: GR{(g + 1) % 5}\n"
    return _files(spark, made)


def b09_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.scheduler_tasks(spark, _tasks(spark, sf_dir), "GR1").select("task_name", "kind", "schedule_cron", "owner")


def b09_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _tasks(spark, sf_dir)
    every = [repository.scheduler_tasks(spark, folder, f"GR{g}") for g in range(5)]
    whole = every[0]
    for t in every[1:]:
        whole = whole.unionByName(t)
    return repository.paired_tasks(every[1], whole)


def b09b_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {f"q{r.n_nationkey}.yml": f"rule_number: 'Q{r.n_nationkey}'\nrule_name: check {r.n_nationkey}\ncheckType: null_check\nalertLevel: high\ntarget_table: DWS.T_{r.n_regionkey}\nsql: select {r.n_nationkey} -- not t_{(r.n_regionkey + 1) % 5}\n" for r in _nations(spark, sf_dir)}
    return repository.quality_rules(spark, _files(spark, made), "dws.t_2").select("rule_number", "rule_name", "check_type", "alert_level", "sql", "target_table")


def _change_book(spark: SparkSession, sf_dir: str) -> str:
    nations = _nations(spark, sf_dir)
    tables = [["变化前表名", "变化后表名", "是否平切", "说明", "变化类型"], *[[f"t{r.n_nationkey}", f"u{r.n_nationkey}", "是" if r.n_nationkey % 2 else "N", r.n_name, "" if r.n_nationkey % 3 else "表/视图下线"] for r in nations]]
    fields = [["前-表名", "前-字段名", "前-类型", "后-表名", "后-字段名", "后-类型", "变化类型"], *[[f"t{r.n_nationkey}", "a", "int", f"t{r.n_nationkey}", "a", "bigint", "字段类型及长度变化"] for r in nations], ["", " ", "", "", "", "", ""]]
    affected = [["序号", "受影响表"], *[[r.n_nationkey, f" t{r.n_nationkey} "] for r in nations], ["", ""]]
    path = f"{new_folder(spark, 'changes')}/c.xlsx"
    put(spark, path, render.workbook({"1.表级变化": tables, "2.字段级变化": fields, "3.受影响表": affected}))
    return path


def b09c_table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.read_changes(spark, _change_book(spark, sf_dir))[0]


def b09c_field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.read_changes(spark, _change_book(spark, sf_dir))[1]


def b09c_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.read_affected(spark, _change_book(spark, sf_dir))


# --- sinks: the fixed catalog, rendered and read back -----------------------------------------------------------------


def _result(spark: SparkSession):
    from .queries import _analysis

    return _analysis(spark)


def b90_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "knowledge")
    _result(spark).result().knowledge().write.json(folder)
    schema = "group_code string, steps array<struct<step_id: string>>, dependencies array<struct<from_step: string>>, fields array<struct<output: string>>, issues array<struct<rule: string>>"
    doc = spark.read.json(folder).select(F.from_json("knowledge", schema).alias("k"))
    size = lambda c: F.coalesce(F.size(f"k.{c}"), F.lit(0)).cast("long")
    return doc.select("k.group_code", F.array_join(F.array_sort(F.transform("k.steps", lambda s: s["step_id"])), ",").alias("steps"), F.greatest(size("dependencies"), F.lit(0)).alias("n_dependencies"))


def b91_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _result(spark)
    return render.entity_mapping(a.facts, a.step).select("step_id", "source").distinct()


def b92_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _result(spark)
    return render.attribute_mapping(a.edges, a.step, a.result().scenario).select("scenario", F.element_at(F.split("target", r"\."), -1).alias("target"), "field", F.element_at(F.split("source_table", r"\."), -1).alias("source_table"), "source_field", "transform")


def b93_auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the report document: columns that a rule's SQL uses, but no output takes."""
    a = _result(spark)
    doc = render.report_data(a.result(), a.ddl).select(F.from_json("report", "auxiliary array<struct<rule_code: string, field: string>>").alias("r"))
    return doc.select(F.inline("r.auxiliary"))


def b93_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _result(spark)
    doc = render.report_data(a.result(), a.ddl).select(F.from_json("report", "group_code string, summary struct<n_steps: bigint, n_targets: bigint, n_sequences: bigint>").alias("r"))
    return doc.select("r.group_code", "r.summary.*")


def b94_view_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.view_merge(_result(spark).facts.outputs, "r03", "r06")


def b95_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.layout(_result(spark).step)


def b97_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the technical note of a group: headings, step table, edges of its graph, schedule."""
    a = _result(spark)
    lines = render.full_note("G1", a.result(), a.ddl).split("\n")
    kept = [x for x in lines if x.startswith(("# ", "## ", "  step_")) or (x.startswith("| step_") and x.endswith("_f |") and x.count("|") == 5) or (x[:3] in ("| 1", "| 2", "| 3", "| 4"))]
    return local(spark, [(x,) for x in kept], "line string")


def b99_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _result(spark)
    path = f"{new_folder(spark, 'impact')}/impact.xlsx"
    put(spark, path, render.workbook({"impact": render.sheet(a.field_impact().withColumnRenamed("table", "tab"), "before_table", "before_field", "tab", "field")}))
    head, *rows = rules.sheets(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))["impact"]
    return local(spark, [tuple((x or None) for x in (*r, *[""] * (len(head) - len(r)))) for r in rows], ", ".join(f"{h} string" for h in head))


def b100_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _result(spark)
    return render.narrative(a.result())


def _catalog_sql(sql: str) -> str:
    from .queries import FACTS

    return FACTS + sql


def _b99_sql() -> str:
    from .queries import FACTS, FIELD_IMPACT

    return FACTS + ", st AS (" + FIELD_IMPACT + ") SELECT * FROM st"


_T = "'t_' || n_nationkey"
DESCRIBED = "CASE WHEN rule_type = 9 THEN 'exchanges ' || exchanged || ' into ' WHEN rule_type = 2 THEN 'deletes from ' ELSE 'writes ' END || target || coalesce(' from ' || (SELECT string_agg(source, ', ' ORDER BY source) FROM reads r WHERE r.step_id = s.step_id), '') || coalesce(': ' || (SELECT string_agg(n || ' ' || transform, ', ' ORDER BY transform) FROM histogram h WHERE h.rule_code = s.rule_code), '')"
QUERIES: dict[str, tuple[Query, str]] = {
    "b01_workbook": (b01_workbook, "SELECT 'n' || n_nationkey AS rule_code, 1 AS rule_type, n_regionkey AS exec_sequence, 't_' || n_name AS target_table, 'SELECT x.c AS k' || n_nationkey || CASE WHEN n_nationkey % 7 = 6 THEN ' ' ELSE ' FROM s.u' || n_regionkey || ' x' END AS query_sql FROM nation WHERE n_nationkey % 9 <> 8"),
    "b02_yml": (b02_yml, "SELECT 'n' || n_nationkey AS rule_code, n_regionkey AS exec_sequence, 't_' || n_nationkey AS target_table, 'SELECT x.c FROM s.u x' AS query_sql, n_nationkey AS row_ord FROM nation"),
    "b02_yml_fields": (b02_yml_fields, "SELECT 'n' || n_nationkey AS rule_code, 'f' || n_regionkey AS target_field, 'int' AS field_type FROM nation"),
    "b03_root": (b03_root, "SELECT r_regionkey AS region, r_regionkey % 2 = 0 AS found FROM region"),
    "b04_ddl_discovery": (b04_ddl_discovery, "SELECT 'D' || n AS group_code, 't_' || t AS tab, 'DWS_EDW/dws/table/t_' || t || CASE WHEN t % 3 = 0 THEN '.v2' ELSE '' END || '.sql' AS file FROM (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 1 ELSE n_nationkey END AS t FROM nation WHERE n_nationkey < 24)"),
    "b05_file_match": (b05_file_match, "SELECT 'DWS.T_' || n_nationkey AS tab, CASE WHEN n_nationkey % 12 = 0 THEN 'DWS_RT_EDW/dws/table/t_' || n_nationkey || '.sql' ELSE 'DWS_EDW/dws/table/t_' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN '.v2' ELSE '' END || '.sql' END AS file FROM nation"),
    "b06_ddl": (
        b06_ddl,
        f"SELECT {_T} AS tab, 'id' AS col, 'bigint' AS type, 'key of ' || n_nationkey AS comment, false AS nullable, NULL AS default_value, true AS is_pk FROM nation UNION ALL SELECT {_T}, 'name', 'nvarchar2(' || (n_nationkey + 5) || ')', 'the name', true, '''a--b, c''', false FROM nation "
        f"UNION ALL SELECT {_T}, 'v', 'numeric(' || (n_nationkey + 3) || ', 2)', 'value of ''' || n_nationkey || '''', true, NULL, false FROM nation",
    ),
    "b08_views": (b08_views, f"SELECT 'dws.' || {_T} || '_f' AS tab, CASE WHEN n_nationkey % 2 = 1 THEN {_T} || '_i.sql' ELSE 'w_' || n_nationkey || '.sql' END AS file, 'SELECT a.id, '';'' AS s FROM dws.' || {_T} || '_f a' AS query FROM nation"),
    "b09_tasks": (b09_tasks, "SELECT 'LOAD_' || n_nationkey || '_F' AS task_name, 'F' AS kind, '0 ' || n_nationkey || ' 2 * * ?' AS schedule_cron, 'o' || n_nationkey AS owner FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'load_' || n_nationkey || '_i', 'I', '0 ' || n_nationkey || ' 5 * * ?', '' FROM nation WHERE (n_regionkey + 1) % 5 = 1"),
    "b09_pairs": (b09_pairs, "SELECT 'LOAD_' || n_nationkey || '_F' AS task_name, 'load_' || n_nationkey || '_i' AS partner, '0 ' || n_nationkey || ' 2 * * ?' AS schedule_cron, '0 ' || n_nationkey || ' 5 * * ?' AS partner_cron FROM nation WHERE n_regionkey = 1"),
    "b09b_quality_rules": (b09b_quality_rules, "SELECT 'Q' || n_nationkey AS rule_number, 'check ' || n_nationkey AS rule_name, 'null_check' AS check_type, 'high' AS alert_level, 'select ' || n_nationkey || ' -- not t_3' AS sql, 'DWS.T_2' AS target_table FROM nation WHERE n_regionkey = 2"),
    "b09c_table_changes": (b09c_table_changes, "SELECT 't' || n_nationkey AS before_table, 'u' || n_nationkey AS after_table, n_nationkey % 2 = 1 AS is_ping_cut, n_name AS note, CASE WHEN n_nationkey % 3 = 0 THEN '表/视图下线' ELSE '' END AS change_type FROM nation"),
    "b09c_field_changes": (b09c_field_changes, "SELECT 't' || n_nationkey AS before_table, 'a' AS before_field, 'int' AS before_type, 't' || n_nationkey AS after_table, 'a' AS after_field, 'bigint' AS after_type, '字段类型及长度变化' AS change_type FROM nation"),
    "b09c_affected": (b09c_affected, "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS ordinal, 't' || n_nationkey AS table_name FROM nation"),
    "b90_knowledge": (b90_knowledge, _catalog_sql("SELECT grp AS group_code, string_agg(step_id, ',' ORDER BY step_id) AS steps, (SELECT count(*) FROM dep JOIN step t ON t.step_id = dep.to_step WHERE t.grp = s.grp) AS n_dependencies FROM step s GROUP BY grp")),
    "b91_entities": (b91_entities, _catalog_sql("SELECT DISTINCT step_id, source FROM reads")),
    "b92_attributes": (
        b92_attributes,
        _catalog_sql(", c AS (SELECT *, CASE WHEN mode IN ('3', '5') AND cond <> '' THEN cond END AS cc FROM step), z AS (SELECT rule_code, CASE WHEN n <= 1 THEN 'default' ELSE coalesce(cc, 'common') END AS scenario FROM c JOIN (SELECT grp, count(DISTINCT cc) AS n FROM c GROUP BY grp) g ON g.grp = c.grp) "
        "SELECT scenario, tt AS target, tf AS field, st AS source_table, sf AS source_field, ['direct','expression','fallback','case_when','aggregate','pivot','window'][max(rk)] AS transform FROM edges JOIN z USING (rule_code) WHERE rule_code <> 'r09' GROUP BY 1, 2, 3, 4, 5"),
    ),
    "b93_auxiliary": (b93_auxiliary, _catalog_sql("SELECT DISTINCT rule_code, field FROM used u WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.rule_code = u.rule_code AND e.sf = u.field)")),
    "b93_summary": (b93_summary, _catalog_sql("SELECT grp AS group_code, count(*) AS n_steps, count(DISTINCT target) AS n_targets, count(DISTINCT seq) AS n_sequences FROM step GROUP BY grp")),
    "b94_view_merge": (b94_view_merge, _catalog_sql("SELECT coalesce(b.field, v.field) AS field, CASE WHEN b.field IS NULL THEN 'view_only' WHEN v.field IS NULL THEN 'base_only' ELSE 'inherited' END AS state FROM (SELECT field FROM outs WHERE rule_code = 'r03') b FULL JOIN (SELECT field FROM outs WHERE rule_code = 'r06') v ON b.field = v.field")),
    "b95_layout": (b95_layout, _catalog_sql("SELECT step_id, CAST(dense_rank() OVER (PARTITION BY grp ORDER BY seq) AS INT) AS x, CAST(row_number() OVER (PARTITION BY grp, seq ORDER BY step_no) AS INT) AS y FROM step")),
    "b97_note": (
        b97_note,
        _catalog_sql("SELECT '| ' || step_id || ' | ' || rule_code || ' | ' || seq || ' | ' || target || ' |' AS line FROM step WHERE grp = 'G1' AND target LIKE '%\\_f' ESCAPE '\\' UNION ALL SELECT '  ' || from_step || ' -->|' || tab || '| ' || to_step FROM dep JOIN step ON step_id = to_step WHERE grp = 'G1' "
        "UNION ALL SELECT '| ' || seq || ' | ' || string_agg(step_id, ',' ORDER BY step_no) || ' |' FROM step WHERE grp = 'G1' GROUP BY seq UNION ALL SELECT * FROM (VALUES ('# G1'), ('## Steps'), ('## Flow'), ('## Summary'), ('## Schedule'), ('## Scenarios'), ('## Load strategy'), ('## Source tables'), ('## Fields'), ('## Field mapping'), ('## Patterns'), ('## Types'), ('## Issues'))"),
    ),
    "b99_workbook": (b99_workbook, _b99_sql()),
    "b100_narrative": (b100_narrative, _catalog_sql(f", d AS (SELECT grp, step_no, step_id || ': ' || {DESCRIBED} AS t FROM step s) SELECT grp AS group_code, string_agg(t, chr(10) ORDER BY step_no) AS text FROM d GROUP BY grp")),
}
