"""Readers, deliverables and the API on small written inputs."""

import io
import json
import zipfile

import pytest

from etlscope import api, catalog
from etlscope.sinks import render
from etlscope.sources import changes, repository, rules


def workbook(sheets):
    """A minimal .xlsx: inline strings only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


RULE_ROWS = [
    ["规则编码", "规则类型", "执行序列", "目标表", "删除模式", "(生成的）查询语句1", "(生成的）查询语句2"],
    ["a", "1.0", "2", "t_f", "1", "SELECT x.c ", "FROM s.u x"],
    ["b", "13", "1", "t2", "1", "SELECT 1", ""],
    ["c", "1", "1", "t3", "1", "", ""],
    ["v", "12", "1", "", "", "", ""],
]


def test_workbook_and_yml_agree(spark, tmp_path):
    (tmp_path / "p.xlsx").write_bytes(workbook({"RULE": RULE_ROWS, "TargetFields": [["规则编码", "目标字段名称"], ["a", "c"]], "GroupVariables": [["规则编码", "动态参数/变量名", "变量默认值"], ["v", "D", "1"]]}))
    (tmp_path / "yml").mkdir()
    (tmp_path / "yml" / "a.yml").write_text("规则编码: a\n规则类型: '1.0'\n执行序列: '2'\n目标表: t_f\n删除模式: '1'\n(生成的)查询语句1: 'SELECT x.c '\n(生成的)查询语句2: 'FROM s.u x'\n额外信息（其他sheet页信息）: |\n  TargetFields:\n    - {规则编码: a, 目标字段名称: c}\n")
    book, fields, variables = rules.read_workbook(spark, str(tmp_path / "p.xlsx"))
    yml, fields2, _ = rules.read_yml(spark, str(tmp_path / "yml"))
    assert book.drop("row_ord").collect() == yml.drop("row_ord").collect() and fields.collect() == fields2.collect()
    assert book.first()["query_sql"] == "SELECT x.c FROM s.u x" and variables.first()["var_name"] == "D"


DDL = """CREATE TABLE IF NOT EXISTS dws.t_f (
  id BIGINT NOT NULL PRIMARY KEY, -- the key
  name nvarchar2(20) DEFAULT 'a--b, c' /* the name */,
  amount numeric(18, 2) NOT NULL,
  made timestamp without time zone DEFAULT now(),
  CONSTRAINT x UNIQUE (name)
) WITH (ORIENTATION = COLUMN) DISTRIBUTE BY HASH(id);
COMMENT ON COLUMN dws.t_f.amount IS 'it''s money';
"""


def test_ddl():
    got = {r[1]: r[2:] for r in repository.parse_ddl(DDL)}
    assert got["id"] == ("bigint", "the key", False, None, True)
    assert got["name"] == ("nvarchar2(20)", "the name", True, "'a--b, c'", False)
    assert got["amount"] == ("numeric(18, 2)", "it's money", False, None, False)
    assert got["made"][0] == "timestamp without time zone" and set(got) == {"id", "name", "amount", "made"}


def test_repository(spark, tmp_path):
    for name, text in {
        "DWS_EDW/dws/table/t_f.sql": DDL, "DWS_RT_EDW/dws/table/t_f.sql": "CREATE TABLE t_f (other int);", "v/t_i.sql": "CREATE OR REPLACE VIEW dws.t_i AS SELECT a.id, ';' AS s FROM dws.t_f a; COMMENT ON VIEW x IS 'y';", "v/aa.sql": "CREATE VIEW z AS SELECT 1 FROM t_f",
        "lts/a.yml": "'*taskName': LOAD_F\ncron: 0 30 2 * * ?\nowner: o\ntaskParams: |\n  - {name: V_GROUP_CODE, value: G1}\n", "lts/b.yml": "taskName: OTHER\nnote: G1 only mentioned\n", "dq/c.yml": "rule_number: '7'\ntarget_table: DWS.T_F\nsql: select 1\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["column"] for r in repository.read_ddl(spark, str(tmp_path)).collect()} == {"id", "name", "amount", "made"}
    files = repository._texts(spark, str(tmp_path / "v"), "*.sql")
    tables = spark.createDataFrame([("dws.t_f",)], "table string")
    found = repository.find_views(tables, files).first()["path"]
    assert found.endswith("t_i.sql") and repository.view_query((tmp_path / "v/t_i.sql").read_text()) == "SELECT a.id, ';' AS s FROM dws.t_f a"
    assert repository.match_files(tables, files.unionByName(repository._texts(spark, str(tmp_path / "DWS_EDW"), "*.sql"))).first()["path"].endswith("t_f.sql")
    assert [(r["task_name"], r["kind"]) for r in repository.scheduler_tasks(spark, str(tmp_path / "lts"), "G1").collect()] == [("LOAD_F", "F")]
    assert [r["rule_number"] for r in repository.quality_rules(spark, str(tmp_path / "dq"), "t_f").collect()] == ["7"]


def test_changes(spark, tmp_path):
    book = {"表级变化": [["变化前表名", "变化后表名", "是否平切", "说明", "变化类型"], ["a", "b", "是", "n", "平切"]], "字段级变化": [["前-表名", "前-字段名", "前-类型", "后-表名", "后-字段名", "后-类型", "变化类型"], ["a", "f", "int", "a", "f", "bigint", "字段类型及长度变化"], ["", "", "", "", "", "", ""]]}
    (tmp_path / "c.xlsx").write_bytes(workbook(book))
    tables, fields = changes.read_changes(spark, str(tmp_path / "c.xlsx"))
    assert tuple(tables.first()) == ("a", "b", True, "n", "平切") and [tuple(r) for r in fields.collect()] == [("a", "f", "int", "a", "f", "bigint", "字段类型及长度变化")]


@pytest.fixture(scope="module")
def result(spark):
    declared = spark.createDataFrame(catalog.TARGET_FIELDS, "rule_code string, target_field string, source_field string, field_type string")
    return api.analyze(spark, catalog.rules(spark), declared)


def test_knowledge(result):
    docs = {r["group_code"]: json.loads(r["knowledge"]) for r in result.knowledge().collect()}
    assert set(docs) == {"G1", "G2", "G3", "_SOLO_r14"} and len(docs["G1"]["steps"]) == 6
    assert docs["G1"]["load_strategy"][0]["strategy"] == "partition" and {"from_step": "step_1", "to_step": "step_4", "table": "tmp_order_rev", "kind": "data"} in docs["G1"]["dependencies"]


def test_deliverables(result):
    states = {r["field"]: r["state"] for r in render.view_merge(result.facts.outputs, "r03", "r06").collect()}
    assert states["total_rev"] == "inherited" and states["grade"] == "base_only"
    assert render.attribute_mapping(result.edges, result.step, result.scenario).where("scenario = 'p_main'").select("field").distinct().count() == 7
    assert render.layout(result.step).where("x = 1").count() == 6 and not render.entity_mapping(result.facts, result.step).isEmpty()
    note = render.technical_note("G1", result.step, result.dep, result.issues)
    assert "step_1 -->|tmp_order_rev| step_4" in note and "oracle_join" in note


def test_chain_and_search(result):
    got = {r["step_id"]: r["chain_sequence"] for r in api.chain(result, "G2").collect()}
    assert got["step_1"] == 1 and got["step_7"] == 5
    assert {r["field"] for r in api.find(result, ["REGION_rev"]).collect()} == {"region_rev", "amount", "pos"}  # by name and by source field
