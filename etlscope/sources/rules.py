"""Rule packages: workbook (.xlsx, read with the standard library), directory of yml files, JSON lines or Parquet."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import local
from ..plans.facts import RULE, SKIPPED_TYPES, VARIABLE_TYPE

# The headers that rule packages use.
HEADERS = {
    "规则编码": "rule_code", "规则中文名称": "rule_name", "规则类型": "rule_type", "执行序列": "exec_sequence", "目标Schema": "target_schema", "目标表": "target_table", "删除模式": "delete_mode", "删除条件": "delete_condition",
    "项目编码": "project_code", "数据源": "data_source", "业务责任人": "business_owner", "规则组编码": "rule_group_code", "规则组英文名称": "rule_group_en", "交换分区来源表": "exchange_source_table",
}
FIELD_HEADERS = {"规则编码": "rule_code", "目标字段名称": "target_field", "来源字段名称": "source_field", "加密方式": "encryption", "别名": "alias", "字段类型": "field_type", "备注": "remark"}
VARIABLE_HEADERS = {"规则编码": "rule_code", "动态参数/变量名": "var_name", "变量默认值": "default_value"}
SQL_HEADER = re.compile(r"^[（(]?生成的[)）]?查询语句(\d*)$")
EXTRA = "额外信息"
FIELDS = "rule_code string, target_field string, source_field string, encryption string, alias string, field_type string, remark string"
VARIABLES = "rule_code string, var_name string, default_value string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _header(text: str) -> str:
    return re.sub(r"\s+", "", str(text or "")).replace("（", "(").replace("）", ")")


def sheets(content: bytes) -> dict[str, list[list[str]]]:
    """Sheet name -> rows of trimmed cell texts of an .xlsx file."""
    book = zipfile.ZipFile(io.BytesIO(content))
    read = lambda n: ElementTree.fromstring(book.read(n))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in read("xl/sharedStrings.xml").findall("m:si", _NS)]
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    out = {}
    for sheet in read("xl/workbook.xml").find("m:sheets", _NS):
        path = targets[sheet.get(_REL)].lstrip("/")
        rows = []
        for row in read(path if path.startswith("xl/") else f"xl/{path}").iter(f"{{{_NS['m']}}}row"):
            cells: list[str] = []
            for c in row.findall("m:c", _NS):
                at = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - len(cells))
                value = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append(cells)
        out[sheet.get("name")] = rows
    return out


def _records(rows: list[list[str]]) -> list[dict[str, str]]:
    if not rows:
        return []
    head = [_header(h) for h in rows[0]]
    return [dict(zip(head, [*r, *[""] * len(head)], strict=False)) for r in rows[1:] if any(str(x).strip() for x in r)]


def _int(text, default: int) -> int:
    try:
        return int(float(str(text).strip()))
    except ValueError:
        return default


def _rule(record: dict, order: int) -> tuple | None:
    flat = {_header(k): v for k, v in record.items()}
    x = {name: str(flat.get(_header(h)) or "").strip() for h, name in HEADERS.items()}
    texts = sorted((int(m[1] or 1), str(v or "")) for k, v in flat.items() if (m := SQL_HEADER.match(k)))
    x |= {"rule_type": _int(x["rule_type"], 1), "exec_sequence": _int(x["exec_sequence"], 0), "query_sql": "".join(t for _, t in texts), "is_view_step": False, "row_ord": order}
    if not x["rule_code"] or x["rule_type"] in SKIPPED_TYPES or (x["rule_type"] in (1, 14) and not x["query_sql"].strip()):
        return None
    x["rule_group_code"] = x["rule_group_code"] or None
    return tuple(x[c.split()[0]] for c in RULE.replace("\n", " ").split(", "))


def _frames(spark: SparkSession, rules: list[dict], fields: list[dict], variables: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = [r for i, x in enumerate(rules) if (r := _rule(x, i))]
    pick = lambda rows, names: [tuple(str(r.get(_header(h)) or "").strip() for h in names) for r in rows]
    own = [r for r in made if r[2] != VARIABLE_TYPE]
    return local(spark, own, RULE.replace("\n", " ")), local(spark, pick(fields, FIELD_HEADERS), FIELDS), local(spark, pick(variables, VARIABLE_HEADERS), VARIABLES)


def read_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, target fields, group variables) of one package."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    book = {name.lower(): _records(rows) for name, rows in sheets(bytes(content)).items()}
    return _frames(spark, book.get("rule", []), book.get("targetfields", []), book.get("groupvariables", []))


def read_yml(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from a directory with one rule a file; the nested extras may be a block scalar."""
    import yaml

    names = [c.split()[0] for c in RULE.replace("\n", " ").split(", ")]

    def run(frames):
        import pandas as pd

        for f in frames:
            for text, path in zip(f.value, f.p, strict=True):
                doc = yaml.safe_load(text) or {}
                extra = next((v for k, v in doc.items() if str(k).startswith(EXTRA)), None) or {}
                extra = (yaml.safe_load(extra) if isinstance(extra, str) else extra) or {}
                rule = _rule({k: v for k, v in doc.items() if not str(k).startswith(EXTRA)}, 0)
                pick = lambda key, headers, extra=extra: [[str({_header(k): v for k, v in r.items()}.get(_header(h)) or "").strip() for h in headers] for r in extra.get(key) or []]
                made = json.dumps(dict(zip(names, rule, strict=True))) if rule and rule[2] != VARIABLE_TYPE else None
                yield pd.DataFrame([(path, made, json.dumps(pick("TargetFields", FIELD_HEADERS)), json.dumps(pick("GroupVariables", VARIABLE_HEADERS)))], columns=["path", "rule", "fields", "variables"])

    files = spark.read.option("pathGlobFilter", "*.yml").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    made = files.mapInPandas(run, "path string, rule string, fields string, variables string")
    own = made.where("rule is not null").select("path", F.from_json("rule", RULE.replace("\n", " ")).alias("r"))
    rules = own.select(*[f"r.{n}" for n in names if n != "row_ord"], (F.row_number().over(Window.orderBy("path")) - 1).alias("row_ord")).select(*names)  # one row a file
    listed = lambda column, schema: made.select(F.explode(F.from_json(column, "array<array<string>>")).alias("x")).select(*[F.col("x")[i].alias(c.split()[0]) for i, c in enumerate(schema.split(", "))])
    return rules, listed("fields", FIELDS), listed("variables", VARIABLES)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rules stored in the package's own schema."""
    return spark.read.format(fmt).schema(RULE).load(path)
