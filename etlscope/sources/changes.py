"""Change lists of source tables from a workbook; sheets and headers match by contained text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.cut import local
from .rules import _header, sheets

TABLE = "before_table string, after_table string, is_ping_cut boolean, note string, change_type string"
FIELD = "before_table string, before_field string, before_type string, after_table string, after_field string, after_type string, change_type string"
# Words in headers of the change template.
TABLE_WORDS = {"before_table": ("前", "表"), "after_table": ("后", "表"), "is_ping_cut": ("平切",), "note": ("说明",), "change_type": ("变化类型",)}
FIELD_WORDS = {"before_table": ("前", "表名"), "before_field": ("前", "字段名"), "before_type": ("前", "类型"), "after_table": ("后", "表名"), "after_field": ("后", "字段名"), "after_type": ("后", "类型"), "change_type": ("变化类型",)}
YES = {"y", "yes", "是", "true", "1"}


def _rows(rows: list[list[str]], words: dict[str, tuple[str, ...]]) -> list[dict[str, str]]:
    head = [_header(h) for h in rows[0]] if rows else []
    at = {name: next((i for i, h in enumerate(head) if all(w in h for w in need)), None) for name, need in words.items()}
    cell = lambda r, i: r[i].strip() if i is not None and i < len(r) else ""
    return [{n: cell(r, i) for n, i in at.items()} for r in rows[1:] if any(x.strip() for x in r)]


def read_changes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(table changes, field changes)."""
    book = sheets(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    find = lambda word: next((rows for name, rows in book.items() if word in name), [])
    tables = [(r["before_table"], r["after_table"], r["is_ping_cut"].lower() in YES, r["note"], r["change_type"]) for r in _rows(find("表级"), TABLE_WORDS)]
    fields = [tuple(r[n] for n in FIELD_WORDS) for r in _rows(find("字段"), FIELD_WORDS)]
    return local(spark, tables, TABLE), local(spark, fields, FIELD)


def read_affected(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, table_name) of the sheet of affected tables; blank rows are skipped."""
    book = sheets(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    rows = next((rows for name, rows in book.items() if "影响" in name), [])
    found = [(i, r["table_name"]) for i, r in enumerate(_rows(rows, {"table_name": ("表",)}), 1) if r["table_name"]]
    return local(spark, found, "ordinal int, table_name string")
