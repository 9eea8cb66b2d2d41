"""Fact tables of many rules as DataFrames.

Parsing is the only driver-side step: Spark's parser lives there.  Distinct texts are parsed once each, on threads, in batches of
``BATCH`` whose facts are written before the next begins, so a catalog of any size passes through a bounded driver.
Facts of all rules are one set of DataFrames keyed by rule_code, so every later operator runs over any number of rules at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import short_name
from .cut import arrow_table, new_folder
from .frontend import PRIORITY, Facts, parse, parser_session
from .resolve import Resolved, Resolver

RULE = """rule_code string, rule_name string, rule_type int, exec_sequence int, target_schema string, target_table string, delete_mode string,
delete_condition string, query_sql string, project_code string, data_source string, business_owner string, rule_group_code string,
rule_group_en string, exchange_source_table string, is_view_step boolean, row_ord int"""
SCHEMAS = {
    "scopes": "rule_code string, scope int, parent int, kind string, ord int, alias string, depth int, branch int",
    "refs": "rule_code string, scope int, ord int, kind string, name string, alias string, join_type string, condition string, role string, child int, using string, bare boolean",
    "columns": "rule_code string, scope int, position int, name string, expression string, transform string, constant string, root string, cast_type string",
    "sources": "rule_code string, scope int, position int, ord int, alias string, field string",
    "outputs": "rule_code string, scope int, branch int, leaf int, position int, name string, output string, expression string, transform string, constant string, root string, cast_type string",
    "edges": "rule_code string, output string, transform string, source_table string, source_field string, branch int, path_depth int, root string, cast_type string",
    "usage": "rule_code string, scope int, kind string, join_type string, text string, alias string, field string, table string",
    "pairs": "rule_code string, scope int, ord int, alias string, field string, table string, other_alias string, other_field string, other_table string",
    "results": "rule_code string, output string, ord int, table string, field string, constant string",
    "keys": "rule_code string, alias string, field string, table string, source_field string",
    "paths": "rule_code string, scope int, alias string, hop int, from_alias string, to_alias string, from_table string, to_table string, join_type string, condition string",
    "status": "rule_code string, ok boolean, error string, star boolean, joins int, subqueries int, case_branches int",
}
BATCH = 4000  # rules parsed at a time
#: Rule types whose SQL is parsed; those skipped on read; that hold variables.
SELECT_TYPES, SKIPPED_TYPES, VARIABLE_TYPE = (1, 14), (10, 11, 13, 15), 12


@dataclass
class FactTables:
    rules: DataFrame
    scopes: DataFrame
    refs: DataFrame
    columns: DataFrame
    sources: DataFrame
    outputs: DataFrame
    edges: DataFrame
    usage: DataFrame
    pairs: DataFrame
    results: DataFrame
    keys: DataFrame
    paths: DataFrame
    status: DataFrame


def _known(ddl: DataFrame | None, names: set[str]) -> dict[str, list[str]]:
    """Columns of the named tables, in the order of the DDL table."""
    out: dict[str, list[str]] = {}
    if ddl is not None and names:
        for r in ddl.where(F.col("table").isin(sorted(names))).select("table", "column").toLocalIterator():
            out.setdefault(r["table"], []).append(r["column"])
    return out


def _rows(code: str, f: Facts, r: Resolved) -> dict[str, list[tuple]]:
    lists = {"scopes": f.scopes, "refs": f.refs, "columns": f.columns, "sources": f.sources, "status": [f.status]}
    lists |= {n: getattr(r, n) for n in ("outputs", "edges", "usage", "pairs", "results", "keys", "paths")}
    return {n: [(code, *x) for x in rows] for n, rows in lists.items()}


def _short(name: str) -> str:
    return name.lower().rsplit(".", 1)[-1]


def extract(spark: SparkSession, rules: DataFrame, threads: int = 8, ddl: DataFrame | None = None, batch: int = BATCH) -> FactTables:
    """Parse the SELECT rules of ``rules`` (schema RULE) into fact tables.

    ``ddl(table, column, ...)`` tells what a star stands for and which table an unqualified column is of; where it does not know
    a table that another rule writes, that rule's output columns do.
    """
    wanted = rules.where(F.col("rule_type").isin(*SELECT_TYPES) & (F.coalesce(F.trim("query_sql"), F.lit("")) != "")).select("rule_code", "query_sql", F.lower("target_table").alias("target"))
    it: Iterator = iter(wanted.collect() if wanted.isLocal() else wanted.toLocalIterator())
    parts: dict[str, list[pa.Table]] = {n: [] for n in SCHEMAS}
    folder, n_batches = None, 0
    written: dict[str, list[str]] = {}  # columns of tables that rules write
    waiting: list[tuple[str, str, Facts]] = []  # rules with stars of tables not known yet

    def store(rows: dict[str, list[tuple]]) -> None:
        for n, x in rows.items():
            parts[n].append(arrow_table(x, SCHEMAS[n]))

    def resolved(code: str, target: str, facts: Facts, known: dict[str, list[str]], last: bool) -> bool:
        r = Resolver(facts, known).run()
        if r.open_stars and not last:
            return False
        written.setdefault(_short(target), list(dict.fromkeys(x[5] for x in r.outputs if x[0] == 1 and x[1] == 0)) if not r.open_stars else [])
        for n, x in _rows(code, facts, r).items():
            gathered[n].extend(x)
        return True

    session = parser_session(spark)
    with ThreadPoolExecutor(threads, initializer=lambda: spark._jvm.org.apache.spark.sql.SparkSession.setActiveSession(session)) as pool:
        while rows := list(islice(it, batch)):
            gathered: dict[str, list[tuple]] = {n: [] for n in SCHEMAS}
            texts = sorted({r["query_sql"] for r in rows})
            parsed = dict(zip(texts, pool.map(lambda t: parse(spark, t, session), texts), strict=True))
            known = _known(ddl, {_short(r[3]) for f in parsed.values() for r in f.refs if r[2] == "table"})
            for r in rows:
                if not resolved(r["rule_code"], r["target"], parsed[r["query_sql"]], known, False):
                    waiting.append((r["rule_code"], r["target"], parsed[r["query_sql"]]))
            if n_batches == 1:
                folder = new_folder(spark, "facts")
            store(gathered)
            n_batches += 1
            if folder:
                _flush(spark, parts, folder)
    # stars over tables that rules write, until no more becomes known
    gathered = {n: [] for n in SCHEMAS}
    while waiting:
        known = {k: v for k, v in written.items() if v} | _known(ddl, {_short(r[3]) for _, _, f in waiting for r in f.refs if r[2] == "table"})
        left = [w for w in waiting if not resolved(*w, known, False)]
        if len(left) == len(waiting):
            for w in left:
                resolved(*w, known, True)
            left = []
        waiting = left
    store(gathered)
    if folder:
        _flush(spark, parts, folder)
        return FactTables(rules, **{n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}") for n in SCHEMAS})
    return FactTables(rules, **{n: spark.createDataFrame(pa.concat_tables(parts[n])) for n in SCHEMAS})


def _flush(spark: SparkSession, parts: dict[str, list[pa.Table]], folder: str) -> None:
    for n, tables in parts.items():
        if tables:
            spark.createDataFrame(pa.concat_tables(tables)).write.mode("append").parquet(f"{folder}/{n}")
            tables.clear()


def priority(transform) -> F.Column:
    out = F.lit(-1)
    for name, rank in PRIORITY.items():
        out = F.when(transform == name, rank).otherwise(out)
    return out


def step_tables(facts: FactTables) -> DataFrame:
    """(rule_code, name, role): the physical tables each rule reads, anywhere in its SQL, once each."""
    tables = facts.refs.where(F.col("kind") == "table")
    return tables.groupBy("rule_code", "name").agg(F.min("role").alias("role"), F.min(F.struct("scope", "ord")).alias("_first")).select("rule_code", "name", "role")


def output_columns(facts: FactTables) -> DataFrame:
    """(rule_code, scope, branch, leaf, position, name, output, ...): output columns of every scope; set branches by position.

    ``scope`` is the scope whose output it is, ``leaf`` the select that computes it; a set operation has a row for each
    branch, named after its first branch.
    """
    return facts.outputs


def field_edges(facts: FactTables) -> DataFrame:
    """(rule_code, output, transform, source_table, source_field, branch, path_depth, root, cast_type) of each rule's output columns.

    References are followed through CTEs and derived tables, at any nesting and through every set branch, to the
    physical tables of the rule's own SQL.  ``transform`` is the heaviest on the way; recursion adds nothing.
    """
    return facts.edges


def usages(facts: FactTables) -> DataFrame:
    """(rule_code, kind, join_type, alias, field, table): join, where, group and having columns of all scopes, once each."""
    return facts.usage.where("field is not null").select("rule_code", "kind", "join_type", "alias", "field", "table").distinct()


def field_usage(facts: FactTables) -> DataFrame:
    """(rule_code, kind, field, alias, join_type, condition, tables): each used column once per kind and join type.

    condition is the first of the conditions, in text order, that use it; tables are comma-joined.
    """
    used = facts.usage.where("field is not null").groupBy("rule_code", "kind", "field", "alias", "join_type")
    return used.agg(F.min("text").alias("condition"), F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables"))


def short(name: str) -> F.Column:
    return short_name(F.col(name))
