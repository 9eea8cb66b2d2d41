"""Run vendor rules on Spark: pre-pass, inferred column names, targets as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import prepass
from .frontend import parse

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def exact(spark: SparkSession, table: str, *columns: str) -> None:
    """Let a registered table give amounts as decimals (four places), whose sums do not depend on the order of rows."""
    df = spark.table(table)
    df.withColumns({c: df[c].cast("decimal(18,4)") for c in columns}).createOrReplaceTempView(table)


def substituted(sql: str, variables: dict[str, str]) -> str:
    """Placeholders ${X} of known variables replaced by their values."""
    return prepass.text_of([prepass.Token("word", variables[t.text[2:-1]]) if t.kind == "param" and t.text[2:-1] in variables else t for t in prepass.tokens(sql)])


def unqualified(sql: str, schemas: set[str]) -> str:
    """Table names without the given schema prefixes."""
    toks, out, i = prepass.tokens(sql), [], 0
    while i < len(toks):
        if toks[i].kind == "word" and toks[i].text.lower() in schemas and i + 2 < len(toks) and toks[i + 1].text == "." and toks[i + 2].kind == "word":
            i += 2
            continue
        out.append(toks[i])
        i += 1
    return prepass.text_of(out)


def run_sql(spark: SparkSession, sql: str, variables: dict[str, str] | None = None, schemas: set[str] | None = None) -> DataFrame:
    """The result of one vendor query over the registered views; output columns named by the alias rules."""
    text = unqualified(substituted(sql, variables or {}), schemas or set())
    facts = parse(spark, text)
    before = spark.conf.get("spark.sql.variable.substitute")
    spark.conf.set("spark.sql.variable.substitute", "false")  # a placeholder is a literal here
    try:
        df = spark.sql(prepass.clean(prepass.query_of(text)))
    finally:
        spark.conf.set("spark.sql.variable.substitute", before)
    root = next((s[0] for s in facts.scopes if s[2] == "branch" and s[1] == 1), 1)
    names = [c[2] for c in sorted((c for c in facts.columns if c[0] == root), key=lambda c: c[1])]
    return df.toDF(*names) if len(names) == len(df.columns) and len(set(names)) == len(names) else df


def run_rules(spark: SparkSession, rules: list[dict], upto: str, variables: dict[str, str] | None = None) -> DataFrame:
    """Run SELECT rules in sequence order up to rule ``upto``; later writers of a table append by column name."""
    made: dict[str, DataFrame] = {}
    schemas = {r["target_schema"].lower() for r in rules}
    result = None
    for r in sorted(rules, key=lambda r: (r["exec_sequence"], r["row_ord"])):
        if r["rule_type"] not in (1, 14) or not r["query_sql"]:
            continue
        name = r["target_table"].lower()
        result = run_sql(spark, r["query_sql"], variables, schemas)
        if name in made:
            made[name] = made[name].unionByName(result, allowMissingColumns=True)
        else:
            made[name] = result
        made[name].createOrReplaceTempView(name)
        if r["rule_code"] == upto:
            return made[name]
    return result
