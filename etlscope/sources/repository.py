"""A rule repository: table definitions, views, scheduler tasks and data-quality rules found by text and file name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import is_intermediate, short_name
from ..plans.prepass import query_of, text_of, tokens

DDL = "table string, column string, type string, comment string, nullable boolean, default_value string, is_pk boolean"
_NOT_COLUMNS = {"primary", "unique", "constraint", "foreign", "partition", "key", "check"}


def _texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def _split(text: str, by: str) -> list[str]:
    """Parts between separators outside of brackets, literals and comments; a line comment stays with its line."""
    parts, depth, quote, i = [""], 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif text.startswith("--", i) or text.startswith("/*", i):
            end = text.find("\n", i) if c == "-" else text.find("*/", i) + 2
            end = len(text) if end <= (0 if c == "-" else 1) else end
            parts[-1] += text[i:end]
            i = end
            continue
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == by and depth == 0:
            parts.append("")
            i += 1
            continue
        parts[-1] += c
        i += 1
    return parts


def _body(text: str, start: int) -> str:
    depth, i, quote = 0, start, ""
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c == "'":
            quote = c
        elif text.startswith("--", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return text[start + 1 : i]
        i += 1
    return text[start + 1 :]


def _comments(text: str) -> list[str]:
    """The texts of comments outside of literals."""
    return [t.text[2:].removesuffix("*/").strip() for t in tokens(text) if t.kind == "comment"]


def parse_ddl(text: str) -> list[tuple]:
    """Column rows (schema DDL) of every CREATE TABLE in a text; COMMENT ON COLUMN wins over inline comments."""
    said = {}
    for m in re.finditer(r"COMMENT\s+ON\s+COLUMN\s+([\w.\"]+)\s+IS\s+(?:'((?:[^']|'')*)'|\"([^\"]*)\")", text, re.I):
        names = m[1].replace('"', "").lower().split(".")
        said[(names[-2] if len(names) > 1 else "", names[-1])] = (m[2] if m[2] is not None else m[3]).replace("''", "'")
    out = []
    for m in re.finditer(r"CREATE\s+(?:\w+\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)\s*\(", text, re.I):
        table = re.sub(r"[\"`]", "", m[1]).lower().split(".")[-1]
        items = _split(_body(text, m.end() - 1), ",")
        for n, item in enumerate(items):
            ahead = re.match(r"[ \t]*(?:--\s*([^\n]*)|/\*(.*?)\*/[ \t]*(?=\n))", items[n + 1]) if n + 1 < len(items) else None  # a comment behind the comma
            said_here = _comments(re.sub(r"^[ \t]*--[^\n]*\n", "", item) if n else item)
            bare = text_of([t for t in tokens(item) if t.kind != "comment"]).strip()
            head = re.match(r"[\"`]?(\w+)[\"`]?\s+((?:character\s+varying|double\s+precision|timestamp\s+without\s+time\s+zone|\w+)(?:\s*\([^)]*\))?)", bare, re.I)
            if not head or head[1].lower() in _NOT_COLUMNS:
                continue
            default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|[\w.]+(?:\(\))?)", bare, re.I)
            comment = (ahead[1] or ahead[2]) if ahead else next(iter(said_here), "")
            comment = said.get((table, head[1].lower()), comment.strip())
            pk = bool(re.search(r"\bPRIMARY\s+KEY\b", bare, re.I))
            out.append((table, head[1].lower(), re.sub(r"\s+", " ", head[2]).lower(), comment, not (pk or re.search(r"\bNOT\s+NULL\b", bare, re.I)), default[1] if default else None, pk))
    return out


def read_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of all definitions; an offline copy of a table wins over a realtime one (path with _RT_)."""
    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, *r) for t, p in zip(f.text, f.path, strict=True) for r in parse_ddl(t)]
            yield pd.DataFrame(rows, columns=["path", "table", "column", "type", "comment", "nullable", "default_value", "is_pk"])

    rows = _texts(spark, folder, "*.sql").mapInPandas(run, "path string, " + DDL)
    best = F.dense_rank().over(Window.partitionBy("table").orderBy(F.contains(F.upper("path"), F.lit("_RT_")), "path"))
    return rows.withColumn("r", best).where("r = 1").drop("r", "path")


def view_queries(files: DataFrame) -> DataFrame:
    """(path, query): the SELECT of each view file."""
    def run(frames):
        for f in frames:
            yield f.assign(query=[view_query(t) for t in f.text])[["path", "query"]]

    return files.select("path", "text").mapInPandas(run, "path string, query string")


def _stem() -> Column:
    return F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.[^.]*$", "")


def match_files(tables: DataFrame, files: DataFrame) -> DataFrame:
    """(table, path): per table the best file by name: equal stem, then stem prefix before a dot, then contained.

    The first two are equi-joins; only tables without such a file, and slim columns, go on to the search for contained names.
    """
    f = files.select("path", _stem().alias("stem"))
    k = tables.select("table", short_name(F.col("table")).alias("k")).distinct()
    head = f.select("path", "stem", F.split("stem", r"\.")[0].alias("k"))
    exact = k.join(head, "k").select("table", "path", F.when(F.col("stem") == F.col("k"), 1).otherwise(2).alias("rank"))
    rest = k.join(exact.select("table").distinct(), "table", "left_anti").where(F.length("k") >= 4)
    near = rest.join(f, F.contains(F.col("stem"), F.col("k"))).select("table", "path", F.lit(3).alias("rank"))
    hits = exact.unionByName(near)
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("table").orderBy("rank", F.contains(F.upper("path"), F.lit("_RT_")), "path"))).where("r = 1").select("table", "path")


def discover_ddl(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(group_code, table, path): the DDL file of each group's final table.

    Tried in this order: the table an exchange rule swaps into, the last written table that is not temporary, the last written table;
    offline files win over realtime ones.
    """
    code = F.coalesce("rule_group_code", F.concat(F.lit("_SOLO_"), F.col("rule_code"))).alias("group_code")
    target = F.lower("target_table")
    swap = rules.where("rule_type = 9").select(code, F.lower("exchange_source_table").alias("table"), F.lit(1).alias("try"), "exec_sequence", "row_ord")
    final = rules.where(F.col("rule_type").isin(1, 14) & ~is_intermediate(target)).select(code, target.alias("table"), F.lit(2).alias("try"), "exec_sequence", "row_ord")
    last = rules.where("rule_type in (1, 14)").select(code, target.alias("table"), F.lit(3).alias("try"), "exec_sequence", "row_ord")
    wanted = swap.unionByName(final).unionByName(last)
    found = wanted.join(match_files(wanted.select("table").distinct(), files), "table")
    order = Window.partitionBy("group_code").orderBy("try", F.desc("exec_sequence"), F.desc("row_ord"))
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").select("group_code", "table", "path")


def find_root(spark: SparkSession, start: str, marks: tuple[str, ...] = ("BFT", "DDL")) -> str | None:
    """The nearest folder from ``start`` upwards that holds all folders of ``marks``; in any store that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(start)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    while path is not None:
        if all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, m)) for m in marks):
            return path.toString()
        path = path.getParent()
    return None


def view_query(text: str) -> str | None:
    """The SELECT of a CREATE VIEW text, up to the first semicolon outside of literals and comments."""
    m = re.search(r"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+[\w.\"]+\s*(?:\([^)]*\))?\s*AS\b", text, re.I)
    return query_of(_split(text[m.end() :], ";")[0]) if m else None


def find_views(tables: DataFrame, files: DataFrame) -> DataFrame:
    """(table, path): for tables ending in _f the view file of the same name ending in _i, else the first that mentions it.

    Mentions are found by an equi-join on the words of the view texts.
    """
    base = tables.select("table", short_name(F.col("table")).alias("k")).where("k rlike '_f$'").withColumn("v", F.regexp_replace("k", "_f$", "_i"))
    views = files.where(F.col("text").rlike(r"(?i)create\s+(or\s+replace\s+)?view"))
    named = base.join(views.select("path", _stem().alias("v")), "v").select("table", "path", F.lit(1).alias("rank"))
    words = views.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)"), F.lit(1)))).alias("k"))
    said = base.join(words, "k").select("table", "path", F.lit(2).alias("rank"))
    order = Window.partitionBy("table").orderBy("rank", "path")
    return named.unionByName(said).withColumn("r", F.row_number().over(order)).where("r = 1").select("table", "path")


def _yaml_rows(spark: SparkSession, folder: str, mention: str, pick, schema: str) -> DataFrame:
    """Rows from the yml files whose text mentions a string; only those are parsed."""
    def parsed(text: str):
        import yaml

        try:
            return yaml.safe_load(text)
        except yaml.YAMLError:
            return dict(re.findall(r"^\s*['\"]?([\w*]+)['\"]?\s*:\s*(\S.*?)\s*$", text, re.M))

    def run(frames):
        import pandas as pd

        for f in frames:
            docs = [(p, parsed(t)) for t, p in zip(f.text, f.path, strict=True)]
            yield pd.DataFrame([pick(p, d) for p, d in docs if isinstance(d, dict)], columns=[c.split()[0] for c in schema.split(", ")])

    found = _texts(spark, folder, "*.yml").where(F.contains(F.lower("text"), F.lit(mention.lower())))
    return found.mapInPandas(run, schema)


def _value(doc: dict, *names: str) -> str:
    flat = {str(k).lstrip("*").strip().lower(): v for k, v in doc.items()}
    return next((str(flat[n.lower()]) for n in names if flat.get(n.lower()) not in (None, "")), "")


def scheduler_tasks(spark: SparkSession, folder: str, group_code: str) -> DataFrame:
    """(task_name, kind, schedule_cron, owner, group_code, path): tasks of a rule group; kind F, I or other.

    A text that is no valid yml is searched for ``key: value`` lines instead.
    """
    def pick(path, d):
        import yaml

        nested = [yaml.safe_load(v) if isinstance(v, str) and "\n" in v else v for v in d.values()]
        params = {str(p.get("name", p.get("key", ""))): str(p.get("value", "")) for v in nested if isinstance(v, list) for p in v if isinstance(p, dict)}
        name = _value(d, "taskName", "task_name", "name")
        kind = "F" if name.upper().endswith("_F") else "I" if name.upper().endswith("_I") else "other"
        return name, kind, _value(d, "cron", "schedule_cron", "scheduleCron"), _value(d, "owner"), params.get("V_GROUP_CODE", _value(d, "V_GROUP_CODE", "group_code")), path

    rows = _yaml_rows(spark, folder, group_code, pick, "task_name string, kind string, schedule_cron string, owner string, group_code string, path string")
    return rows.where(F.col("group_code") == group_code)


def paired_tasks(own: DataFrame, every: DataFrame) -> DataFrame:
    """(task_name, partner, schedule_cron, partner_cron): each F task of a group with the I task of the same name, which may be of any group."""
    f = own.where("kind = 'F'").select("task_name", "schedule_cron", F.regexp_replace(F.upper("task_name"), "_F$", "_I").alias("k"))
    i = every.where("kind = 'I'").select(F.col("task_name").alias("partner"), F.upper("task_name").alias("k"), F.col("schedule_cron").alias("partner_cron"))
    return f.join(i, "k", "left").select("task_name", "partner", "schedule_cron", "partner_cron")


def quality_rules(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """(rule_number, rule_name, check_type, alert_level, sql, target_table, owner, path): checks of one table."""
    names = ("rule_number", "rule_name", "check_type", "alert_level", "sql", "target_table", "owner")
    pick = lambda p, d: (*[_value(d, n, n.replace("_", "")) for n in names], p)
    rows = _yaml_rows(spark, folder, table, pick, ", ".join(f"{n} string" for n in (*names, "path")))
    return rows.where(short_name(F.col("target_table")) == short_name(F.lit(table)))
