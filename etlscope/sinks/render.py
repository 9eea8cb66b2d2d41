"""Deliverables: a JSON knowledge document per rule group, mapping tables, a technical note in markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.facts import FactTables, priority, step_tables


def entity_mapping(facts: FactTables, step: DataFrame) -> DataFrame:
    """(step_id, source, alias, join_type, condition, role): physical tables of each step with their join."""
    return facts.refs.where("kind = 'table'").join(step.select("rule_code", "step_id"), "rule_code").select("step_id", F.col("name").alias("source"), "alias", "join_type", "condition", "role", "scope", "ord")


def attribute_mapping(edges: DataFrame, step: DataFrame, scenario: DataFrame) -> DataFrame:
    """(scenario, target, field, source_table, source_field, transform): the heaviest transform per field and source."""
    rows = edges.join(step.select("rule_code", "step_id", "target"), "rule_code").join(scenario.select("step_id", "scenario"), "step_id")
    best = Window.partitionBy("scenario", "target", "output", "source_table", "source_field").orderBy(priority(F.col("transform")).desc(), "step_id")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select("scenario", "target", F.col("output").alias("field"), "source_table", "source_field", "transform")


def view_merge(outputs: DataFrame, base_rule: str, view_rule: str) -> DataFrame:
    """(field, state): fields of a view against its base table: inherited, view_only or base_only."""
    own = outputs.where("scope = 1 and branch = 0")
    b = own.where(F.col("rule_code") == base_rule).select(F.col("output").alias("field"), F.lit(1).alias("b")).distinct()
    v = own.where(F.col("rule_code") == view_rule).select(F.col("output").alias("field"), F.lit(1).alias("v")).distinct()
    return b.join(v, "field", "full").select("field", F.when(F.col("b").isNull(), "view_only").when(F.col("v").isNull(), "base_only").otherwise("inherited").alias("state"))


def layout(step: DataFrame) -> DataFrame:
    """(step_id, x, y): column by sequence, row by order within it."""
    within = Window.partitionBy("group_code", "exec_sequence").orderBy("step_no")
    return step.select("step_id", F.dense_rank().over(Window.partitionBy("group_code").orderBy("exec_sequence")).alias("x"), F.row_number().over(within).alias("y"))


def knowledge(facts: FactTables, step: DataFrame, dep: DataFrame, edges: DataFrame, issues: DataFrame, strategy: DataFrame) -> DataFrame:
    """(group_code, knowledge): one JSON document per rule group, assembled by nested aggregation."""
    code = step.select("rule_code", "step_id", "group_code")
    listed = lambda df, *cols: df.groupBy("group_code").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    parts = {
        "steps": listed(step, "step_no", "step_id", "rule_code", "exec_sequence", "target"),
        "dependencies": listed(dep.join(code.select(F.col("step_id").alias("to_step"), "group_code"), "to_step"), "from_step", "to_step", "table", "kind"),
        "tables": listed(step_tables(facts).join(code, "rule_code"), "step_id", "name", "role"),
        "fields": listed(edges.join(code, "rule_code"), "rule_code", "output", "transform", "source_table", "source_field"),
        "issues": listed(issues.join(code, "rule_code"), "issue_id", "rule_code", "rule", "severity"),
        "load_strategy": listed(strategy, "rule_code", "delete_mode", "strategy"),
    }
    out = step.select("group_code").distinct()
    for name, part in parts.items():
        out = out.join(part.withColumnRenamed("x", name), "group_code", "left")
    return out.select("group_code", F.to_json(F.struct("group_code", *parts)).alias("knowledge"))


def _report(group: str, title: str, df: DataFrame, order: list[str], *columns: str) -> list[str]:
    """A markdown section with a table of the rows of one group; left out if there are none."""
    rows = df.where(F.col("group_code") == group).select(*columns, *[c for c in order if c not in columns]).orderBy(*order).collect()  # of one group: small by nature
    cell = lambda v: "" if v is None else str(v).replace("|", "/").replace("\n", " ")
    return [f"## {title}", "", f"| {' | '.join(columns)} |", f"|{'-|' * len(columns)}", *[f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows], ""] if rows else []


def technical_note(group: str, step: DataFrame, dep: DataFrame, issues: DataFrame, sections: dict[str, tuple] | None = None) -> str:
    """Markdown of one group: steps, flow as a mermaid graph, the given sections, issues.  Rows of other groups stay on executors.

    sections: title -> (DataFrame with group_code, columns to order by, columns to show).
    """
    steps = _report(group, "Steps", step, ["step_no"], "step_id", "rule_code", "exec_sequence", "target")
    into = dep.join(step.select(F.col("step_id").alias("to_step"), "group_code"), "to_step").where(F.col("group_code") == group).orderBy("from_step", "to_step").collect()
    flow = ["## Flow", "", "```mermaid", "graph LR", *[f"  {r['from_step']} -->|{r['table']}| {r['to_step']}" for r in into], "```", ""]
    more = [line for title, (df, order, columns) in (sections or {}).items() for line in _report(group, title, df, order, *columns)]
    found = issues.join(step.select("rule_code", "group_code").distinct(), "rule_code").where(F.col("group_code") == group).orderBy("issue_id").collect()
    return "\n".join([f"# {group}", "", *steps, *flow, *more, "## Issues", "", *[f"- {r['issue_id']} {r['severity']}: {r['rule']} ({r['rule_code']})" for r in found], ""])


def full_note(group: str, result, ddl: DataFrame) -> str:
    """The technical design of one group in all its sections, from the result of ``api.analyze``."""
    from ..operators import lineage, quality, topology

    step, facts = result.step, result.facts
    code = step.select("rule_code", "step_id", "group_code")
    by_rule = lambda df: df.join(code, "rule_code")
    by_step = lambda df: df.join(step.select("step_id", "group_code"), "step_id")
    sections = {
        "Summary": (by_step(quality.descriptions(facts, step, result.read)), ["step_id"], ("step_id", "text")),
        "Schedule": (topology.schedule(step), ["exec_sequence"], ("exec_sequence", "steps")),
        "Scenarios": (result.scenario, ["scenario", "step_id"], ("scenario", "step_id")),
        "Load strategy": (result.strategy, ["rule_code"], ("rule_code", "delete_mode", "strategy")),
        "Source tables": (by_step(entity_mapping(facts, step)), ["step_id", "scope", "ord"], ("step_id", "source", "alias", "join_type", "condition", "role")),
        "Fields": (by_rule(lineage.typed_fields(facts.outputs, step, ddl)), ["rule_code", "field"], ("rule_code", "field", "transform", "type")),
        "Field mapping": (by_rule(result.edges), ["rule_code", "output", "source_table", "source_field", "branch"], ("rule_code", "output", "transform", "source_table", "source_field")),
        "Patterns": (quality.patterns(facts, step, topology.self_references(step, result.read)), ["pattern"], ("pattern",)),
        "Types": (by_rule(quality.type_checks(facts, step, ddl)), ["rule_code", "output", "kind", "source_type"], ("rule_code", "output", "kind", "source_type", "target_type", "compatible")),
    }
    return technical_note(group, step, result.dep, result.issues, sections)


def report_data(result, ddl: DataFrame) -> DataFrame:
    """(group_code, report): what a page about a group shows, one JSON document each.

    summary counts, layout, fields, auxiliary fields (used by the SQL, but in no output), the usage of each, and issues by severity.
    """
    from ..operators import lineage, quality
    from ..plans.facts import usages

    step, facts = result.step, result.facts
    code = step.select("rule_code", "step_id", "group_code")
    listed = lambda df, *cols: df.groupBy("group_code").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    used = usages(facts).where("kind in ('join', 'where', 'group')").join(code, "rule_code")
    fed = result.edges.select("rule_code", F.col("source_field").alias("field")).distinct()
    n = step.groupBy("group_code").agg(F.count("*").alias("n_steps"), F.count_distinct("target").alias("n_targets"), F.count_distinct("exec_sequence").alias("n_sequences"))
    parts = {
        "summary": n.select("group_code", F.struct("n_steps", "n_targets", "n_sequences").alias("x")),
        "layout": listed(layout(step).join(step.select("step_id", "group_code"), "step_id"), "x", "y", "step_id"),
        "fields": listed(lineage.typed_fields(facts.outputs, step, ddl).join(code, "rule_code"), "rule_code", "field", "transform", "type"),
        "usage": listed(used.select("group_code", "rule_code", "field", "kind").distinct(), "rule_code", "field", "kind"),
        "auxiliary": listed(used.join(fed, ["rule_code", "field"], "left_anti").select("group_code", "rule_code", "field").distinct(), "rule_code", "field"),
        "complexity": listed(quality.complexity(facts).join(code, "rule_code"), "rule_code", "n_joins", "n_ctes", "n_subqueries", "n_columns", "n_tables", "n_cases"),
        "issues": listed(result.issues.join(code, "rule_code").groupBy("group_code", "severity").agg(F.count("*").alias("n")), "severity", "n"),
    }
    out = step.select("group_code").distinct()
    for name, part in parts.items():
        out = out.join(part.withColumnRenamed("x", name), "group_code", "left")
    return out.select("group_code", F.to_json(F.struct("group_code", *parts)).alias("report"))


def narrative(result) -> DataFrame:
    """(group_code, text): a plain summary of each group, one line a step, to be read or handed on."""
    from ..operators import quality

    said = quality.descriptions(result.facts, result.step, result.read).join(result.step.select("step_id", "step_no", "group_code"), "step_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step_id", "text"))), lambda x: F.concat_ws(": ", x["step_id"], x["text"]))
    return said.groupBy("group_code").agg(F.array_join(lines, "\n").alias("text"))


def merged_narrative(base: str, more: dict[str, str]) -> str:
    """Markdown ``base`` with the texts of ``more`` put under the headings that they name; unknown ones are appended."""
    out, left = [], dict(more)
    for line in base.split("\n"):
        out.append(line)
        title = line.lstrip("#").strip()
        if line.startswith("#") and title in left:
            out += ["", left.pop(title)]
    for title, text in left.items():
        out += ["", f"## {title}", "", text]
    return "\n".join(out)


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An .xlsx file of plain text cells; sheet name -> rows."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    clean = lambda v: escape("".join(c for c in str(v) if c >= " " or c in "\t\n"), {'"': "&quot;"})

    def letters(n: int) -> str:
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    n, content = len(sheets), io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f"{head}<workbook {space}><sheets>" + "".join(f'<sheet name="{clean(name)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{clean(v)}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"{head}<worksheet {space}><sheetData>{cells}</sheetData></worksheet>")
    return content.getvalue()


def sheet(df: DataFrame, *order: str) -> list[list]:
    """Header and rows of a report table (a change list or a search result, small by nature) for ``workbook``."""
    return [df.columns, *[list(r) for r in df.orderBy(*order).collect()]]
