"""The library's entry points: analyze, impact, search and chain over any number of rule groups at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import short_name
from .operators import impact as impact_ops
from .operators import lineage, quality, search, topology
from .plans.cut import cut
from .plans.facts import FactTables, extract
from .sinks import render


@dataclass
class Result:
    facts: FactTables
    step: DataFrame
    read: DataFrame
    dep: DataFrame
    edges: DataFrame
    sources: DataFrame
    mapping: DataFrame
    issues: DataFrame
    strategy: DataFrame
    scenario: DataFrame

    def knowledge(self) -> DataFrame:
        return render.knowledge(self.facts, self.step, self.dep, self.edges, self.issues, self.strategy)


def analyze(spark: SparkSession, rules: DataFrame, target_fields: DataFrame, ddl: DataFrame | None = None) -> Result:
    """Facts, topology, lineage, mapping and issues of a rule table; ``ddl`` expands stars and places unqualified columns."""
    facts = extract(spark, rules, ddl=ddl)
    step = cut(topology.steps(rules))
    read = cut(topology.reads(facts, step))
    dep = cut(topology.dependencies(step, read))
    mapping = quality.field_mapping(facts, target_fields)
    found = quality.issues(facts, mapping, topology.self_references(step, read), topology.over_constraints(step, dep), step)
    sources = cut(lineage.physical_sources(lineage.step_edges(facts.edges, step, facts.outputs)))
    return Result(facts, step, read, dep, facts.edges, sources, mapping, found, topology.load_strategy(rules), topology.scenarios(step))


def impact(result: Result, table_changes: DataFrame, field_changes: DataFrame, ddl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table status, field status) of a change list."""
    owners = result.step.select(short_name(F.col("target")).alias("table"), "group_code").distinct()
    by_table = owners.join(result.strategy.select("group_code", "strategy"), "group_code").groupBy("table").agg(F.max("strategy").alias("strategy"))
    stars, casts = impact_ops.star_reads(result.facts.status, result.read), impact_ops.cast_gates(result.edges, result.step)
    return (
        impact_ops.table_status(table_changes, result.read, result.strategy, result.step),
        impact_ops.field_status(field_changes, table_changes, result.sources, result.read, ddl, by_table, stars, casts),
    )


def impact_of_assets(result: Result, affected: DataFrame, table_changes: DataFrame, field_changes: DataFrame, ddl: DataFrame) -> DataFrame:
    """Per affected table the assets that write it, with counts of their fields by status."""
    return impact_ops.cross_asset(affected, search.target_index(result.facts.rules), impact(result, table_changes, field_changes, ddl)[1])


def find(result: Result, keywords: list[str]) -> DataFrame:
    return search.field_search(result.facts, result.step, keywords)


def chain(result: Result, start: str) -> DataFrame:
    """Steps of a group and all groups upstream of it, renumbered into one sequence."""
    edges = cut(search.group_edges(result.step, result.read, search.target_index(result.facts.rules)))
    return search.renumbered(result.step, edges, search.upstream(edges, start))
