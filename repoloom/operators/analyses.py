"""Written analyses: summaries, upstream context, level-by-level folds, rollups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.kinds import PROTOCOLS, SERVICE_CATEGORIES, one_of
from repoloom.functions.text import json_type, json_variant, strip
from repoloom.operators.graph import EDGE_COLUMNS, simple_graph
from repoloom.runtime import StagedLevels, stage

# Summary headings, limits and the text without a summary.
SUMMARY_HEADINGS = ["## Summary", "## Overview"]
SUMMARY_LINES = 5
FALLBACK_CHARS = 500
NO_SUMMARY = "(no summary available)"

ANALYSIS_BLOCK = r"(?ms)^## Analysis Data\b.*?```json\s*\n(.*?)\n\s*```"
RESULT_FIELDS = {
    "summary": "string",
    "architecture_pattern": "string",
    "key_modules": "array<map<string,string>>",
    "api_endpoints": "array<struct<path:string,method:string,description:string,auth_required:boolean,request_schema:string,response_schema:string>>",
    "data_flows": "array<struct<name:string,description:string,steps:array<string>,mermaid:string>>",
    "design_decisions": "array<struct<decision:string,rationale:string,alternatives:array<string>,consequences:array<string>>>",
    "tech_stack": "array<string>",
    "security_notes": "array<string>",
    "performance_notes": "array<string>",
    "scalability_notes": "array<string>",
    "citations": "array<struct<file_path:string,start_line:int,end_line:int,claim:string,section:string,snippet:string>>",
    "external_integrations": "array<struct<service:string,category:string,description:string>>",
    "component_interactions": "array<struct<target:string,type:string,protocol:string,description:string>>",
}
RESULT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in RESULT_FIELDS.items())


def summary_of(markdown: Column, max_lines: int | None = SUMMARY_LINES, max_chars: int | None = FALLBACK_CHARS) -> Column:
    """First lines of the summary section, else the first line of prose; without limits, whole."""
    rows = F.split(markdown, "\n")
    heading = lambda l: F.contains(l, F.lit(SUMMARY_HEADINGS[0])) | F.contains(l, F.lit(SUMMARY_HEADINGS[1]))
    visible = lambda l: F.rlike(l, F.lit(r"\S"))
    at = F.array_position(F.transform(rows, heading), F.lit(True)).cast("int")
    after = F.filter(F.slice(rows, at + 1, F.size(rows)), lambda l: ~heading(l))
    stop = F.array_position(F.transform(after, lambda l: F.startswith(l, F.lit("## "))), F.lit(True)).cast("int")
    section = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
    seen = F.filter(section, visible)
    told = F.array_join(seen if max_lines is None else F.slice(seen, 1, max_lines), "\n")
    prose = F.get(F.filter(rows, lambda l: visible(l) & ~F.startswith(l, F.lit("#"))), F.lit(0))
    return F.coalesce(F.when(at > 0, F.nullif(told, F.lit(""))), prose if max_chars is None else F.substring(prose, 1, max_chars), F.lit(NO_SUMMARY))


def extract_summary(analyses: DataFrame, max_lines: int | None = SUMMARY_LINES, max_chars: int | None = FALLBACK_CHARS) -> DataFrame:
    """(repo, component, summary); with None for both limits the summaries are whole."""
    return analyses.select("repo", "component", summary_of(F.col("markdown"), max_lines, max_chars).alias("summary"))


def upstream_context(deps: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, component, pos, dep, section): the context of a component is its
    sections in ``pos`` order, one per direct dependency with an analysis.

    ``deps`` is (repo, component, pos, dep). Sections stay rows, so a component
    with very many dependencies is no single huge value.
    """
    told = summaries.select("repo", F.col("component").alias("dep"), "summary")
    return deps.select("repo", "component", "pos", "dep").join(told, ["repo", "dep"]).select(
        "repo", "component", "pos", "dep", F.concat(F.lit("### "), F.col("dep"), F.lit("\n"), F.col("summary")).alias("section")
    )


def level_worklist(levels: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work, unknown): levels joined to the inventory, and names not in it."""
    work = levels.select("repo", "name", "depth").join(components, ["repo", "name"])
    unknown = levels.select("repo", "name", "depth").join(components.select("repo", "name"), ["repo", "name"], "left_anti")
    return work, unknown


def row_function(fn: Callable[[dict], str | None], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Turn ``fn(row) -> text`` into a ``mapInPandas`` function; a row that
    raises becomes an ``Error: …`` value, the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for row in batch[columns].to_dict("records"):
                try:
                    values.append(fn(row))
                except Exception as exc:  # noqa: BLE001 - one row must not fail the level
                    values.append(f"Error: component analyzer crashed: {exc}")
            yield pd.DataFrame({"repo": batch["repo"], "name": batch["name"], "value": values})

    return run


def fold_upstream(
    components: DataFrame,
    edges: DataFrame,
    levels: DataFrame,
    combine: list[Column],
    fn: Column | Callable[[dict], str | None],
    value_type: str = "string",
) -> DataFrame:
    """(repo, name, depth, value): a value per component, computed level by level.

    At each depth the values of a component's dependencies are aggregated by
    ``combine`` (aggregates over ``value``, null without dependencies), then
    ``fn`` gives the own value: a column expression over the component's and
    the combined columns, or a Python function of such a row (text values). All repositories
    at a depth go together. Dependencies on the same level (cycles) are not seen.

    A finished level hands its values along its edges to the levels that need
    them, in a table laid out by level; so a level reads its own rows, its own
    edges and what was handed to it, whatever came before.
    """
    place = levels.select("repo", "name", "depth")
    work = StagedLevels(components.join(place, ["repo", "name"]), "depth", "fold")
    of = lambda end, at: place.select("repo", F.col("name").alias(end), F.col("depth").alias(at))
    arcs = simple_graph(edges).join(of("source", "depth"), ["repo", "source"]).join(of("target", "_from"), ["repo", "target"])
    pairs = StagedLevels(arcs.filter("_from < depth"), "_from", "fold-pairs")
    handed = StagedLevels(None, "depth", "fold-handed", like=f"repo string, name string, value {value_type}, depth int", spark=components.sparkSession)
    done: list[DataFrame] = []
    for depth in range((work.top if work.top is not None else -1) + 1):
        rows = work.level(depth)
        up = handed.level(depth).groupBy("repo", "name").agg(*combine)
        rows = rows.join(up, ["repo", "name"], "left")
        if isinstance(fn, Column):
            out = rows.select("repo", "name", fn.cast(value_type).alias("value"))
        else:
            columns = rows.columns
            out = rows.mapInPandas(row_function(fn, columns), "repo string, name string, value string")
        out, _ = stage(out, f"fold-{depth}")
        done.append(out.withColumn("depth", F.lit(depth)))
        if depth < work.top:
            sent = pairs.level(depth).join(out.withColumnRenamed("name", "target"), ["repo", "target"])
            handed.add(sent.select("repo", F.col("source").alias("name"), "value", F.col("depth").cast("int").alias("depth")))
    if not done:
        return components.limit(0).select("repo", "name", F.lit(0).alias("depth"), F.lit(None).cast(value_type).alias("value"))
    return reduce(DataFrame.unionByName, done).select("repo", "name", "depth", "value")


def analysis_outcome(results: DataFrame) -> DataFrame:
    """(repo, depth, succeeded, failed): failures are empty or start with 'Error'."""
    good = (F.coalesce("value", F.lit("")) != "") & ~F.startswith("value", F.lit("Error"))
    return results.groupBy("repo", "depth").agg(
        F.count_if(F.coalesce(good, F.lit(False))).alias("succeeded"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed")
    )


def ingest_analysis_data(analyses: DataFrame) -> DataFrame:
    """(repo, component, result STRUCT): the analysis-data block with defaults
    for missing fields; analyses without a JSON object there are left out."""
    body = strip(F.regexp_extract("markdown", ANALYSIS_BLOCK, 1))
    doc = json_variant(body)
    rows = analyses.select("repo", "component", F.when(json_type(doc) == "OBJECT", F.from_json(body, RESULT_SCHEMA)).alias("r")).filter("r is not null")
    filled = []
    for name, kind in RESULT_FIELDS.items():
        empty = F.lit("") if kind == "string" else F.array().cast(kind)
        filled.append(F.coalesce(F.col(f"r.{name}"), empty).alias(name))
    return rows.select("repo", "component", F.struct(*filled).alias("result"))


# Interactions with an edge type of their name; anything else is a call.
INTERACTION_TYPES = ["calls", "reads_from", "writes_to", "integrates_with"]


def runtime_edges(results: DataFrame) -> DataFrame:
    """Edges found by analysis: interactions between components and integrations
    with external services, with confidence below 1."""
    talk = results.select("repo", F.col("component").alias("source"), F.explode("result.component_interactions").alias("i"))
    text = lambda c: F.coalesce(c, F.lit(""))
    calls = talk.select(
        "repo", "source", F.col("i.target").alias("target"),
        one_of(text(F.col("i.type")), INTERACTION_TYPES, "calls").alias("edge_type"),
        F.when(text(F.col("i.protocol")) != "", one_of(F.col("i.protocol"), PROTOCOLS, "unknown")).alias("protocol"),
        text(F.col("i.description")).alias("description"), F.lit(0.8).alias("confidence"),
    )
    uses = results.select("repo", F.col("component").alias("source"), F.explode("result.external_integrations").alias("x")).select(
        "repo", "source", F.col("x.service").alias("target"), F.lit("integrates_with").alias("edge_type"),
        F.lit(None).cast("string").alias("protocol"), text(F.col("x.description")).alias("description"), F.lit(0.8).alias("confidence"),
    )
    return calls.unionByName(uses).filter("target is not null").select(*EDGE_COLUMNS)


def found_services(results: DataFrame) -> DataFrame:
    """(repo, id, category, users): external services with the number of components using them."""
    x = results.select("repo", "component", F.explode("result.external_integrations").alias("x")).filter("x.service is not null")
    per = x.select("repo", "component", F.col("x.service").alias("id"), one_of(F.coalesce("x.category", F.lit("")), SERVICE_CATEGORIES, "other").alias("category")).distinct()
    return per.groupBy("repo", "id").agg(F.min("category").alias("category"), F.countDistinct("component").alias("users"))


def technology_inventory(external_deps: DataFrame) -> DataFrame:
    """(name, versions, users): across the estate, per external dependency."""
    return external_deps.groupBy("name").agg(
        F.countDistinct(F.nullif(F.col("version"), F.lit(""))).alias("versions"), F.countDistinct("repo", "component").alias("users")
    )


def service_users(edges: DataFrame, services: DataFrame) -> DataFrame:
    """(id, name, category, users, repos) of external services."""
    uses = edges.select("repo", "source", F.col("target").alias("id")).distinct()
    per = uses.groupBy("id").agg(F.countDistinct("repo", "source").alias("users"), F.countDistinct("repo").alias("repos"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return services.join(per, "id", "left").select("id", "name", "category", zero("users"), zero("repos"))


def analysis_coverage(components: DataFrame, analyses: DataFrame) -> DataFrame:
    """(repo, components, analysed, missing)."""
    has = analyses.select("repo", F.col("component").alias("name")).distinct().withColumn("_has", F.lit(True))
    joined = components.select("repo", "name").distinct().join(has, ["repo", "name"], "left")
    return joined.groupBy("repo").agg(
        F.count("*").alias("components"), F.count_if("_has").alias("analysed"), F.count_if(F.col("_has").isNull()).alias("missing")
    )
