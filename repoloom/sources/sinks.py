"""Output shapes and writers.

Documents of a whole repository are written as records in a fixed order, one
JSON line or text piece each, and never gathered into one value: a repository
may hold a large share of the estate. Only the dependency lists of a single
component are nested, as they come from one manifest.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from repoloom.functions.kinds import parse_kind
from repoloom.operators.citations import source_url
from repoloom.operators.graph import Graph, graph_stats, simple_graph, typed_edges
from repoloom.operators.inventory import inventory_counts
from repoloom.runtime import stage

SHOWN_DEPS = 5
DEP_TYPE = "array<struct<name:string,version:string,category:string,purpose:string>>"


def _sparse(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("")).alias(c)


def nested_components(components: DataFrame, internal: DataFrame, external: DataFrame) -> DataFrame:
    """Component rows with ``internal_dependencies`` and ``external_dependencies`` arrays.

    Dependency tables are (repo, component, pos, dep) and (repo, component,
    pos, name, version, category).
    """
    a = internal.groupBy("repo", F.col("component").alias("name")).agg(F.array_sort(F.collect_list(F.struct("pos", "dep"))).alias("_i"))
    dep = F.struct("name", _sparse("version"), _sparse("category"), F.lit(None).cast("string").alias("purpose"))
    b = external.groupBy("repo", F.col("component").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("pos", dep.alias("d")))).alias("_e"))
    joined = components.join(a, ["repo", "name"], "left").join(b.withColumnRenamed("_c", "name"), ["repo", "name"], "left")
    return joined.select(
        *components.columns,
        F.coalesce(F.transform("_i", lambda s: s["dep"]), F.array().cast("array<string>")).alias("internal_dependencies"),
        F.coalesce(F.transform("_e", lambda s: s["d"]), F.array().cast(DEP_TYPE)).alias("external_dependencies"),
    )


def _component_json(columns: list[str]) -> Column:
    known = ["name", "kind", "type", "root_path", "description", "internal_dependencies", "external_dependencies"]
    fields = [c for c in known if c in columns]
    sparse = [_sparse("manifest_path")] if "manifest_path" in columns else []
    return F.to_json(F.struct(*fields, *sparse))


def inventory_records(components: DataFrame) -> DataFrame:
    """Inventory document records (repo, section, key, pos, json): components in
    discovery order, then counts in total, by kind and by language."""
    rows = components.select(
        "repo", F.lit("components").alias("section"), F.lit("").alias("key"), F.col("ordinal").cast("bigint").alias("pos"),
        _component_json(components.columns).alias("json"),
    )
    counts = inventory_counts(components).select(
        "repo", F.concat(F.lit("metadata."), "metric").alias("section"), "key", F.lit(0).cast("bigint").alias("pos"),
        F.col("value").cast("string").alias("json"),
    )
    return rows.unionByName(counts)


def graph_records(graph: Graph, analyses: DataFrame | None = None) -> DataFrame:
    """Graph document records (repo, section, key, json).

    Sections: nodes.components, nodes.external_services, edges, analysis and
    metadata. ``analyses`` is (repo, component, result STRUCT).
    """
    line = lambda df, section, key, json: df.select("repo", F.lit(section).alias("section"), key.alias("key"), json.alias("json"))
    edge = F.to_json(F.struct(
        "source", "target", "edge_type", "protocol", _sparse("description"), "confidence",
    ))
    parts = [
        line(graph.components, "nodes.components", F.col("name"), _component_json(graph.components.columns)),
        line(graph.edges, "edges", F.concat_ws("|", "source", "target", "edge_type"), edge),
        line(graph_stats(graph, analyses), "metadata", F.col("metric"), F.col("value").cast("string")),
    ]
    if graph.services is not None:
        parts.append(line(graph.services, "nodes.external_services", F.col("id"), F.to_json(F.struct("id", "name", "category"))))
    if analyses is not None:
        parts.append(line(analyses, "analysis", F.col("component"), F.to_json(F.col("result"))))
    return reduce(DataFrame.unionByName, parts)


COMPONENT_SCHEMA = (
    "name string, kind string, type string, root_path string, manifest_path string, description string,"
    f"internal_dependencies array<string>, external_dependencies {DEP_TYPE}"
)
EDGE_SCHEMA = "source string, target string, edge_type string, protocol string, description string, confidence double"


def graph_from_records(records: DataFrame) -> Graph:
    """Read :func:`graph_records` back; missing fields take their defaults."""
    part = lambda section, schema: records.filter(F.col("section") == section).select("repo", F.from_json("json", schema).alias("r")).select("repo", "r.*")
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c)
    comps = part("nodes.components", COMPONENT_SCHEMA).select(
        "repo", "name", parse_kind(F.col("kind")).alias("kind"), text("type", "unknown"), text("root_path"), text("manifest_path"),
        text("description"), F.coalesce("internal_dependencies", F.array().cast("array<string>")).alias("internal_dependencies"),
        F.coalesce("external_dependencies", F.array().cast(DEP_TYPE)).alias("external_dependencies"),
    )
    services = part("nodes.external_services", "id string, name string, category string").select("repo", "id", text("name"), text("category", "other"))
    edges = part("edges", EDGE_SCHEMA).select(
        "repo", "source", "target", text("edge_type", "depends_on"), "protocol", text("description"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
    return Graph(comps, services, edges)


def node_edge_records(components: DataFrame, edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(repo, section, key, json): nodes with their depth, then distinct edges."""
    nodes = components.join(levels.select("repo", "name", "depth"), ["repo", "name"], "left")
    fields = [F.col("name").alias("id"), "kind", "type", F.coalesce("depth", F.lit(0)).alias("depth")]
    if "external_dependencies" in components.columns:
        fields.append(F.when(F.size("external_dependencies") > 0, F.col("external_dependencies")).alias("external_dependencies"))
    rows = nodes.select("repo", F.lit("nodes").alias("section"), F.col("name").alias("key"), F.to_json(F.struct(*fields)).alias("json"))
    arcs = simple_graph(edges).select(
        "repo", F.lit("edges").alias("section"), F.concat_ws("|", "source", "target").alias("key"),
        F.to_json(F.struct(F.col("source").alias("from"), F.col("target").alias("to"))).alias("json"),
    )
    return rows.unionByName(arcs)


def analysis_order(components: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, totals): (repo, depth, name) to be read sorted, and per repo the
    number of components and levels."""
    order = levels.select("repo", "depth", "name")
    totals = levels.groupBy("repo").agg(F.count("*").alias("total_components"), (F.max("depth") + 1).alias("level_count"))
    return order, totals


def discovery_summary(repos: DataFrame, components: DataFrame, edges: DataFrame, levels: DataFrame, max_components: int | None = None, outcome: DataFrame | None = None) -> DataFrame:
    """(repo, status, component_count, edge_count, depth_levels); above ``max_components``, if given, the status says so.

    With ``outcome`` (repo, status, error) of the discovery its status comes first and ``error`` is added.
    """
    count = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    depth = levels.groupBy("repo").agg((F.max("depth") + 1).alias("depth_levels"))
    joined = repos.select("repo").distinct()
    for part in (count(components, "component_count"), count(edges, "edge_count"), depth):
        joined = joined.join(part, "repo", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    many = F.lit(False) if max_components is None else zero("component_count") > max_components
    status, more = F.when(many, "too_many_components"), []
    if outcome is not None:
        joined = joined.join(outcome.select("repo", F.col("status").alias("_status"), "error"), "repo", "left")
        status, more = F.when(F.col("_status") != "ok", F.col("_status")).when(many, "too_many_components"), ["error"]
    return joined.select(
        "repo", status.otherwise("ok").alias("status"),
        zero("component_count").alias("component_count"), zero("edge_count").alias("edge_count"), zero("depth_levels").alias("depth_levels"), *more,
    )


def citation_records(citations: DataFrame, base: Column, commit: Column) -> DataFrame:
    """Valid citations with a deep link, ready for per-component sidecars and
    for the flat index."""
    url = source_url(base, commit, F.col("file_path"), F.col("start_line"), F.col("end_line"))
    return citations.select(
        "repo", "component", "idx", "file_path", "start_line", "end_line", "claim", _sparse("section"), _sparse("snippet"),
        F.nullif(url, F.lit("")).alias("source_url"),
    )


def graph_report(components: DataFrame, internal: DataFrame, external: DataFrame, levels: DataFrame) -> DataFrame:
    """Markdown report in pieces (repo, depth, name, line_no, pos, text).

    Pieces read in that order and joined per ``line_no`` give one section per
    component, grouped by depth; of the external dependencies the first five
    are shown.
    """
    c = components.join(levels.select("repo", "name", "depth"), ["repo", "name"])
    lit = F.lit
    piece = lambda df, line, pos, text: df.select("repo", "depth", "name", lit(line).alias("line_no"), pos.cast("bigint").alias("pos"), text.alias("text"))
    zero = lit(0)
    own = c.select("repo", F.col("name").alias("component"), "depth")
    known = components.select("repo", F.col("name").alias("dep"))
    deps = simple_graph(typed_edges(
        internal.select("repo", F.col("component").alias("source"), F.col("dep").alias("target")), "depends_on"
    )).select("repo", F.col("source").alias("component"), F.col("target").alias("dep"))
    deps = deps.join(known, ["repo", "dep"], "left_semi").join(own, ["repo", "component"])
    firsts = deps.groupBy("repo", "component").agg(F.min("dep").alias("_first"))
    named = deps.join(firsts, ["repo", "component"]).withColumnRenamed("component", "name")
    tick = lambda col: F.concat(lit("`"), col, lit("`"))
    lead = F.when(F.col("dep") == F.col("_first"), "- **Depends On**: ").otherwise(", ")
    bare = c.join(firsts.select("repo", F.col("component").alias("name")), ["repo", "name"], "left_anti")
    by_pos = Window.partitionBy("repo", "component").orderBy("pos", "name")
    head = external.withColumn("_n", F.row_number().over(by_pos)).filter(F.col("_n") <= SHOWN_DEPS)
    label = F.concat(tick(F.col("name")), F.when(F.coalesce("version", lit("")) != "", F.concat(lit(" ("), "version", lit(")"))).otherwise(""))
    shown = head.groupBy("repo", "component").agg(F.array_sort(F.collect_list(F.struct("_n", label.alias("l")))).alias("_head"))
    total = external.groupBy("repo", "component").agg(F.count("*").alias("_all"))
    listed = F.array_join(F.transform("_head", lambda s: s["l"]), ", ")
    more = F.when(F.col("_all") > SHOWN_DEPS, F.concat(lit(" (+"), (F.col("_all") - SHOWN_DEPS).cast("string"), lit(" more)"))).otherwise("")
    with_ext = c.join(shown.join(total, ["repo", "component"]).withColumnRenamed("component", "name"), ["repo", "name"])
    parts = [
        piece(c, 0, zero, F.concat(lit("### "), tick(F.col("name")), lit(" ("), F.col("kind"), lit(")"))),
        piece(c, 1, zero, F.concat(lit("- **Type**: "), F.col("type"))),
        piece(c, 2, zero, F.concat(lit("- **Path**: "), tick(F.col("root_path")))),
        piece(bare, 4, zero, lit("- **Dependencies**: None")),
        named.select(
            "repo", "depth", "name", lit(4).alias("line_no"),
            F.when(F.col("dep") == F.col("_first"), 0).otherwise(1).cast("bigint").alias("pos"), F.concat(lead, tick(F.col("dep"))).alias("text"),
        ),
        piece(with_ext, 5, zero, F.concat(lit("- **External Dependencies**: "), listed, more)),
    ]
    if "description" in components.columns:
        told = c.filter(F.col("description") != "")
        parts.append(piece(told, 3, zero, F.concat(lit("- **Description**: "), F.col("description"))))
    return reduce(DataFrame.unionByName, parts)


def manifest_records(manifests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest rows with the number of files of their inventory."""
    n = inventory.groupBy("service").agg(F.count("*").alias("total_files"))
    return manifests.join(n, "service", "left").withColumn("total_files", F.coalesce("total_files", F.lit(0)))


def write_records(records: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """JSON lines below ``path``, globally ordered: files read by name in turn
    give the documents. Range partitions split a large repository."""
    records.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).json(path)


def write_by_repo(rows: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """JSON lines in one folder per repository (``repo=…``), ordered inside.

    The rows are written before they are dealt out: the slices are found by
    reading all rows once more, which would make them a second time.
    """
    rows, _ = stage(rows, "records")
    keys = ["repo", *[c for c in order if c != "repo"]]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("repo").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Text lines (repo, value) in one folder per repository (``repo=…``), laid out as the text writer does.

    Made for very many repositories: the rows of one meet in one task, or in a
    few if it is large, which writes them as one file through ``pyarrow.fs``.
    """
    from pyarrow import fs

    def write(batches):
        store, base = fs.FileSystem.from_uri(path)
        part, repo, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for key, run in groupby(zip(batch["folder"].to_pylist(), batch["value"].to_pylist()), lambda row: row[0]):
                if key != repo:
                    if out:
                        out.close()
                    repo, folder = key, f"{base.rstrip('/')}/{key}"
                    store.create_dir(folder)
                    out = store.open_output_stream(f"{folder}/part-{part:05d}.txt")
                out.write("".join(f"{value or ''}\n" for _, value in run).encode())
        if out:
            out.close()
        yield from ()

    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base)
    folder = F.concat(F.lit("repo="), F.coalesce("repo", F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("folder")
    dealt = rows.select(folder, "value").hint("rebalance", "folder").sortWithinPartitions("folder")
    dealt.mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()
