"""Queries over output shapes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.operators import artifacts, audit, citations
from repoloom.operators import graph as kg
from repoloom.plans.analysis_queries import _FOUND, _LANGS, _VALID, _discrepancies, _mismatches, rendered
from repoloom.plans.bindings import oracle, view
from repoloom.plans.estate_queries import DEPTHS, acyclic_levels, as_deps, recursive
from repoloom.plans.registry import query
from repoloom.plans.source_queries import scratch
from repoloom.runtime import many_files
from repoloom.sources import sinks
from repoloom.streaming import markers
from repoloom.streaming import traces as live

ACYCLIC = ("e_components", "e_edges_acyclic")
LEVELS = DEPTHS.format(edges="e_edges_acyclic")


def _nested(spark):
    internal = view(spark, "e_edges_acyclic").selectExpr("repo", "source as component", "0 as pos", "target as dep")
    external = view(spark, "e_integrations").selectExpr("repo", "source as component", "0 as pos", "target as name", "'1.0' as version", "'' as category")
    return sinks.nested_components(view(spark, "e_components"), internal, external), internal, external


@query("snk1_inventory_records", oracle("""
select c.repo, 'components' as section, c.name, c.kind, count(distinct e.target) as internal, count(distinct i.target) as external, min(i.target) as first
from e_components c left join e_edges_acyclic e on e.repo = c.repo and e.source = c.name left join e_integrations i on i.repo = c.repo and i.source = c.name group by all
union all select repo, 'metadata.total_components', '', cast(count(*) as varchar), 0, 0, null from e_components group by repo
union all select repo, 'metadata.by_kind', kind, cast(count(*) as varchar), 0, 0, null from e_components group by all
union all select repo, 'metadata.by_language', type, cast(count(*) as varchar), 0, 0, null from e_components group by all""", *ACYCLIC, "e_integrations"))
def inventory_records(spark, sf_dir):
    path = scratch(spark, "inventory")
    sinks.write_by_repo(sinks.inventory_records(_nested(spark)[0]), path, ["section", "pos", "key"])
    back = spark.read.schema("repo string, section string, key string, pos bigint, json string").json(path)
    doc = F.from_json("json", sinks.COMPONENT_SCHEMA)
    comp = F.col("section") == "components"
    return back.withColumn("d", F.when(comp, doc)).select(
        "repo", "section", F.when(comp, F.col("d.name")).otherwise(F.col("key")).alias("name"), F.when(comp, F.col("d.kind")).otherwise(F.col("json")).alias("kind"),
        F.when(comp, F.size("d.internal_dependencies")).otherwise(0).cast("bigint").alias("internal"),
        F.when(comp, F.size("d.external_dependencies")).otherwise(0).cast("bigint").alias("external"),
        F.when(comp, F.get("d.external_dependencies.name", F.lit(0))).alias("first"),
    )


@query("snk2_graph_records", oracle("""
select repo, 'nodes.components' as section, count(*) as records from e_components group by repo
union all select repo, 'edges', count(*) from e_edges group by repo
union all select repo, 'metadata', 1 + count(distinct kind) + max(e) from (select c.*, case when exists (select 1 from e_edges e where e.repo = c.repo) then 2 else 0 end as e from e_components c) x group by repo""",
    "e_components", "e_edges"))
def graph_records(spark, sf_dir):
    path = scratch(spark, "graph")
    g = kg.build_graph(view(spark, "e_components"), as_deps(spark))
    sinks.write_records(sinks.graph_records(g), path, ["repo", "section", "key"])
    back = spark.read.schema("repo string, section string, key string, json string").json(path)
    return back.groupBy("repo", "section").agg(F.count("*").alias("records"))


@query("snk3_node_edge_records", recursive(LEVELS, """
select l.repo, 'nodes' as section, l.name as a, cast(l.depth as varchar) as b from levels l
union all select repo, 'edges', source, target from e_edges_acyclic""", *ACYCLIC))
def node_edges(spark, sf_dir):
    rows = sinks.node_edge_records(view(spark, "e_components"), view(spark, "e_edges_acyclic"), acyclic_levels(spark))
    get = lambda n: F.get_json_object("json", f"$.{n}")
    return rows.select("repo", "section", F.coalesce(get("id"), get("from")).alias("a"), F.coalesce(get("depth"), get("to")).alias("b"))


@query("snk4_analysis_order", recursive(LEVELS, """
select l.repo, l.depth, l.name, t.n as total_components, t.k as level_count from levels l
join (select repo, count(*) as n, max(depth) + 1 as k from levels group by repo) t on t.repo = l.repo""", *ACYCLIC))
def order(spark, sf_dir):
    rows, totals = sinks.analysis_order(view(spark, "e_components"), acyclic_levels(spark))
    return rows.join(totals, "repo")


@query("snk5_discovery_summary", recursive(LEVELS, """
select r.repo, case when coalesce(c.n, 0) > 80 then 'too_many_components' else 'ok' end as status, coalesce(c.n, 0) as component_count,
  coalesce(e.n, 0) as edge_count, coalesce(c.k, 0) as depth_levels
from (select distinct repo from e_components union select s_name from supplier) r
left join (select repo, count(*) as n, max(depth) + 1 as k from levels group by repo) c on c.repo = r.repo
left join (select repo, count(*) as n from e_edges_acyclic group by repo) e on e.repo = r.repo""", *ACYCLIC))
def summary(spark, sf_dir):
    repos = view(spark, "e_components").select("repo").union(spark.sql("select s_name as repo from supplier"))
    return sinks.discovery_summary(repos, view(spark, "e_components"), view(spark, "e_edges_acyclic"), acyclic_levels(spark), max_components=80)


@query("snk6_citation_records", oracle(f"""
select repo, component, cast(idx as int) as idx, concat('https://github.com/o/r/blob/HEAD/', true_path, '#L', start_line, case when start_line = end_line then '' else concat('-L', end_line) end) as source_url
from ({_VALID}) v""", "e_citations"))
def citation_records(spark, sf_dir):
    path = scratch(spark, "citations")
    good = citations.valid_citations(citations.check_citations(citations.extract_citations(rendered(spark))))
    sinks.write_by_repo(sinks.citation_records(good, F.lit("https://github.com/o/r/"), F.lit("")), path, ["component", "idx"])
    return spark.read.schema("repo string, component string, idx int, source_url string").json(path)


@query("snk7_graph_report", recursive(LEVELS, """
select l.repo, l.depth, l.name, 0 as line_no, concat('### `', l.name, '` (', c.kind, ')') as line from levels l join e_components c on c.repo = l.repo and c.name = l.name
union all select l.repo, l.depth, l.name, 1, concat('- **Type**: ', c.type) from levels l join e_components c on c.repo = l.repo and c.name = l.name
union all select l.repo, l.depth, l.name, 2, concat('- **Path**: `', c.root_path, '`') from levels l join e_components c on c.repo = l.repo and c.name = l.name
union all select l.repo, l.depth, l.name, 4, case when count(e.target) = 0 then '- **Dependencies**: None' else concat('- **Depends On**: ', string_agg(concat('`', e.target, '`'), ', ' order by e.target)) end
  from levels l left join e_edges_acyclic e on e.repo = l.repo and e.source = l.name group by l.repo, l.depth, l.name
union all select l.repo, l.depth, l.name, 5, concat('- **External Dependencies**: ', array_to_string(list_transform(list_sort(list(i.target))[1:5], lambda x: concat('`', x, '` (1.0)')), ', '),
    case when count(*) > 5 then concat(' (+', count(*) - 5, ' more)') else '' end)
  from levels l join e_integrations i on i.repo = l.repo and i.source = l.name group by l.repo, l.depth, l.name""", *ACYCLIC, "e_integrations"))
def report(spark, sf_dir):
    _, internal, external = _nested(spark)
    pieces = sinks.graph_report(view(spark, "e_components"), internal, external, acyclic_levels(spark))
    lines = pieces.groupBy("repo", "depth", "name", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return lines.select("repo", "depth", "name", "line_no", F.array_join(F.transform("p", lambda s: s["text"]), "").alias("line"))


@query("snk8_audit_report", oracle(f"""
with f as ({_FOUND}), x as (select *, row_number() over (partition by language, bucket order by repo, item) as pos from f)
select language, bucket as key, count(*) as n, string_agg(case when pos <= 3 then concat(repo, ': ', item) end, '; ' order by pos) as exemplars from x group by all
union all select coalesce(l.language, 'unknown'), 'missed_components', count(*), null from e_missed m left join ({_LANGS}) l on l.repo = m.repo group by 1""",
    "e_components", "e_audit_kinds", "e_edges", "e_audit_edges", "e_missed"))
def audit_report(spark, sf_dir):
    out = audit.audit_report(_mismatches(spark), _discrepancies(spark), view(spark, "e_missed"), spark.sql(_LANGS))
    return out.withColumn("exemplars", F.array_join("exemplars", "; "))


@query("snk9_manifest_records", oracle("""
select service, 1 as version, count(*) as total_files from e_artifacts where path not like '%.txt' group by service""", "e_artifacts"))
def manifest_records(spark, sf_dir):
    inv = artifacts.artifact_inventory(view(spark, "e_artifacts"))
    new = view(spark, "e_artifacts").selectExpr("service", "'' as source_repo", "'' as source_commit", "'m' as model").distinct()
    none = spark.createDataFrame([], "service string, version int, source_repo string, source_commit string, model string")
    return sinks.manifest_records(artifacts.next_manifest(none, new), inv).select("service", "version", "total_files")


# --- streams ----------------------------------------------------------------------


@query("str1_completion_markers", """
select concat('r', user_id) as repo, count(distinct event_type) as expected, count(distinct case when event_type <> 'error' then event_type end) as done,
  count(distinct event_type) = count(distinct case when event_type <> 'error' then event_type end) as all_complete from events group by user_id""")
def completion(spark, sf_dir):
    lines = spark.sql("""select concat('r', user_id) as repo, case when event_type = 'error' then concat('working on ', event_type)
        else concat('x [APPLICATION_ANALYSIS_COMPLETE] ', event_type, ' ok') end as value from events""")
    source, out, state = scratch(spark, "transcripts"), scratch(spark, "markers"), scratch(spark, "markers-state")
    sinks.write_lines(lines, source)
    with many_files(spark):
        stream = markers.transcript_stream(spark, source).withColumn("repo", F.substring_index("repo", "=", -1))
        markers.follow_completions(stream, out, state).awaitTermination()
    expected = spark.sql("select distinct concat('r', user_id) as repo, event_type as name from events")
    return markers.completeness(spark.read.schema("repo string, name string").parquet(out), expected)


@query("str2_live_summary", """
select epoch_us(time_bucket(interval '1 hour', ts)) as window_us, event_type as action, count(*) as count, round(sum(value), 2) as duration_ms,
  count(case when event_type = 'error' then 1 end) as errors from events group by all""")
def live_summary(spark, sf_dir):
    source, out, state = scratch(spark, "trace-lines"), scratch(spark, "summary"), scratch(spark, "summary-state")
    rows = view(spark, "e_traces").selectExpr("cast(ts as timestamp) as timestamp", "action", "sequence_id", "duration_ms", "error")
    rows.repartitionByRange(4, "timestamp").write.json(source)
    from repoloom.sources.tables import load_traces

    live.follow_summary(load_traces(spark, source, streaming=True), out, state).awaitTermination()
    got = live.read_summary(spark, out)
    return got.select(F.unix_micros("window_start").alias("window_us"), "action", "count", F.round("duration_ms", 2).alias("duration_ms"), "errors")


@query("str2_batch_summary", """
select epoch_us(time_bucket(interval '1 hour', ts)) as window_us, event_type as action, count(*) as count, round(sum(value), 2) as duration_ms,
  count(case when event_type = 'error' then 1 end) as errors from events group by all""")
def batch_summary(spark, sf_dir):
    rows = view(spark, "e_traces").selectExpr("cast(ts as timestamp) as timestamp", "action", "duration_ms", "error")
    got = live.windowed_summary(rows)
    return got.select(F.unix_micros("window_start").alias("window_us"), "action", "count", F.round("duration_ms", 2).alias("duration_ms"), "errors")
