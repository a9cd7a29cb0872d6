"""Queries over inventories, the graph and incremental selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.functions.kinds import is_executable, is_library, parse_kind, repo_key, slugify
from repoloom.operators import graph as kg
from repoloom.operators import incremental, inventory
from repoloom.plans.bindings import oracle, view
from repoloom.plans.registry import query
from repoloom.sources import sinks

# Recursive parts of oracles, on e_components and an edge view.
DEPTHS = """
pair as (select distinct * from {edges}),
walk as (select repo, name, 0 as depth from e_components
  union select p.repo, p.source, w.depth + 1 from walk w join pair p on p.repo = w.repo and p.target = w.name),
levels as (select repo, name, cast(max(depth) as int) as depth from walk group by repo, name)"""
CYCLES = """
reach as (select repo, source, target from e_edges
  union select r.repo, r.source, e.target from reach r join e_edges e on e.repo = r.repo and e.source = r.target),
mates as (select a.repo, a.source as name, a.target as mate from reach a join reach b on a.repo = b.repo and a.source = b.target and a.target = b.source),
scc as (select c.repo, c.name, coalesce(min(least(m.mate, c.name)), c.name) as scc_id
  from e_components c left join mates m on m.repo = c.repo and m.name = c.name group by c.repo, c.name)"""
CONDENSED = CYCLES + """,
arc as (select distinct e.repo, s.scc_id as source, t.scc_id as target from e_edges e
  join scc s on s.repo = e.repo and s.name = e.source join scc t on t.repo = e.repo and t.name = e.target where s.scc_id <> t.scc_id),
walk as (select distinct repo, scc_id, 0 as depth from scc
  union select a.repo, a.source, w.depth + 1 from walk w join arc a on a.repo = w.repo and a.target = w.scc_id),
levels as (select s.repo, s.name, s.scc_id, cast(max(w.depth) as int) as depth from scc s join walk w on w.repo = s.repo and w.scc_id = s.scc_id group by all)"""


def recursive(parts: str, sql: str, *views: str) -> str:
    base = oracle("", *views).rstrip().removeprefix("with ")
    return f"with recursive {base},{parts}\n{sql}"


def as_deps(spark, edges: str = "e_edges"):
    return view(spark, edges).select("repo", F.col("source").alias("component"), F.col("target").alias("dep"))


def acyclic_levels(spark):
    return kg.depth_levels(view(spark, "e_components"), view(spark, "e_edges_acyclic"))


# --- inventory ----------------------------------------------------------------

_BY_SIZE = "select p_brand as repo, concat(lower(p_type), '/', cast(p_size as varchar(9))) as root_path, p_partkey as ordinal, p_name as name, p_type as kind from part"


@query("inv1_dedupe_components", f"""
select repo, root_path, name, kind, ordinal from (select *, row_number() over (partition by repo, root_path order by ordinal) as n from ({_BY_SIZE}) p) x where n = 1""")
def dedupe(spark, sf_dir):
    return inventory.dedupe_components(spark.sql(_BY_SIZE), F.col("ordinal"))


_LOOSE = """
select e.repo, e.source as component, case p.p_size % 4 when 0 then e.target when 1 then concat(lower(p.p_type), '/', e.target)
  when 2 then substr(e.target, 2, 9) else concat('lib-', e.target) end as dep
from e_edges e join part p on e.target = concat('c', cast(p.p_partkey as varchar(20)))"""


@query("inv2_resolve_internal_deps", oracle(f"""
select d.repo, d.component, r.name as dep from ({_LOOSE}) d join (
  select t.repo, t.dep, coalesce(any_value(x.name), any_value(y.name), case when count(distinct z.name) = 1 then any_value(z.name) end) as name
  from (select distinct repo, dep from ({_LOOSE}) l) t
  left join e_components x on x.repo = t.repo and x.name = t.dep
  left join e_components y on y.repo = t.repo and y.root_path = t.dep
  left join e_components z on z.repo = t.repo and (contains(z.name, t.dep) or contains(t.dep, z.name))
  group by t.repo, t.dep) r on r.repo = d.repo and r.dep = d.dep where r.name is not null""", "e_components", "e_edges"))
def resolve(spark, sf_dir):
    return inventory.resolve_internal_deps(view(spark, "e_components"), spark.sql(_LOOSE))


_SMALL = "select concat(p_brand, '/', p_size) as repo, p_type as type from part"


@query("inv3_repo_shape", f"""
with c as ({_SMALL}), r as (select distinct repo from c union select s_name from supplier),
n as (select repo, count(*) as n, count(distinct type) as t from c group by repo)
select r.repo, coalesce(n, 0) as components, coalesce(t, 0) as types, case when n is null then 'empty' when n = 1 then 'single-package'
  when t > 1 then 'polyglot-monorepo' else 'monorepo' end as shape from r left join n on n.repo = r.repo""")
def shape(spark, sf_dir):
    comps = spark.sql(_SMALL)
    repos = comps.select("repo").union(spark.sql("select s_name as repo from supplier"))
    return inventory.repo_shape(repos, comps)


_FAULTY = """
select p_brand as repo, case when p_size < 4 then concat('dup', p_size) else concat('c', cast(p_partkey as varchar(20))) end as name,
  p_partkey as ordinal, concat(lower(p_type), '/c', cast(p_partkey as varchar(20))) as root_path, p_size from part"""
_FAULTY_DEPS = """
select repo, source as component, target as dep from e_edges union all
select p_brand, concat('c', cast(p_partkey as varchar(20))), concat('c', cast(p_partkey as varchar(20))) from part where p_size = 20"""


@query("inv4_validate_inventory", oracle(f"""
with c as ({_FAULTY}), d as ({_FAULTY_DEPS})
select c.repo, 'duplicate_name' as check, c.name as component,
  concat('Duplicate component name ''', c.name, ''' (roots: ', f.root_path, ', ', c.root_path, ')') as message
from c join (select repo, name, min(ordinal) as ordinal, arg_min(root_path, ordinal) as root_path from c group by all) f
  on f.repo = c.repo and f.name = c.name and f.ordinal < c.ordinal
union all select repo, 'missing_root', name, concat('Component ''', name, ''' root_path does not exist: ', root_path) from c where p_size > 45
union all select distinct repo, 'self_dependency', component, concat('Component ''', component, ''' depends on itself') from d where component = dep
union all select repo, 'unresolved_dependency', component, concat('Component ''', component, ''' has unresolved internal dependency: ''', dep, '''')
from d where not exists (select 1 from c where c.repo = d.repo and c.name = d.dep)""", "e_edges"))
def validate(spark, sf_dir):
    comps = spark.sql(_FAULTY)
    files = comps.filter("p_size <= 45").select("repo", F.concat("root_path", F.lit("/src/a.py")).alias("path"))
    return inventory.validate_inventory(comps, spark.sql(_FAULTY_DEPS), files)


_SIZES = """
select p_brand as repo, concat('c', cast(p_partkey as varchar(20))) as name, p_size as depth from part where p_size <> 50
union all select p_brand, concat('c', cast(p_partkey as varchar(20))), 1 from part where p_size = 7"""


@query("inv5_validate_depths", oracle(f"""
with l as ({_SIZES}), m as (select repo, name, max(depth) as depth from l group by all)
select repo, 'several_levels' as check, name as component, concat('Component ''', name, ''' appears in multiple depth levels') as message
from l group by all having count(*) > 1
union all select c.repo, 'missing_level', c.name, concat('Component missing from depth order: ', c.name) from e_components c
  where not exists (select 1 from l where l.repo = c.repo and l.name = c.name)
union all select e.repo, 'violation', e.source, concat('Topological violation: ''', e.source, ''' (depth ', a.depth, ') depends on ''', e.target, ''' (depth ', b.depth, ')')
from e_edges e join m a on a.repo = e.repo and a.name = e.source join m b on b.repo = e.repo and b.name = e.target where b.depth >= a.depth""",
    "e_components", "e_edges"))
def depths_valid(spark, sf_dir):
    return inventory.validate_depths(view(spark, "e_components"), as_deps(spark), spark.sql(_SIZES)).drop("same_scc")


_SIZED = "select repo, file_path as path, max(start_line) as line_count from e_citations where claim <> 'RO' group by repo, file_path"


@query("inv6_validate_analyses", oracle(f"""
with f as ({_SIZED}), c as (select repo, component, idx_key as idx, file_path, start_line, end_line - 10 as end_line from e_citations where claim <> 'AF'),
a as (select repo, component from c union select repo, name from e_components where kind <> 'library'),
k as (select c.*, f.line_count, concat('[', c.component, '] ') as tag from c left join f on f.repo = c.repo and f.path = c.file_path)
select repo, 'missing_analysis' as check, name as component, concat('Missing analysis file for component ''', name, '''') as message from e_components x
  where not exists (select 1 from a where a.repo = x.repo and a.component = x.name)
union all select repo, 'no_citations', component, concat('[', component, '] citations array is empty (expected 10+)') from a
  where not exists (select 1 from c where c.repo = a.repo and c.component = a.component)
union all select repo, 'missing_file', component, concat(tag, 'Citation file not found: ', file_path) from k where line_count is null
union all select repo, 'bad_range', component, concat(tag, 'Invalid line range ', start_line, '-', end_line, ' in ', file_path) from k
  where line_count is not null and (start_line < 1 or end_line < start_line)
union all select repo, 'beyond_end', component, concat(tag, 'Citation start_line ', start_line, ' > file length ', line_count, ' in ', file_path) from k
  where start_line >= 1 and end_line >= start_line and start_line > line_count""", "e_components", "e_citations"))
def analyses_valid(spark, sf_dir):
    cites = spark.sql("select repo, component, idx_key as idx, file_path, start_line, end_line - 10 as end_line from e_citations where claim <> 'AF'")
    done = cites.select("repo", "component").union(spark.sql("select repo, name from e_components where kind <> 'library'"))
    return inventory.validate_analyses(view(spark, "e_components"), done, cites, spark.sql(_SIZED))


_SIDECARS = """
select repo, name as component, case ordinal % 7 when 1 then '{bad' when 2 then '[1]' when 3 then '{"citations": {"a": 1}}'
  when 4 then '{"citations": [1], "citations": null}' when 5 then '{}' else '{"citations": [{"claim": "x"}]}' end as content
from e_components where ordinal % 7 <> 0"""


@query("inv6_sidecar_files", oracle("""
select repo, component, word as "check", concat('[', component, '] ', message) as message from (
  select repo, name as component, case ordinal % 7 when 0 then 'missing_sidecar' when 1 then 'invalid_json' when 2 then 'no_object' when 5 then 'no_citations' else 'no_array' end as word,
    case ordinal % 7 when 0 then concat('Missing sidecar file: ', name, '.citations.json') when 1 then concat('Invalid JSON in ', name, '.citations.json')
      when 2 then concat(name, '.citations.json must be a JSON object, got list') when 3 then '''citations'' must be a JSON array, got dict'
      when 5 then 'citations array is empty (expected 10+)' else '''citations'' must be a JSON array, got NoneType' end as message
  from e_components where ordinal % 7 <> 6 and kind <> 'library') x
union all select repo, name, 'missing_analysis', concat('Missing analysis file for component ''', name, '''') from e_components where kind = 'library'""", "e_components"))
def sidecar_files(spark, sf_dir):
    comps = view(spark, "e_components")
    done = comps.filter("kind <> 'library'").select("repo", F.col("name").alias("component"))
    cites = comps.filter("ordinal % 7 = 6").selectExpr("repo", "name as component", "0 as idx", "root_path as file_path", "1 as start_line", "1 as end_line")
    files = comps.selectExpr("repo", "root_path as path", "1 as line_count")
    return inventory.validate_analyses(comps, done, cites, files, spark.sql(_SIDECARS)).select("repo", "component", "check", "message")


@query("inv7_kinds", oracle("""
select name, kind as kind_parsed, case when t in ('library', 'service', 'cli', 'contract', 'infra', 'pipeline', 'frontend') then t else 'unknown' end as type_parsed,
  kind = 'library' as is_library, kind in ('service', 'cli', 'frontend', 'pipeline') as is_executable
from (select *, split_part(root_path, '/', 1) as t from e_components) x""", "e_components"))
def kinds(spark, sf_dir):
    kind = parse_kind(F.upper("kind"))
    return view(spark, "e_components").select(
        "name", kind.alias("kind_parsed"), parse_kind(F.substring_index("root_path", "/", 1)).alias("type_parsed"),
        is_library(kind).alias("is_library"), is_executable(kind).alias("is_executable"),
    )


@query("inv8_inventory_counts", oracle("""
select repo, 'total_components' as metric, '' as key, count(*) as value from e_components group by all
union all select repo, 'by_kind', kind, count(*) from e_components group by all
union all select repo, 'by_language', type, count(*) from e_components group by all""", "e_components"))
def counts(spark, sf_dir):
    return inventory.inventory_counts(view(spark, "e_components"))


@query("inv8_components_by_kind", oracle("select repo, name, root_path from e_components where kind = 'service'", "e_components"))
def services_only(spark, sf_dir):
    return inventory.components_by_kind(view(spark, "e_components"), "service").select("repo", "name", "root_path")


@query("inv9_repo_keys", """
select concat('https://github.com/acme/', replace(s_name, '#', '-'), case when s_nationkey % 2 = 0 then '.git' else '/tree/main' end) as source,
  replace(s_name, '#', '-') as repo, replace(concat('acme/', s_name), '/', '__') as slug from supplier
union all select url, regexp_extract(url, '([^/]+)/*$', 1), replace(url, '/', '__') from pages
union all select n_name, n_name, n_name from nation""")
def keys(spark, sf_dir):
    rows = spark.sql("""
        select concat('https://github.com/acme/', replace(s_name, '#', '-'), case when s_nationkey % 2 = 0 then '.git' else '/tree/main' end) as source,
          concat('acme/', s_name) as full_name from supplier
        union all select url, url from pages union all select n_name, n_name from nation""")
    return rows.select("source", repo_key(F.col("source")).alias("repo"), slugify(F.col("full_name")).alias("slug"))


# --- graph --------------------------------------------------------------------

_TWICE = """
select repo, name, ordinal, kind from e_components union all
select p_brand, concat('c', cast(p_partkey as varchar(20))), p_partkey + 1000000000, 'infra' from part where p_size < 10"""
_KNOWN_OR_NOT = "select repo, source as component, target as dep from e_edges union all select repo, source, target from e_integrations"


@query("kg1_build_graph", oracle(f"""
select c.repo, c.name as source, case when p_size < 10 then 'infra' else kind end as kind, e.target, case when e.target is not null then 1.0 end as confidence
from e_components c join part on p_partkey = c.ordinal left join e_edges e on e.repo = c.repo and e.source = c.name""", "e_components", "e_edges"))
def build(spark, sf_dir):
    g = kg.build_graph(spark.sql(_TWICE), spark.sql(_KNOWN_OR_NOT))
    nodes = g.components.select("repo", F.col("name").alias("source"), "kind")
    return nodes.join(g.edges.select("repo", "source", "target", "confidence"), ["repo", "source"], "left")


def _typed(spark):
    g = kg.build_graph(view(spark, "e_components"), as_deps(spark))
    g = kg.add_edges(g, view(spark, "e_integrations"), "integrates_with", 0.8)
    calls = spark.sql("""select p_brand as repo, concat('c', cast(l_partkey as varchar(20))) as source, concat('c', cast(l_orderkey as varchar(20))) as target,
        case l_returnflag when 'A' then 'HTTP' when 'N' then 'grpc' else 'pigeon' end as protocol from lineitem join part on p_partkey = l_partkey""")
    return kg.add_edges(g, calls, "calls", 0.5)


@query("kg2_add_edges", oracle("""
select repo, 'depends_on' as edge_type, cast(null as varchar) as protocol, 1.0 as confidence, count(*) as n from e_edges group by repo
union all select repo, 'integrates_with', null, 0.8, count(*) from e_integrations group by repo
union all select p_brand, 'calls', case l_returnflag when 'A' then 'http' when 'N' then 'grpc' else 'unknown' end, 0.5, count(*)
from lineitem join part on p_partkey = l_partkey group by all""", "e_edges", "e_integrations"))
def add(spark, sf_dir):
    return _typed(spark).edges.groupBy("repo", "edge_type", "protocol", "confidence").agg(F.count("*").alias("n"))


_USED = """
select i.repo, i.target as id, s.name, s.category, 1 as ordinal from e_integrations i join e_services s on s.id = i.target
union all select i.repo, i.target, s.name, 'carrier pigeon', 2 from e_integrations i join e_services s on s.id = i.target where s.category = 'cache'"""


@query("kg3_add_services", oracle("""
select distinct i.repo, s.id, s.name, case s.category when 'cache' then 'other' else s.category end as category
from e_integrations i join e_services s on s.id = i.target""", "e_integrations", "e_services"))
def services(spark, sf_dir):
    g = kg.build_graph(view(spark, "e_components"), as_deps(spark))
    return kg.add_services(g, spark.sql(_USED)).services.select("repo", "id", "name", "category")


@query("kg4_node_ids", oracle("select repo, name as id from e_components union select repo, target from e_integrations", "e_components", "e_integrations"))
def nodes(spark, sf_dir):
    g = kg.build_graph(view(spark, "e_components"), as_deps(spark))
    return kg.node_ids(kg.add_services(g, spark.sql(_USED)))


def _libraries(spark):
    return spark.sql("select repo, name as id from e_components where kind = 'library'")


@query("kg5_edges_from", oracle("""
select repo, source, target, 'integrates_with' as edge_type from e_integrations
where exists (select 1 from e_components c where c.repo = e_integrations.repo and c.name = source and c.kind = 'library')""", "e_components", "e_integrations"))
def edges_from(spark, sf_dir):
    return kg.edges_from(_typed(spark).edges, _libraries(spark), "integrates_with").select("repo", "source", "target", "edge_type")


@query("kg5_edges_to", oracle("""
select e.repo, e.source, e.target, 'depends_on' as edge_type from e_edges e join e_components c on c.repo = e.repo and c.name = e.target and c.kind = 'library'
union all select p.p_brand, concat('c', l_partkey), c.name, 'calls' from lineitem join part p on p.p_partkey = l_partkey
join e_components c on c.repo = p.p_brand and c.kind = 'library' and c.name = concat('c', l_orderkey)""", "e_components", "e_edges"))
def edges_to(spark, sf_dir):
    return kg.edges_to(_typed(spark).edges, _libraries(spark)).select("repo", "source", "target", "edge_type")


@query("kg6_dependents", oracle("""
select c.repo, c.name, count(distinct a.target) as dependencies, count(distinct b.source) as dependents from e_components c
left join e_edges a on a.repo = c.repo and a.source = c.name left join e_edges b on b.repo = c.repo and b.target = c.name
where c.kind = 'library' group by c.repo, c.name having count(a.target) + count(b.source) > 0""", "e_components", "e_edges"))
def dependents(spark, sf_dir):
    edges, libs = view(spark, "e_edges"), _libraries(spark)
    down = kg.dependencies(edges, libs).select("repo", F.col("source").alias("name"), F.lit(1).alias("d"), F.lit(0).alias("u"))
    up = kg.dependents(edges, libs).select("repo", F.col("target").alias("name"), F.lit(0).alias("d"), F.lit(1).alias("u"))
    return down.unionByName(up).groupBy("repo", "name").agg(F.sum("d").alias("dependencies"), F.sum("u").alias("dependents"))


_BAG = """
select p_brand as repo, concat('c', cast(l_partkey as varchar(20))) as source, concat('s', cast(l_suppkey as varchar(20))) as target,
  case when l_returnflag = 'N' then 'calls' else 'depends_on' end as edge_type from lineitem join part on p_partkey = l_partkey"""


@query("kg7_simple_graph", f"select distinct repo, source, target from ({_BAG}) b where edge_type = 'depends_on'")
def simple(spark, sf_dir):
    return kg.simple_graph(spark.sql(_BAG))


@query("kg8_strong_components", recursive(CYCLES, "select * from scc", "e_components", "e_edges"))
def strong(spark, sf_dir):
    return kg.strong_components(view(spark, "e_components"), view(spark, "e_edges"))


@query("kg9_depth_levels", recursive(CONDENSED, "select * from levels", "e_components", "e_edges"))
def depth(spark, sf_dir):
    return kg.depth_levels(view(spark, "e_components"), view(spark, "e_edges"))


@query("kg9_depth_levels_acyclic", recursive(DEPTHS.format(edges="e_edges_acyclic"), "select repo, name, depth from levels", "e_components", "e_edges_acyclic"))
def depth_acyclic(spark, sf_dir):
    return acyclic_levels(spark).drop("scc_id")


@query("kg10_topological_order", recursive(
    "sub as (select repo, name from e_components where kind <> 'contract'), pair as (select e.* from e_edges_acyclic e join sub a on a.repo = e.repo and a.name = e.source "
    "join sub b on b.repo = e.repo and b.name = e.target), walk as (select repo, name, 0 as level from sub union select p.repo, p.source, w.level + 1 "
    "from walk w join pair p on p.repo = w.repo and p.target = w.name)",
    "select repo, name, max(level) as level from walk group by repo, name", "e_components", "e_edges_acyclic"))
def topological(spark, sf_dir):
    subset = spark.sql("select repo, name from e_components where kind <> 'contract'")
    return kg.topological_order(subset, view(spark, "e_edges_acyclic"))


_DONE = "select distinct p_brand as repo, concat('c', cast(l_partkey as varchar(20))) as component from lineitem join part on p_partkey = l_partkey where l_returnflag = 'R' and l_quantity > 48"


@query("kg11_with_analysis", oracle(f"""
select c.repo, c.name, d.component is not null as analysed from e_components c left join ({_DONE}) d on d.repo = c.repo and d.component = c.name""", "e_components"))
def analysed(spark, sf_dir):
    comps, done = view(spark, "e_components"), spark.sql(_DONE)
    yes = kg.with_analysis(comps, done).select("repo", "name", F.lit(True).alias("analysed"))
    return yes.union(kg.without_analysis(comps, done).select("repo", "name", F.lit(False).alias("analysed")))


@query("kg12_graph_stats", oracle(f"""
select repo, 'component_count' as metric, count(*) as value from e_components group by repo
union all select repo, concat('by_kind.', kind), count(*) from e_components group by repo, kind
union all select repo, 'external_service_count', count(distinct target) from e_integrations group by repo
union all select repo, 'edge_count', count(*) from (select repo from e_edges union all select repo from e_integrations) x group by repo
union all select repo, 'by_edge_type.depends_on', count(*) from e_edges group by repo
union all select repo, 'by_edge_type.integrates_with', count(*) from e_integrations group by repo
union all select repo, 'analyzed_count', count(*) from ({_DONE}) d group by repo""", "e_components", "e_edges", "e_integrations"))
def stats(spark, sf_dir):
    g = kg.build_graph(view(spark, "e_components"), as_deps(spark))
    g = kg.add_services(kg.add_edges(g, view(spark, "e_integrations"), "integrates_with"), spark.sql(_USED))
    return kg.graph_stats(g, spark.sql(_DONE))


@query("kg13_level_summary", recursive(DEPTHS.format(edges="e_edges_acyclic"),
    "select l.repo, l.depth, c.kind, count(*) as components from levels l join e_components c on c.repo = l.repo and c.name = l.name group by all",
    "e_components", "e_edges_acyclic"))
def summary(spark, sf_dir):
    return kg.level_summary(view(spark, "e_components"), acyclic_levels(spark))


@query("kg14_json_round_trip", oracle("""
select repo, 'component' as part, name as a, concat(kind, ' ', type, ' ', root_path) as b, 0.0 as confidence from e_components
union all select repo, 'edge', source, concat(target, ' depends_on'), 1.0 from e_edges
union all select distinct i.repo, 'service', i.target, concat(s.name, ' ', case s.category when 'cache' then 'other' else s.category end), 0.0
from e_integrations i join e_services s on s.id = i.target""", "e_components", "e_edges", "e_integrations", "e_services"))
def round_trip(spark, sf_dir):
    g = kg.add_services(kg.build_graph(view(spark, "e_components"), as_deps(spark)), spark.sql(_USED))
    back = sinks.graph_from_records(sinks.graph_records(g))
    lit = F.lit
    return (
        back.components.select("repo", lit("component").alias("part"), F.col("name").alias("a"), F.concat_ws(" ", "kind", "type", "root_path").alias("b"), lit(0.0).alias("confidence"))
        .union(back.edges.select("repo", lit("edge"), "source", F.concat_ws(" ", "target", "edge_type"), "confidence"))
        .union(back.services.select("repo", lit("service"), "id", F.concat_ws(" ", "name", "category"), lit(0.0)))
    )


@query("kg15_cited_by_edges", oracle("select distinct repo, component as source, file_path as target, 'cited_by' as edge_type from e_citations", "e_citations"))
def cited(spark, sf_dir):
    return kg.cited_by_edges(view(spark, "e_citations")).select("repo", "source", "target", "edge_type")


# --- incremental --------------------------------------------------------------

_ROOTS = """
select repo, name, name as root_path, row_number() over (partition by repo order by name) as ordinal from e_roots
union all select distinct repo, concat('page-', path), path, 1000 + length(path) from e_files where path like '%.html'"""
_OWNED = f"""
select f.repo, f.path, {{pick}}(c.name, {{key}}) as component from e_files f
left join ({_ROOTS}) c on c.repo = f.repo and (f.path = c.root_path or starts_with(f.path, c.root_path || '/')) group by f.repo, f.path"""


@query("dif1_map_files", oracle(_OWNED.format(pick="arg_min", key="c.ordinal"), "e_files", "e_roots"))
def mapped(spark, sf_dir):
    return incremental.owners(view(spark, "e_files"), spark.sql(_ROOTS))


@query("dif1_map_files_longest", oracle(_OWNED.format(pick="arg_max", key="length(c.root_path)"), "e_files", "e_roots"))
def mapped_longest(spark, sf_dir):
    return incremental.owners(view(spark, "e_files"), spark.sql(_ROOTS), policy="longest")


@query("dif2_diff_plan", oracle(f"""
with o as ({_OWNED.format(pick="arg_min", key="c.ordinal")}),
r as (select repo, case when length(repo) % 3 = 0 then '' else repo end as last_sha from e_files group by repo union select s_name, 'abc' from supplier),
n as (select repo, count(distinct component) as a, count(*) - count(component) as u from o group by repo), k as (select distinct repo from e_roots union select repo from e_files where path like '%.html')
select r.repo, case when r.last_sha = '' or k.repo is null or n.repo is null then 'full' else 'incremental' end as mode,
  case when r.last_sha = '' or k.repo is null or n.repo is null then 0 else a end as affected, case when r.last_sha = '' or k.repo is null or n.repo is null then 0 else u end as unmapped
from r left join n on n.repo = r.repo left join k on k.repo = r.repo""", "e_files", "e_roots"))
def plan(spark, sf_dir):
    files = view(spark, "e_files")
    repos = files.select("repo").distinct().withColumn("last_sha", F.when(F.length("repo") % 3 == 0, "").otherwise(F.col("repo")))
    repos = repos.union(spark.sql("select s_name, 'abc' from supplier"))
    return incremental.diff_plan(repos, files, spark.sql(_ROOTS))


@query("dif3_change_worklist", oracle(f"""
with o as ({_OWNED.format(pick="arg_min", key="c.ordinal")}), a as (select distinct repo, component from o where component is not null),
b as (select distinct f.repo, a.component, f.path from a join ({_ROOTS}) c on c.repo = a.repo and c.name = a.component
  join e_files f on f.repo = c.repo and (f.path = c.root_path or starts_with(f.path, c.root_path || '/')))
select repo, 'changed' as section, component, path, pos from (select *, row_number() over (partition by repo, component order by string_split(path, '/')) as pos from b) x
union all select repo, 'unmapped', null, path, pos from (select *, row_number() over (partition by repo order by string_split(path, '/')) as pos from o where component is null) y""",
    "e_files", "e_roots"))
def worklist(spark, sf_dir):
    return incremental.change_worklist(view(spark, "e_files"), spark.sql(_ROOTS))


@query("dif4_affected_dependents", recursive(
    "start as (select repo, name from e_components where kind = 'library'), walk as (select repo, name, 0 as hop from start union "
    "select e.repo, e.source, w.hop + 1 from walk w join e_edges e on e.repo = w.repo and e.target = w.name where w.hop < 3)",
    "select repo, name as component, min(hop) as hop from walk group by all having min(hop) > 0", "e_components", "e_edges"))
def affected(spark, sf_dir):
    start = spark.sql("select repo, name as component from e_components where kind = 'library'")
    return incremental.affected_dependents(start, view(spark, "e_edges"), hops=3)


@query("dif4_affected_closure", recursive(
    "start as (select repo, name from e_components where kind = 'library'), walk as (select repo, name from start union "
    "select e.repo, e.source from walk w join e_edges e on e.repo = w.repo and e.target = w.name)",
    "select repo, name as component from walk except select repo, name from start", "e_components", "e_edges"))
def affected_closure(spark, sf_dir):
    start = spark.sql("select repo, name as component from e_components where kind = 'library'")
    return incremental.affected_dependents(start, view(spark, "e_edges")).select("repo", "component")
