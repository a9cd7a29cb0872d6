"""Queries over citations, analyses, audits, artifacts and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.operators import analyses, artifacts, audit, citations, observability
from repoloom.plans.bindings import oracle, view
from repoloom.plans.estate_queries import DEPTHS, _DONE, acyclic_levels, recursive
from repoloom.plans.registry import query

# --- citations: Spark renders the Markdown, the oracle reads the rows ------------

_FAULTS = """
select repo, component, idx_key, file_path as true_path,
  case when claim = 'NO' and end_line > 45 then '' else concat('/tmp/run/project/', file_path) end as file_path,
  case when claim = 'AF' and end_line < 6 then 0 else start_line end as start_line,
  case when claim = 'RF' then end_line - 10 else end_line end as end_line,
  case when claim = 'RO' and start_line = 7 then '' else claim end as claim
from e_citations"""
_ORDER = "idx_key, file_path, start_line, end_line, claim"
_RAW = f"select *, row_number() over (partition by repo, component order by {_ORDER}) - 1 as idx from ({_FAULTS}) f"
# Which kinds of component have a block that gives rows?
_READABLE = "select repo, name as component from e_components where kind not in ('cli', 'pipeline', 'frontend', 'contract')"


def rendered(spark, broken: bool = False):
    """One Markdown analysis per component with a fenced block of its citations."""
    item = F.struct("idx_key", "file_path", "start_line", "end_line", "claim")
    per = spark.sql(_FAULTS).groupBy("repo", "component").agg(F.array_sort(F.collect_list(item)).alias("items"))
    block = F.to_json(F.transform("items", lambda s: F.struct(s["file_path"].alias("file_path"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["claim"].alias("claim"))))
    if broken:
        per = per.join(view(spark, "e_components").select("repo", F.col("name").alias("component"), "kind"), ["repo", "component"])
        block = F.when(F.col("kind") == "cli", "").when(F.col("kind") == "pipeline", "[{oops").when(F.col("kind") == "frontend", '{"a": 1}').otherwise(block)
        head = F.when(F.col("kind") == "contract", "## Sources").otherwise("## Citations")
    else:
        head = F.lit("## Citations")
    text = F.concat(
        F.lit("# "), F.col("component"), F.lit("\n\n## Summary\n\nAll about it.\n\n\n\n## Analysis Data\n\n```json\n{\"summary\": \"s\"}\n```\n\n"),
        head, F.lit("\n<!-- provenance -->\n\n```json\n"), block, F.lit("\n```\n\n"),
    )
    return per.select("repo", "component", text.alias("markdown"))


@query("cit1_extract_citations", oracle(f"""
select r.repo, r.component, cast(idx as int) as idx, file_path, start_line from ({_RAW}) r join ({_READABLE}) c on c.repo = r.repo and c.component = r.component""",
    "e_citations", "e_components"))
def extract(spark, sf_dir):
    got = citations.extract_citations(rendered(spark, broken=True))
    get = lambda n, t: F.try_variant_get("item", f"$.{n}", t).alias(n)
    return got.select("repo", "component", "idx", get("file_path", "string"), get("start_line", "int"))


@query("cit1_extraction_errors", oracle("""
select distinct c.repo, c.component, case k.kind when 'cli' then '## Citations JSON block is empty' when 'pipeline' then 'Invalid JSON in ## Citations block'
  when 'frontend' then '## Citations JSON must be an array, got dict' else 'No ## Citations section with a ```json code block found' end as error
from e_citations c join e_components k on k.repo = c.repo and k.name = c.component where k.kind in ('cli', 'pipeline', 'frontend', 'contract')""",
    "e_citations", "e_components"))
def extract_errors(spark, sf_dir):
    return citations.extraction_errors(rendered(spark, broken=True))


_BAD = f"""
select repo, component, idx, concat('Citation [', idx, ']: ', message) as error from (
  select repo, component, idx, 'Missing required field ''file_path''' as message from ({_RAW}) r where file_path = ''
  union all select repo, component, idx, concat('Invalid start_line: ', start_line, ' (must be positive integer)') from ({_RAW}) r where start_line < 1
  union all select repo, component, idx, concat('Invalid end_line: ', end_line, ' (must be positive integer)') from ({_RAW}) r where end_line < 1
  union all select repo, component, idx, concat('end_line (', end_line, ') < start_line (', start_line, ')') from ({_RAW}) r where end_line < start_line
  union all select repo, component, idx, 'Missing required field ''claim''' from ({_RAW}) r where claim = '') m"""


@query("cit2_citation_errors", oracle(f"select repo, component, cast(idx as int) as idx, error from ({_BAD}) b", "e_citations"))
def invalid(spark, sf_dir):
    return citations.citation_errors(citations.check_citations(citations.extract_citations(rendered(spark))))


_VALID = f"select * from ({_RAW}) r where file_path <> '' and start_line >= 1 and end_line >= start_line and claim <> ''"


@query("cit2_valid_citations", oracle(f"select repo, component, cast(idx as int) as idx, true_path as file_path, start_line, end_line, claim from ({_VALID}) v", "e_citations"))
def valid(spark, sf_dir):
    checked = citations.check_citations(citations.extract_citations(rendered(spark)))
    return citations.valid_citations(checked).drop("section", "snippet")


@query("cit3_normalize_path", oracle("""
select true_path as path, count(*) as n from (
  select file_path as true_path from e_citations where claim <> 'RO' union all select concat('.github/', file_path) from e_citations where claim = 'RO') x
group by true_path""", "e_citations"))
def normalized(spark, sf_dir):
    raw = F.when(F.col("claim") == "AF", F.concat(F.lit("/tmp/a-b/project/"), "file_path")).when(F.col("claim") == "NO", F.concat(F.lit("././"), "file_path")) \
        .when(F.col("claim") == "RO", F.concat(F.lit("./.github/"), "file_path")).otherwise(F.concat(F.lit("//"), "file_path"))
    return view(spark, "e_citations").groupBy(citations.normalize_path(raw).alias("path")).agg(F.count("*").alias("n"))


# Paths written in four shapes: from the repository root, bare, with the last
# folder of the component repeated, and with a file that does not exist.
_SHAPES = """
select repo, component, row_number() over (partition by repo, component order by file_path, idx_key, start_line, end_line, claim) as idx, claim, file_path as true_path,
  case claim when 'AF' then file_path when 'NO' then regexp_replace(file_path, '^.*/', '')
    when 'RF' then regexp_replace(file_path, '^[^/]*/', '') else concat('ghost/', file_path) end as file_path
from e_citations"""


@query("cit4_resolve_paths", oracle(f"""
select repo, component, cast(idx as int) as idx, case when claim in ('AF', 'NO', 'RF') then true_path end as resolved from ({_SHAPES}) s""", "e_citations"))
def resolved(spark, sf_dir):
    files = view(spark, "e_citations").select("repo", F.col("file_path").alias("path")).distinct()
    roots = citations.component_roots(view(spark, "e_components"))
    return citations.resolve_citation_paths(spark.sql(_SHAPES), files, roots).select("repo", "component", "idx", "resolved")


@query("cit4_missing_files", oracle(f"""
select repo, component, cast(idx as int) as idx, concat('Citation [', idx, ']: Cited file does not exist: ', file_path) as error
from ({_SHAPES}) s where claim not in ('AF', 'NO', 'RF')""", "e_citations"))
def missing_files(spark, sf_dir):
    files = view(spark, "e_citations").select("repo", F.col("file_path").alias("path")).distinct()
    rows = spark.sql(_SHAPES).withColumn("errors", F.array().cast("array<string>"))
    return citations.citation_errors(citations.checked_against_files(rows, files, citations.component_roots(view(spark, "e_components"))))


@query("cit5_component_roots", oracle("""
select repo, name as component, root_path from e_components where kind not in ('cli', 'service')""", "e_components"))
def roots(spark, sf_dir):
    blank = F.when(F.col("kind") == "cli", ".").when(F.col("kind") == "service", "").otherwise(F.col("root_path"))
    return citations.component_roots(view(spark, "e_components").withColumn("root_path", blank))


_SITE = "case l_returnflag when 'A' then 'https://github.com/o/r/' when 'N' then 'https://gitlab.example.com/o/r' else case when l_linestatus = 'F' then 'https://bitbucket.org/o/r' else '' end end"
_LINKS = f"""
select l_orderkey, l_linenumber as s, l_linenumber + cast(l_tax * 100 as int) as e, concat('src/f', l_suppkey, '.py') as path,
  {_SITE} as base, case when l_linestatus = 'O' then '' else 'abc123' end as sha from lineitem"""


@query("cit6_source_url", f"""
select path, s, e, url, count(*) as n from (select *, case when base = '' then '' when base like '%gitlab%' then concat(base, '/blob/', r, '/', path, '#L', s, '-', e)
  when base like '%bitbucket%' then concat(base, '/src/', r, '/', path, '#lines-', s, ':', e)
  when s = e then concat('https://github.com/o/r/blob/', r, '/', path, '#L', s) else concat('https://github.com/o/r/blob/', r, '/', path, '#L', s, '-L', e) end as url
  from (select *, case when sha = '' then 'HEAD' else sha end as r from ({_LINKS}) l) x) y group by all""")
def urls(spark, sf_dir):
    col = F.col
    url = citations.source_url(col("base"), col("sha"), col("path"), col("s"), col("e"))
    return spark.sql(_LINKS).groupBy("path", "s", "e", url.alias("url")).agg(F.count("*").alias("n"))


@query("cit7_citation_link", f"""
select case when base = '' then label else concat('[', label, '](', base, ')') end as link, count(*) as n
from (select base, concat('`', path, ':', s, case when s = e then '' else concat('-', e) end, '`') as label from ({_LINKS}) l) x group by all""")
def links(spark, sf_dir):
    label = citations.citation_label(F.col("path"), F.col("s"), F.col("e"))
    return spark.sql(_LINKS).groupBy(citations.citation_link(label, F.col("base")).alias("link")).agg(F.count("*").alias("n"))


@query("cit8_citation_index", oracle(f"""
with r as (select x.* from ({_RAW}) x join ({_READABLE}) c on c.repo = x.repo and c.component = x.component),
a as (select distinct repo, component from e_citations),
p as (select a.repo, a.component, count(r.idx) as raw, count(case when r.file_path <> '' and start_line >= 1 and end_line >= start_line and claim <> '' then 1 end) as ok,
  sum(case when r.idx is null then 1 else (case when file_path = '' then 1 else 0 end) + (case when start_line < 1 then 1 else 0 end) + (case when end_line < 1 then 1 else 0 end)
    + (case when end_line < start_line then 1 else 0 end) + (case when claim = '' then 1 else 0 end) end) as errs
  from a left join r on r.repo = a.repo and r.component = a.component group by all)
select repo, cast(sum(ok) as bigint) as total_citations, cast(sum(raw) as bigint) as total_raw_parsed, cast(sum(errs) as bigint) as total_validation_errors,
  count(case when ok > 0 then 1 end) as components_with_citations, count(case when raw = 0 then 1 end) as components_without_citations, count(*) as components_analyzed
from p group by repo""", "e_citations", "e_components"))
def index(spark, sf_dir):
    done = rendered(spark, broken=True)
    checked = citations.check_citations(citations.extract_citations(done))
    return citations.citation_index(done, checked, citations.extraction_errors(done))


@query("cit9_strip_sections", oracle(f"""
select a.repo, a.component, concat('# ', a.component, chr(10), chr(10), '## Summary', chr(10), chr(10), 'All about it.', chr(10)) as markdown, true as stable
from (select distinct repo, component from e_citations) a where exists (select 1 from ({_VALID}) v where v.repo = a.repo and v.component = a.component)""", "e_citations"))
def stripped(spark, sf_dir):
    done = rendered(spark)
    good = citations.valid_citations(citations.check_citations(citations.extract_citations(done)))
    out = citations.strip_sections(done, good).join(good.select("repo", "component").distinct(), ["repo", "component"], "left_semi")
    return out.withColumn("stable", citations.strip_blocks(F.col("markdown")) == F.col("markdown"))


# --- analyses -------------------------------------------------------------------

_MD = """
select source as repo, concat('d', cast(doc_id as varchar(20))) as component, case lang when 'en' then text
  when 'fr' then concat('# t', chr(10), '## Overview of all', chr(10), text, chr(10), '## Next', chr(10), 'later')
  when 'de' then concat('# t', chr(10), 'intro', chr(10), '## Summary', chr(10), chr(10), '### a', chr(10), 'b', chr(10), '## Summary', chr(10), text)
  else concat('# t', chr(10), '## Summary', chr(10), '## Details', chr(10), text) end as markdown from documents"""
_SUMMARY = f"""
select repo, component, coalesce(case when hd > 0 then nullif(array_to_string(told[1:5], chr(10)), '') end, left(prose[1], 500), '(no summary available)') as summary from (
  select *, list_filter(case when stop > 0 then after[1:stop - 1] else after end, lambda l: regexp_matches(l, '\\S')) as told from (
    select *, coalesce(list_position(list_transform(after, lambda l: starts_with(l, '## ')), true), 0) as stop from (
      select *, list_filter(rows[hd + 1:], lambda l: not (contains(l, '## Summary') or contains(l, '## Overview'))) as after from (
        select *, coalesce(list_position(list_transform(rows, lambda l: contains(l, '## Summary') or contains(l, '## Overview')), true), 0) as hd,
          list_filter(rows, lambda l: regexp_matches(l, '\\S') and not starts_with(l, '#')) as prose
        from (select *, string_split(markdown, chr(10)) as rows from ({_MD}) m) a) b) c) d) e"""


_WHOLE_SUMMARY = _SUMMARY.replace("told[1:5]", "told").replace("left(prose[1], 500)", "prose[1]")


@query("ana1_extract_summary", _SUMMARY)
def summaries(spark, sf_dir):
    return analyses.extract_summary(spark.sql(_MD.replace("chr(10)", "char(10)")))


@query("ana1_whole_summary", _WHOLE_SUMMARY)
def whole_summaries(spark, sf_dir):
    return analyses.extract_summary(spark.sql(_MD.replace("chr(10)", "char(10)")), None, None)


# Summaries of components: their retail name, for those that are analysed.
_TOLD = f"select d.repo, d.component, concat(p_name, ' of ', d.component) as summary from ({_DONE}) d join part on d.component = concat('c', cast(p_partkey as varchar(20)))"


@query("ana2_upstream_context", oracle(f"""
select e.repo, e.source as component, t.component as dep, concat('### ', t.component, chr(10), t.summary) as section, e.pos from (
  select *, row_number() over (partition by repo, source order by target) as pos from e_edges) e
join ({_TOLD}) t on t.repo = e.repo and t.component = e.target""", "e_edges"))
def context(spark, sf_dir):
    deps = spark.sql("select repo, source as component, target as dep, row_number() over (partition by repo, source order by target) as pos from e_edges")
    return analyses.upstream_context(deps, spark.sql(_TOLD))


@query("ana3_level_worklist", recursive(DEPTHS.format(edges="e_edges_acyclic"),
    "select l.repo, l.name, l.depth, c.kind from levels l left join e_components c on c.repo = l.repo and c.name = l.name and c.kind <> 'cli'", "e_components", "e_edges_acyclic"))
def level_work(spark, sf_dir):
    comps = view(spark, "e_components")
    work, unknown = analyses.level_worklist(acyclic_levels(spark), comps.filter("kind <> 'cli'").select("repo", "name", "kind"))
    return work.unionByName(unknown.withColumn("kind", F.lit(None).cast("string")))


@query("ana4_fold_upstream", recursive(DEPTHS.format(edges="e_edges_acyclic") + """,
paths as (select repo, name, name as top, cast(p_size as bigint) as w, 0 as d from e_components join part on p_partkey = ordinal
  union all select p.repo, p.source, x.top, x.w, x.d + 1 from paths x join pair p on p.repo = x.repo and p.target = x.name)""",
    "select l.repo, l.name, l.depth, cast(sum(x.w) as bigint) as value from levels l join paths x on x.repo = l.repo and x.name = l.name group by all",
    "e_components", "e_edges_acyclic"))
def fold(spark, sf_dir):
    """Own size plus the values of all direct dependencies: a path-weighted sum."""
    comps = view(spark, "e_components").join(spark.table("part").selectExpr("p_partkey as ordinal", "p_size"), "ordinal").select("repo", "name", "p_size")
    return analyses.fold_upstream(
        comps, view(spark, "e_edges_acyclic"), acyclic_levels(spark), [F.sum("value").alias("below")],
        F.col("p_size") + F.coalesce("below", F.lit(0)), value_type="bigint",
    )


def _describe(row: dict) -> str | None:
    if row["kind"] == "pipeline":
        raise ValueError("no analyzer for " + row["name"])
    if row["kind"] == "contract":
        return ""
    return f"{row['name']}:{row['kind']}:{int(row['failed']) if row['failed'] == row['failed'] and row['failed'] else 0}"


_OUTCOME = recursive(DEPTHS.format(edges="e_edges_acyclic"), """
select l.repo, l.name, l.depth, case c.kind when 'pipeline' then concat('Error: component analyzer crashed: no analyzer for ', l.name) when 'contract' then ''
  else concat(l.name, ':', c.kind, ':', (select count(*) from e_edges_acyclic e join e_components t on t.repo = e.repo and t.name = e.target
    where e.repo = l.repo and e.source = l.name and t.kind = 'pipeline')) end as value
from levels l join e_components c on c.repo = l.repo and c.name = l.name""", "e_components", "e_edges_acyclic")


def _described(spark):
    failed = F.count_if(F.startswith("value", F.lit("Error"))).alias("failed")
    comps = view(spark, "e_components").select("repo", "name", "kind")
    return analyses.fold_upstream(comps, view(spark, "e_edges_acyclic"), acyclic_levels(spark), [failed], _describe)


@query("ana4_fold_python", _OUTCOME)
def fold_python(spark, sf_dir):
    return _described(spark)


@query("ana5_analysis_outcome", recursive(DEPTHS.format(edges="e_edges_acyclic"), """
select l.repo, l.depth, count(case when c.kind not in ('pipeline', 'contract') then 1 end) as succeeded, count(case when c.kind in ('pipeline', 'contract') then 1 end) as failed
from levels l join e_components c on c.repo = l.repo and c.name = l.name group by all""", "e_components", "e_edges_acyclic"))
def outcome(spark, sf_dir):
    return analyses.analysis_outcome(_described(spark))


def _written(spark):
    """Analyses whose data block lists one interaction and one integration per row."""
    calls = spark.sql("select repo, source as component, target, 'calls' as type, 'HTTP' as protocol from e_edges")
    per_call = calls.groupBy("repo", "component").agg(F.collect_list(F.struct("target", "type", "protocol")).alias("component_interactions"))
    uses = spark.sql("select i.repo, i.source as component, s.name as service, s.category from e_integrations i join e_services s on s.id = i.target")
    per_use = uses.groupBy("repo", "component").agg(F.collect_list(F.struct("service", "category")).alias("external_integrations"))
    both = per_use.join(per_call, ["repo", "component"], "left")
    body = F.to_json(F.struct(F.concat(F.lit("About "), "component").alias("summary"), F.array(F.lit("spark"), F.col("component")).alias("tech_stack"), "component_interactions", "external_integrations"))
    return both.select("repo", "component", F.concat(F.lit("# x\n## Analysis Data\n```json\n"), body, F.lit("\n```\n")).alias("markdown"))


@query("ana6_ingest_analysis_data", oracle("""
select i.repo, i.source as component, concat('About ', i.source) as summary, '' as architecture_pattern, 'spark,' || i.source as tech_stack,
  count(distinct i.target) as integrations, count(distinct e.target) as interactions, 0 as endpoints
from e_integrations i left join e_edges e on e.repo = i.repo and e.source = i.source group by i.repo, i.source""", "e_integrations", "e_edges"))
def ingest(spark, sf_dir):
    r = analyses.ingest_analysis_data(_written(spark))
    size = lambda c: F.size(f"result.{c}").cast("bigint")
    return r.select(
        "repo", "component", "result.summary", "result.architecture_pattern", F.array_join("result.tech_stack", ",").alias("tech_stack"),
        size("external_integrations").alias("integrations"), size("component_interactions").alias("interactions"), F.size("result.api_endpoints").alias("endpoints"),
    )


@query("ana7_runtime_edges", oracle("""
select repo, source, target, 'calls' as edge_type, 'http' as protocol from e_edges where exists (select 1 from e_integrations i where i.repo = e_edges.repo and i.source = e_edges.source)
union all select i.repo, i.source, s.name, 'integrates_with', null from e_integrations i join e_services s on s.id = i.target""", "e_edges", "e_integrations", "e_services"))
def runtime(spark, sf_dir):
    return analyses.runtime_edges(analyses.ingest_analysis_data(_written(spark))).select("repo", "source", "target", "edge_type", "protocol")


@query("ana7_found_services", oracle("""
select i.repo, s.name as id, s.category, count(distinct i.source) as users from e_integrations i join e_services s on s.id = i.target group by all""", "e_integrations", "e_services"))
def found(spark, sf_dir):
    return analyses.found_services(analyses.ingest_analysis_data(_written(spark)))


_EXTERNAL = """
select p_brand as repo, concat('c', cast(l_partkey as varchar(20))) as component, concat('s', cast(l_suppkey as varchar(20))) as name,
  concat('1.', cast(l_linenumber as varchar(9))) as version from lineitem join part on p_partkey = l_partkey"""


@query("ana8_technology_inventory", f"""
select name, count(distinct version) as versions, count(distinct concat(repo, ' ', component)) as users from ({_EXTERNAL}) x group by name""")
def technology(spark, sf_dir):
    return analyses.technology_inventory(spark.sql(_EXTERNAL))


@query("ana8_service_users", oracle("""
select s.id, s.name, s.category, count(distinct concat(i.repo, ' ', i.source)) as users, count(distinct i.repo) as repos
from e_services s left join e_integrations i on i.target = s.id group by all""", "e_services", "e_integrations"))
def service_users(spark, sf_dir):
    return analyses.service_users(view(spark, "e_integrations"), view(spark, "e_services"))


@query("ana9_analysis_coverage", oracle(f"""
select c.repo, count(*) as components, count(d.component) as analysed, count(*) - count(d.component) as missing
from e_components c left join ({_DONE}) d on d.repo = c.repo and d.component = c.name group by c.repo""", "e_components"))
def coverage(spark, sf_dir):
    return analyses.analysis_coverage(view(spark, "e_components"), spark.sql(_DONE))


# --- audit ----------------------------------------------------------------------

_LANGS = "select distinct p_brand as repo, case when p_brand < 'Brand#15' then 'go' else 'rust' end as language from part where p_brand <> 'Brand#3'"


def _answers(spark):
    """One free-text answer per order: fenced, bare with prose around, or broken."""
    item = F.struct(F.concat(F.lit("c"), "l_partkey").alias("component_name"), F.lower("l_returnflag").alias("proposed_kind"))
    per = spark.table("lineitem").join(spark.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_orderkey", "o_orderstatus").agg(
        F.array_sort(F.collect_list(item)).alias("classifications"))
    doc = F.to_json(F.struct("classifications"))
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Here:\n```json\n"), doc, F.lit("\n```\ndone"))) \
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("I think "), doc, F.lit(" is {right}"))).otherwise(F.concat(F.lit("{ oops "), doc))
    return per.select(F.col("l_orderkey").cast("string").alias("repo"), raw.alias("raw"))


@query("aud1_extract_json", """
select cast(o_orderkey as varchar) as repo, case when o_orderstatus in ('F', 'O') then 'ok' else 'parse_failed' end as status,
  case when o_orderstatus in ('F', 'O') then concat('c', l_partkey) end as component, case when o_orderstatus in ('F', 'O') then lower(l_returnflag) end as proposed
from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus in ('F', 'O')
union all select distinct cast(o_orderkey as varchar), 'parse_failed', null, null from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus not in ('F', 'O')""")
def parsed(spark, sf_dir):
    docs = audit.extract_json(_answers(spark))
    rows = audit.proposed_kinds(docs).select("repo", F.lit("ok").alias("status"), "component", "proposed")
    bad = docs.filter("status <> 'ok'").select("repo", "status", F.lit(None).cast("string").alias("component"), F.lit(None).cast("string").alias("proposed"))
    return rows.unionByName(bad)


_MISMATCH = "select k.repo, k.component, c.kind as deterministic, k.proposed from e_audit_kinds k join e_components c on c.repo = k.repo and c.name = k.component where c.kind <> k.proposed"
_DISCREPANT = """
select e.repo, e.source, e.target, e.evidence_type, case when e.evidence_type in ('http_call', 'shared_db', 'other') then 'dynamic_edge'
  when e.evidence_type in ('import', 'path_dep') then 'plugin_gap' else 'ambiguous' end as category
from e_audit_edges e left join e_edges d on d.repo = e.repo and d.source = e.source and d.target = e.target where d.source is null"""


def _mismatches(spark):
    return audit.kind_mismatches(view(spark, "e_components"), view(spark, "e_audit_kinds"))


def _discrepancies(spark):
    return audit.edge_discrepancies(view(spark, "e_components"), view(spark, "e_edges"), view(spark, "e_audit_edges"), view(spark, "e_missed"))


@query("aud2_kind_mismatches", oracle(_MISMATCH, "e_components", "e_audit_kinds"))
def mismatches(spark, sf_dir):
    return _mismatches(spark)


@query("aud3_edge_discrepancies", oracle(_DISCREPANT, "e_edges", "e_audit_edges"))
def discrepancies(spark, sf_dir):
    return _discrepancies(spark)


@query("aud4_missed_components", """
select distinct p_brand as repo, s_name as proposed_name, concat('x/', s_suppkey) as proposed_root_path
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where l_returnflag = 'R' and l_linestatus = 'O'""")
def missed(spark, sf_dir):
    rows = spark.sql("""select distinct p_brand as repo, s_name as proposed_name, concat('x/', s_suppkey) as proposed_root_path, p_partkey
        from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where l_returnflag = 'R' and l_linestatus = 'O'""")
    docs = rows.groupBy("repo", "p_partkey").agg(F.collect_list(F.struct("proposed_name", "proposed_root_path")).alias("missed_components"))
    answers = docs.select("repo", F.to_json(F.struct("missed_components")).alias("raw"))
    return audit.missed_components(audit.extract_json(answers)).select("repo", "proposed_name", "proposed_root_path").distinct()


@query("aud5_cost_ledger", oracle("""
select seq, model, cast(cost as bigint) as cost_e8, cast(total as bigint) as cumulative_e8 from (
  select seq, model, cost, sum(cost) over (order by seq rows unbounded preceding) as total from (
    select seq, model, cast(input_tokens as bigint) * case model when 'gpt-4o' then 250 when 'gpt-4o-mini' then 15 else 300 end
      + cast(output_tokens as bigint) * case model when 'gpt-4o' then 1000 when 'gpt-4o-mini' then 60 else 1500 end as cost
    from (select *, case when input_tokens < 200 then 'gpt-4o' when input_tokens < 500 then 'gpt-4o-mini' else 'other' end as model from e_usage) m) c) t
where total - cost < 100000000""", "e_usage"))
def ledger(spark, sf_dir):
    model = F.when(F.col("input_tokens") < 200, "gpt-4o").when(F.col("input_tokens") < 500, "gpt-4o-mini").otherwise("other")
    usage = view(spark, "e_usage").withColumn("model", model)
    out = audit.cost_ledger(usage, audit.price_table(spark), 1.0)
    exact = lambda c: (F.col(c) * 100_000_000).cast("bigint")
    return out.select("seq", "model", exact("cost_usd").alias("cost_e8"), exact("cumulative_usd").alias("cumulative_e8"))


@query("aud6_mismatch_report", oracle(f"""
select coalesce(l.language, 'unknown') as language, concat(deterministic, ' -> ', proposed) as change, count(*) as n
from ({_MISMATCH}) m left join ({_LANGS}) l on l.repo = m.repo group by all""", "e_components", "e_audit_kinds"))
def mismatch_report(spark, sf_dir):
    return audit.mismatch_report(_mismatches(spark), spark.sql(_LANGS))


@query("aud7_discrepancy_report", oracle(f"""
select coalesce(l.language, 'unknown') as language, concat('edge:', category) as metric, count(*) as n from ({_DISCREPANT}) m left join ({_LANGS}) l on l.repo = m.repo group by all
union all select coalesce(l.language, 'unknown'), 'missed_components', count(*) from e_missed m left join ({_LANGS}) l on l.repo = m.repo group by all""",
    "e_edges", "e_audit_edges", "e_missed"))
def discrepancy_report(spark, sf_dir):
    return audit.discrepancy_report(_discrepancies(spark), view(spark, "e_missed"), spark.sql(_LANGS))


_FOUND = f"""
select coalesce(l.language, 'unknown') as language, concat('kind:', deterministic, ' -> ', proposed) as bucket, m.repo, m.component as item from ({_MISMATCH}) m left join ({_LANGS}) l on l.repo = m.repo
union all select coalesce(l.language, 'unknown'), concat('edge:', category), m.repo, concat(source, ' -> ', target) from ({_DISCREPANT}) m left join ({_LANGS}) l on l.repo = m.repo"""


@query("aud8_exemplars", oracle(f"select * from (select *, row_number() over (partition by language, bucket order by repo, item) as pos from ({_FOUND}) f) x",
    "e_components", "e_audit_kinds", "e_edges", "e_audit_edges"))
def exemplars(spark, sf_dir):
    return audit.exemplars(audit.findings(_mismatches(spark), _discrepancies(spark), spark.sql(_LANGS)))


@query("aud9_audit_totals", oracle(f"""
select coalesce(l.language, 'unknown') as language, count(distinct c.repo) as repos_audited, coalesce(any_value(g.n), 0) as plugin_gaps
from (select distinct repo from e_components) c left join ({_LANGS}) l on l.repo = c.repo
left join (select coalesce(l.language, 'unknown') as language, count(*) as n from ({_DISCREPANT}) m left join ({_LANGS}) l on l.repo = m.repo where category = 'plugin_gap' group by all) g
  on g.language = coalesce(l.language, 'unknown') group by 1""", "e_components", "e_edges", "e_audit_edges"))
def totals(spark, sf_dir):
    return audit.audit_totals(view(spark, "e_components").select("repo"), _discrepancies(spark), spark.sql(_LANGS))


# --- artifacts and traces ---------------------------------------------------------

_INVENTORY = """
select service, path, cast(octet_length(encode(content)) as bigint) as size_bytes, sha256(content) as sha256, case split_part(path, '/', 1)
  when 'service_discovery' then 'discovery' when 'dependency_graphs' then 'graph' when 'service_analyses' then 'analysis' else 'architecture' end as category
from e_artifacts where path not like '%.txt'"""


@query("art1_artifact_inventory", oracle(_INVENTORY, "e_artifacts"))
def art_inventory(spark, sf_dir):
    return artifacts.artifact_inventory(view(spark, "e_artifacts"))


@query("art2_next_manifest", """
with r as (select o_custkey as service, o_orderkey as version, concat('repo-', o_custkey) as source_repo, o_orderstatus as source_commit, o_orderpriority as model from orders),
p as (select service, max(version) as version, arg_max(source_repo, version) as source_repo, arg_max(source_commit, version) as source_commit, arg_max(model, version) as model from r group by service)
select c_custkey as service, coalesce(p.version, 0) + 1 as version, coalesce(p.source_repo, c_name) as source_repo,
  case when c_acctbal < 0 then coalesce(p.source_commit, '') else 'head' end as source_commit, case when c_nationkey = 1 then coalesce(p.model, '') else c_mktsegment end as model
from customer left join p on p.service = c_custkey""")
def next_manifest(spark, sf_dir):
    runs = spark.table("orders").selectExpr("o_custkey as service", "o_orderkey as version", "concat('repo-', o_custkey) as source_repo", "o_orderstatus as source_commit", "o_orderpriority as model")
    new = spark.table("customer").selectExpr(
        "c_custkey as service", "c_name as source_repo", "case when c_acctbal < 0 then '' else 'head' end as source_commit",
        "case when c_nationkey = 1 then '' else c_mktsegment end as model")
    return artifacts.next_manifest(runs, new).drop("generated_at")


@query("art3_compare_inventory", oracle("""
select coalesce(a.repo, b.repo) as service, coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed'
  when a.content = b.content then 'same' else 'changed' end as change
from e_docs a full join e_docs_next b on a.repo = b.repo and a.path = b.path""", "e_docs", "e_docs_next"))
def art_compare(spark, sf_dir):
    inv = lambda name: artifacts.artifact_inventory(view(spark, name).withColumnRenamed("repo", "service"))
    return artifacts.compare_inventory(inv("e_docs"), inv("e_docs_next"))


_PHASES = "select user_id as session_id, 'visit' as action, ts, event_id as sequence_id, case when event_type in ('click', 'view', 'signup') then 'start' else 'end' end as phase from events"


@query("obs1_pair_traces", f"""
select session_id, action, prev_id as sequence_id, epoch_us(prev_ts) as start_us, epoch_us(ts) as end_us, (epoch_us(ts) - epoch_us(prev_ts)) / 1000.0 as duration_ms from (
  select *, lag(phase) over w as prev_phase, lag(ts) over w as prev_ts, lag(sequence_id) over w as prev_id from ({_PHASES}) p
  window w as (partition by session_id, action order by ts, sequence_id)) x where phase = 'end' and prev_phase = 'start'""")
def pairs(spark, sf_dir):
    out = observability.pair_traces(spark.sql(_PHASES))
    return out.select("session_id", "action", "sequence_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "duration_ms")


def _trace_rows(spark):
    return spark.sql("""
        select event_type as action, ts as timestamp, event_id as sequence_id, case when event_type = 'view' then null else value end as duration_ms,
          array(event_type, cast(user_id as string)) as tags, concat(event_type, '.py') as source_file, cast(user_id as int) as source_line,
          case when event_type = 'signup' then null else named_struct('input', user_id, 'output', event_id) end as token_usage,
          case when event_type = 'error' then props end as error from events""")


@query("obs2_trace_totals", """
select count(*) as total_actions, round(sum(case when event_type = 'view' then 0 else value end), 2) as total_duration_ms,
  cast(sum(case when event_type <> 'signup' then user_id end) as bigint) as total_input_tokens, cast(sum(case when event_type <> 'signup' then event_id end) as bigint) as total_output_tokens from events""")
def trace_totals(spark, sf_dir):
    return observability.trace_summary(_trace_rows(spark))[0].withColumn("total_duration_ms", F.round("total_duration_ms", 2))


@query("obs2_trace_actions", """
select event_type as action, count(*) as count, round(case when event_type = 'view' then 0 else sum(value) end, 2) as total_duration_ms,
  concat(event_type, ',', arg_min(user_id, (ts, event_id))) as tags, concat(event_type, '.py:', arg_min(user_id, (ts, event_id))) as source from events group by event_type""")
def trace_actions(spark, sf_dir):
    out = observability.trace_summary(_trace_rows(spark))[1]
    return out.withColumn("total_duration_ms", F.round("total_duration_ms", 2)).withColumn("tags", F.array_join("tags", ","))


@query("obs2_trace_errors", "select event_type as action, event_id as sequence_id, props as error from events where event_type = 'error'")
def trace_errors(spark, sf_dir):
    return observability.trace_summary(_trace_rows(spark))[2].drop("timestamp")


_TOKENS = "select conv_id, turn, case when role <> 'assistant' then length(text) else 0 end as input_tokens, case when role = 'assistant' then length(text) else 0 end as output_tokens from conversations"


@query("obs3_token_ledger", f"""
select *, cast(sum(input_tokens) over w as bigint) as input_so_far, cast(sum(output_tokens) over w as bigint) as output_so_far from ({_TOKENS}) t
window w as (partition by conv_id order by turn rows unbounded preceding)""")
def tokens(spark, sf_dir):
    return observability.token_ledger(spark.sql(_TOKENS))


@query("obs4_shown_beside_whole", """
select doc_id, text, lines, facts, case when length(text) > 500 then concat(left(text, 500), '...(truncated)') else text end as text_shown,
  case when len(lines) > 10 then concat('[', len(lines), ' items]') else cast(to_json(lines) as varchar) end as lines_shown,
  case when length(facts) > 500 then '{...3 keys}' else facts end as facts_shown
from (select doc_id, text, string_split(text, chr(10)) as lines,
  cast(to_json(map {'lang': lang, 'source': source, 'text': text}) as varchar) as facts from documents) d""")
def shown(spark, sf_dir):
    rows = spark.table("documents").select(
        "doc_id", "text", F.split("text", "\n").alias("lines"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("text"), "text").alias("facts"))
    return observability.truncate_values(rows, whole="_shown").withColumn("facts", F.to_json("facts"))


@query("obs4_truncate_values", """
select doc_id, case when length(text) > 500 then concat(left(text, 500), '...(truncated)') else text end as text,
  case when words > 10 then concat('[', words, ' items]') else '[short]' end as words from (select *, len(string_split(text, ' ')) as words from documents) d""")
def truncated(spark, sf_dir):
    rows = spark.table("documents").select("doc_id", "text", F.split("text", " ").alias("words"))
    return observability.truncate_values(rows).withColumn("words", F.when(F.rlike("words", F.lit(r"^\[\d+ items\]$")), F.col("words")).otherwise("[short]"))
