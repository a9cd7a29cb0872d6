"""Queries over component discovery on rendered repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.operators import graph as kg
from repoloom.operators.discovery import common, discover, discover_corpus, go, python, register, rust, solidity, swift, typescript, unregister
from repoloom.plans import rendered
from repoloom.plans.bindings import oracle
from repoloom.plans.registry import query
from repoloom.sources import sinks


def shown(inventory):
    return inventory.components.select("repo", "name", "kind", "type", "root_path", "manifest_path", "description")


def required(inventory):
    """External dependencies with the name of their component."""
    owner = inventory.components.select("repo", "ckey", F.col("name").alias("component"))
    return inventory.external.join(owner, ["repo", "ckey"]).select("repo", "component", "name", "version", "category")


def linked(inventory):
    owner = inventory.components.select("repo", "ckey", F.col("name").alias("component"))
    return inventory.internal.join(owner, ["repo", "ckey"]).select("repo", "component", "dep")


EDGES = oracle("select repo, source as component, target as dep from e_edges", "e_edges")
C, I = "e_components", "e_integrations"


def comps(name="name", kind="kind", type_="type", root="root_path", manifest="concat(root_path, '/x')", description="''", where="true"):
    return (f"select repo, {name} as name, {kind} as kind, {type_} as type, {root} as root_path, {manifest} as manifest_path, "
            f"{description} as description from e_components where {where}")


def exts(version, name="target", category="''", where="true"):
    return f"select repo, source as component, {name} as name, {version} as version, {category} as category from e_integrations where {where}"


# --- npm ------------------------------------------------------------------------


@query("ts_components", oracle(comps(
    kind="case kind when 'pipeline' then 'service' when 'contract' then 'service' else kind end",
    type_="case when type in ('typescript-package', 'python-package') then 'typescript-package' else 'javascript-package' end",
    manifest="concat(root_path, '/package.json')", description="concat('Package ', name)"), C))
def ts_components(spark, sf_dir):
    return shown(typescript.discover(rendered.npm(spark)))


@query("ts_external_deps", oracle(
    exts("concat('^1.0.', substr(target, 2))") + " union all select repo, name, case kind when 'service' then 'express' else 'react' end, "
    "case kind when 'service' then '^4.0.0' else '^18.0.0' end, '' from e_components where kind in ('service', 'frontend')", C, I))
def ts_external(spark, sf_dir):
    return required(typescript.discover(rendered.npm(spark)))


@query("ts_internal_deps", EDGES)
def ts_internal(spark, sf_dir):
    return linked(typescript.discover(rendered.npm(spark)))


@query("ts_workspace_members", oracle(
    "select repo, 'package.json' as workspace, case kind when 'service' then 0 when 'cli' then 1 else 2 end as pos, concat(root_path, '/package.json') as manifest_path "
    "from e_components where kind in ('service', 'cli', 'library')", C))
def ts_members(spark, sf_dir):
    return typescript.members(rendered.npm(spark))


# --- go -------------------------------------------------------------------------


@query("go_components", oracle(
    comps(kind="case kind when 'service' then 'service' when 'cli' then 'cli' when 'pipeline' then 'cli' else 'library' end", type_="'go-module'",
          manifest="concat(root_path, '/go.mod')")
    + " union all " + comps(name="'run'", kind="'service'", type_="'go-module'", root="concat(root_path, '/cmd/run')", manifest="concat(root_path, '/go.mod')", where="kind = 'frontend'"), C))
def go_components(spark, sf_dir):
    return shown(go.discover(rendered.go_modules(spark)))


@query("go_external_deps", oracle(exts("concat('v1.0.', substr(target, 2))", "concat('vendor.dev/', target)"), I))
def go_external(spark, sf_dir):
    return required(go.discover(rendered.go_modules(spark)))


@query("go_internal_deps", oracle("select repo, 'run' as component, name as dep from e_components where kind = 'frontend'", C))
def go_internal(spark, sf_dir):
    return linked(go.discover(rendered.go_modules(spark)))


_MONO = dict(type_="'go-module'", manifest="'go.mod'")


@query("go_monorepo_components", oracle(
    comps(kind="'library'", root="name", **_MONO) + " union all "
    + comps(name="concat(name, '-apiserver')", kind="'service'", root="concat(name, '/cmd/apiserver')", where="kind = 'service'", **_MONO)
    + " union all select distinct repo, 'sometool', 'cli', 'go-module', 'cmd/sometool', 'go.mod', '' from e_components", C))
def go_mono_components(spark, sf_dir):
    return shown(go.discover(rendered.go_mono(spark)))


@query("go_monorepo_edges", oracle(
    "select repo, source as component, target as dep from e_edges union all select repo, concat(name, '-apiserver'), name from e_components where kind = 'service'", "e_edges", C))
def go_mono_edges(spark, sf_dir):
    return linked(go.discover(rendered.go_mono(spark)))


# --- python ----------------------------------------------------------------------


@query("py_projects", oracle(comps(
    kind="case kind when 'contract' then 'cli' else kind end", type_="'python-package'", manifest="concat(root_path, '/pyproject.toml')"), C))
def py_projects(spark, sf_dir):
    return shown(python.discover(rendered.python_projects(spark)))


@query("py_external_deps", oracle(
    "select i.repo, i.source as component, i.target as name, case c.type when 'python-package' then '^1.0' else '>=1.0' end as version, '' as category "
    "from e_integrations i join e_components c on c.repo = i.repo and c.name = i.source", C, I))
def py_external(spark, sf_dir):
    return required(python.discover(rendered.python_projects(spark)))


@query("py_path_deps", EDGES)
def py_paths(spark, sf_dir):
    return linked(python.discover(rendered.python_projects(spark)))


@query("py_subpackages", oracle(
    comps(kind="case kind when 'contract' then 'library' else kind end", type_="'python-package'", root="concat('src/my_proj/', name)", manifest="'pyproject.toml'")
    + " union all select distinct repo, 'my-proj', 'service', 'python-package', '.', 'pyproject.toml', 'All of it' from e_components", C))
def py_sub(spark, sf_dir):
    return shown(python.discover(rendered.python_mono(spark)))


@query("py_subpackage_edges", oracle(
    "select repo, source as component, target as dep from e_edges union all select repo, 'my-proj', name from e_components", C, "e_edges"))
def py_sub_edges(spark, sf_dir):
    return linked(python.discover(rendered.python_mono(spark)))


# --- rust -----------------------------------------------------------------------


@query("rs_components", oracle(comps(
    kind="case kind when 'service' then 'service' when 'cli' then 'cli' when 'frontend' then 'cli' else 'library' end", type_="'rust-crate'",
    manifest="concat(root_path, '/Cargo.toml')", description="'crate'"), C))
def rs_components(spark, sf_dir):
    return shown(rust.discover(rendered.cargo(spark)))


@query("rs_external_deps", oracle(
    exts("case when ends_with(target, '3') then '1.3' else '1.0' end") + " union all select repo, name, 'axum', '0.7', '' from e_components where kind = 'service' "
    "union all select repo, name, 'nix', '0.2', '' from e_components", C, I))
def rs_external(spark, sf_dir):
    return required(rust.discover(rendered.cargo(spark)))


@query("rs_internal_deps", EDGES)
def rs_internal(spark, sf_dir):
    return linked(rust.discover(rendered.cargo(spark)))


@query("rs_workspace_members", oracle(
    "select repo, 'Cargo.toml' as workspace, case kind when 'service' then 0 when 'library' then 1 else 2 end as pos, concat(root_path, '/Cargo.toml') as manifest_path "
    "from e_components where kind = 'service' or (kind = 'library' and length(name) = 2) or (kind = 'cli' and starts_with(name, 'c1'))", C))
def rs_members(spark, sf_dir):
    return rust.members(rendered.cargo(spark))


# --- solidity ---------------------------------------------------------------------


@query("sol_components", oracle(
    comps(kind="case kind when 'library' then 'library' else 'contract' end", type_="'solidity-contract'", root="concat('src/', name)", manifest="'foundry.toml'")
    + " union all select distinct repo, concat(repo, '-contracts'), 'contract', 'solidity-contract', '.', 'foundry.toml', 'Foundry project (Solidity ^0.8.20)' from e_components"
    + " union all select distinct concat('hh-', repo), concat('hh-', repo, '-contracts'), 'contract', 'solidity-contract', '.', 'hardhat.config.ts', 'Hardhat project' from e_components", C))
def sol_components(spark, sf_dir):
    return shown(solidity.discover(rendered.foundry(spark)))


@query("sol_external_deps", oracle(
    "select distinct repo, concat(repo, '-contracts') as component, target as name, '' as version, 'solidity-library' as category from e_integrations"
    " union all select distinct concat('hh-', repo), concat('hh-', repo, '-contracts'), n, v, 'solidity-tooling' from e_components,"
    " (select '@openzeppelin/contracts' as n, '^5' as v union all select 'ethers', '6') t", C, I))
def sol_external(spark, sf_dir):
    return required(solidity.discover(rendered.foundry(spark)))


@query("sol_internal_deps", oracle(
    "select repo, source as component, target as dep from e_edges union all select repo, concat(repo, '-contracts'), name from e_components", C, "e_edges"))
def sol_internal(spark, sf_dir):
    return linked(solidity.discover(rendered.foundry(spark)))


@query("sol_metadata", oracle(
    "select repo, name as component, 'declarations.library' as key, '2' as value from e_components where kind = 'library'"
    " union all select repo, name, 'declarations.interface', '1' from e_components where kind = 'service'"
    " union all select repo, name, k, '1' from e_components, (select 'declarations.contract' as k union all select 'declarations.abstract contract') t where kind not in ('library', 'service')"
    " union all select distinct repo, concat(repo, '-contracts'), 'solidity_version', '^0.8.20' from e_components"
    " union all select distinct concat('hh-', repo), concat('hh-', repo, '-contracts'), k, v from e_components, (select 'framework' as k, 'hardhat' as v"
    " union all select 'declarations.contract', '1' union all select 'declarations.interface', '1') t", C))
def sol_metadata(spark, sf_dir):
    inv = solidity.discover(rendered.foundry(spark))
    owner = inv.components.select("repo", "ckey", F.col("name").alias("component"))
    return inv.metadata.join(owner, ["repo", "ckey"]).select("repo", "component", "key", "value")


# --- swift ------------------------------------------------------------------------

_SW = dict(type_="'swift-package'", manifest="concat(root_path, '/Package.swift')")


@query("sw_components", oracle(
    comps(kind="case kind when 'service' then 'service' when 'cli' then 'cli' when 'contract' then 'frontend' else 'library' end",
          root="case when kind in ('service', 'contract', 'library') then concat(root_path, '/Sources/', name) when kind = 'frontend' then concat(root_path, '/App/Main') else root_path end",
          where="kind <> 'pipeline'", **_SW)
    + " union all " + comps(name="concat('Pkg', name)", kind="case kind when 'pipeline' then 'cli' else 'library' end",
                            description="case kind when 'pipeline' then '' else 'Swift package root' end", where="kind <> 'library'", **_SW)
    + " union all " + comps(name="concat(name, 'Kit')", kind="'library'", root="concat(root_path, '/Lib/Kit')", where="kind not in ('library', 'pipeline')", **_SW), C))
def sw_components(spark, sf_dir):
    return shown(swift.discover(rendered.swift_packages(spark)))


@query("sw_external_deps", oracle(
    "select i.repo, case when c.kind = 'library' then c.name else concat('Pkg', c.name) end as component, i.target as name, "
    "case when ends_with(i.target, '3') then '2.0.0' else '>=1.2.0' end as version, '' as category from e_integrations i join e_components c on c.repo = i.repo and c.name = i.source", C, I))
def sw_external(spark, sf_dir):
    return required(swift.discover(rendered.swift_packages(spark)))


@query("sw_internal_deps", oracle(
    "select repo, concat(name, 'Kit') as component, name as dep from e_components where kind not in ('library', 'pipeline')"
    " union all select repo, concat('Pkg', name), unnest([name, concat(name, 'Kit')]) from e_components where kind not in ('library', 'pipeline')", C))
def sw_internal(spark, sf_dir):
    return linked(swift.discover(rendered.swift_packages(spark)))


# --- all ecosystems -----------------------------------------------------------------


@rendered.written
def mixed(spark):
    """Each ecosystem in repositories of its own, and two sharing root paths."""
    tag = lambda df, t: df.withColumn("repo", F.concat(F.lit(t + "/"), "repo"))
    both = rendered.npm(spark).filter("path not like 'node_modules%'").union(rendered.go_modules(spark))
    return rendered._all([
        tag(rendered.python_mono(spark), "py"), tag(rendered.cargo(spark), "rs"), tag(rendered.foundry(spark), "sol"), tag(both, "both"),
    ])


@rendered.written
def swift_part(spark):
    return rendered.swift_packages(spark).withColumn("repo", F.concat(F.lit("sw/"), "repo"))


_COUNTS = """
n as (select repo, count(*) as n, count(case when kind = 'frontend' then 1 end) as f from e_components group by repo),
e as (select repo, count(*) as n from e_edges group by repo), r as (select n.*, coalesce(e.n, 0) as e from n left join e on e.repo = n.repo),
g as (select repo, count(*) as n, count(case when kind in ('service', 'contract', 'frontend') then 1 end) as e,
  count(case when kind not in ('library', 'pipeline') then 1 end) as k from e_components group by repo),
-- one component per root path: e kinds have their main target elsewhere than the package, k kinds a kit in a folder of its own;
-- a kit needs the main target, and a package that is there both
sw as (select repo, n + e + k as n, k + 2 * e as e from g)"""


@query("aud10_discover_corpus", oracle(
    f"with {_COUNTS} select concat('py/', repo) as repo, 'ok' as status, n + 1 as component_count, n + e as edge_count, cast(null as varchar) as error from r"
    " union all select concat('rs/', repo), 'ok', n, e, null from r union all select concat('sol/', repo), 'ok', n + 1, n + e, null from r"
    " union all select concat('sol/hh-', repo), 'ok', 1, 0, null from r"
    # each binary of a repository is named "run", and its edges leave that one name
    " union all select concat('both/', repo), 'ok', n + f, f, 'broken/package.json: must be a JSON object, got list' from r"
    " union all select concat('sw/', repo), 'ok', n, e, null from sw"
    " union all select s_name, case when s_suppkey % 2 = 0 then 'clone_failed' else 'discovery_failed' end, 0, 0,"
    " case when s_suppkey % 2 = 1 then 'package.json: Invalid JSON' end from supplier", C, "e_edges"))
def corpus(spark, sf_dir):
    single = spark.sql("select s_name as repo, 'package.json' as path, '{' as content from supplier where s_suppkey % 2 = 1")
    files = mixed(spark).unionByName(swift_part(spark)).unionByName(single)
    broken = files.filter("repo like 'both/%'").select("repo").distinct().selectExpr("repo", "'broken/package.json' as path", "'[]' as content")
    files = files.unionByName(broken)
    repos = files.select("repo").union(spark.sql("select s_name from supplier"))
    inv, outcome = discover_corpus(repos, files)
    g = kg.build_graph(inv.components, inv.internal)
    flat = inv.components.select("repo", "name", F.lit(0).alias("depth"))
    return sinks.discovery_summary(repos, inv.components, g.edges, flat, outcome=outcome).drop("depth_levels")


# --- an ecosystem of the user ---------------------------------------------------------


def _make(files, mode):
    """Components named by Makefiles, one per file; ``include`` lines name others."""
    found = common.manifests(files, "Makefile", mode)
    name = F.regexp_extract("content", r"(?m)^NAME = (.*)$", 1)
    rows = common.component_rows(found, "Makefile", name=name, kind=F.lit("library"), type=F.lit("make"), root=F.col("dir"))
    wanted = F.regexp_extract_all("content", F.lit(r"(?m)^include (.*)$"), F.lit(1))
    deps = found.select("repo", "manifest_path", F.posexplode(wanted).alias("pos", "dep")).join(rows.select("repo", "manifest_path", "ckey"), ["repo", "manifest_path"])
    return common.Inventory(rows, common.internal_rows(deps, F.col("dep"), F.col("pos")), common.no_external(rows))


@query("udx1_own_ecosystem", oracle(
    "select c.repo, c.name, 'make' as type, c.root_path, e.target as dep from e_components c left join e_edges e on e.repo = c.repo and e.source = c.name", C, "e_edges"))
def own_ecosystem(spark, sf_dir):
    text = F.concat(F.lit("NAME = "), "name", F.lit("\n"), F.array_join(F.transform("deps", lambda d: F.concat(F.lit("include "), d)), "\n"))
    made = rendered.components(spark)
    files = made.select("repo", F.concat("root_path", F.lit("/Makefile")).alias("path"), text.alias("content"))
    files = files.unionByName(files.select("repo", F.concat(F.lit("old/"), "path").alias("path"), F.lit("NAME = left out").alias("content")))
    register("make", _make, ["Makefile"], ["old/**"])
    try:
        inv = discover(files, ["make"])
        out = inv.components.select("repo", "name", "type", "root_path").join(
            inv.internal.select("repo", F.col("component").alias("name"), "dep"), ["repo", "name"], "left")
        out.schema  # the plan holds the rules now
    finally:
        unregister("make")
    return out
