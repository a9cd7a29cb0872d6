"""Solidity projects (Foundry and Hardhat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.paths import join_path, segments
from repoloom.functions.text import all_groups, first_group, NEWLINE, strip, strip_chars
from repoloom.operators.discovery.common import Inventory, ckey, component_rows, external_rows, folder_name, internal_rows, manifests, merge, source_facts, union
from repoloom.runtime import stage
from repoloom.sources.files import exclude_vendored

FOUNDRY = "foundry.toml"
HARDHAT = ["hardhat.config.ts", "hardhat.config.js"]
# Formats of declarations, imports and versions.
DECLARATION = r"(?m)^(abstract\s+contract|contract|interface|library)\s+[A-Za-z_][A-Za-z0-9_]*"
IMPORT = r"import\s+(?:\{[^}]*\}\s+from\s+)?[\"']([^\"']+)[\"']"
PRAGMA = r"pragma\s+solidity\s+([^;]+);"
REMAPPINGS = r"(?s)remappings\s*=\s*\[(.*?)\]"
# Dependencies kept for Hardhat projects.
HARDHAT_DEPS = ["openzeppelin", "hardhat", "solidity", "ethers", "chai", "waffle"]


def setting(content: Column, name: str, default: str) -> Column:
    """A text setting, or the first text of an array."""
    plain = first_group(content, rf"(?m)^\s*{name}\s*=\s*[\"']([^\"']+)[\"']")
    array = first_group(content, rf"(?m)^\s*{name}\s*=\s*\[\s*[\"']([^\"']+)[\"']")
    return F.regexp_replace(F.regexp_replace(F.coalesce(plain, array, F.lit(default)), r"^(?:\./)+", ""), "/+$", "")


def remappings(content: Column) -> Column:
    """ARRAY of (prefix, target) in the order of the file."""
    block = F.split(F.regexp_extract(content, REMAPPINGS, 1), NEWLINE)
    lines = F.filter(F.transform(block, lambda l: strip_chars(strip(l), ",\"'")), lambda l: F.contains(l, F.lit("=")))
    return F.transform(lines, lambda l: F.struct(
        strip(F.substring_index(l, "=", 1)).alias("prefix"), strip(F.regexp_replace(l, "^[^=]*=", "")).alias("target")
    ))


def remapped(path: Column, table: Column) -> Column:
    hit = F.get(F.filter(table, lambda r: F.startswith(path, r["prefix"])), F.lit(0))
    return F.when(hit.isNotNull(), F.concat(hit["target"], F.substr(path, F.length(hit["prefix"]) + 1))).otherwise(path)


def fact_columns(text: Column) -> dict[str, Column]:
    """What the job needs from each ``.sol`` file."""
    declared = F.transform(all_groups(text, DECLARATION), lambda d: F.regexp_replace(d, r"\s+", " "))
    return {"declared": declared, "imports": F.array_distinct(all_groups(text, IMPORT)), "pragma": strip(first_group(text, PRAGMA))}


def facts(files: DataFrame) -> DataFrame:
    """(repo, path, declared, imports, pragma) per ``.sol`` file."""
    return source_facts(files, "solidity", fact_columns).drop("dir")


def _below(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows (repo, path, …) joined to projects by their source folder ``src``;
    adds ``pkg``, the first folder below it (null for files directly in it)."""
    parts = segments(F.col("path"))
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    joined = rows.filter(F.contains("path", F.lit("/"))).withColumn("src", F.explode(heads)).join(projects, ["repo", "src"])
    rest = F.substr(F.col("path"), F.length("src") + 2)
    return joined.withColumn("pkg", F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)))


def _packages(below: DataFrame) -> DataFrame:
    """Distinct (repo, manifest_path, …project columns, pkg) with Solidity files."""
    return below.filter("pkg is not null and not startswith(pkg, '.')").select("repo", "manifest_path", "pkg").distinct()


def _kind(per: Column) -> Column:
    return F.when(per, "library").otherwise("contract")


def _declared(below: DataFrame) -> DataFrame:
    """(repo, manifest_path, pkg, declaration, n): declarations by kind."""
    return below.select("repo", "manifest_path", "pkg", F.explode("declared").alias("declaration")).groupBy(
        "repo", "manifest_path", "pkg", "declaration"
    ).agg(F.count("*").alias("n"))


def _declared_metadata(counts: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    key = F.concat(F.lit("declarations."), "declaration")
    return counts.join(keyed, on).groupBy("repo", "ckey", key.alias("key")).agg(F.sum("n").cast("string").alias("value"))


def versions(below: DataFrame) -> DataFrame:
    """(repo, manifest_path, version) from the first file, by path, with a pragma."""
    found = below.filter("pragma is not null")
    return found.groupBy("repo", "manifest_path").agg(F.min_by("pragma", segments(F.col("path"))).alias("version"))


def vendored_libraries(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(repo, manifest_path, name): child folders of each project's library folder."""
    libs = projects.select("repo", "manifest_path", F.col("lib").alias("src"))
    paths = files.select("repo", "path")
    return _below(paths, libs).filter("pkg is not null and not startswith(pkg, '.')").select("repo", "manifest_path", F.col("pkg").alias("name")).distinct()


def _library_flags(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.bool_and(F.col("declaration") == "library").alias("only_libraries"))


def _foundry(files: DataFrame, sol: DataFrame, mode: str) -> Inventory:
    found = exclude_vendored(files.select("repo", "path"), manifests(files, FOUNDRY, mode).withColumnRenamed("manifest_path", "path")).withColumnRenamed("path", "manifest_path")
    text = F.col("content")
    projects = found.select(
        "repo", "manifest_path", "dir", join_path(F.col("dir"), setting(text, "src", "src")).alias("src"),
        join_path(F.col("dir"), setting(text, "libs", "lib")).alias("lib"), remappings(text).alias("remap"),
    )
    holders = _below(files.select("repo", "path"), projects.select("repo", "src", "manifest_path")).select("repo", "manifest_path").distinct()
    projects, _ = stage(projects.join(holders, ["repo", "manifest_path"], "left_semi"), "foundry")
    below, _ = stage(_below(sol, projects.select("repo", "src", "manifest_path")), "foundry-sources")
    pkgs = _packages(below)
    split = pkgs.select("repo", "manifest_path").distinct()
    counts = _declared(below)
    version = versions(below)
    known = F.coalesce("version", F.lit("unknown"))
    lib = F.lit("solidity-contract")

    per_pkg = pkgs.join(_library_flags(counts, ["repo", "manifest_path", "pkg"]), ["repo", "manifest_path", "pkg"], "left").join(
        projects.select("repo", "manifest_path", "src"), ["repo", "manifest_path"]
    )
    pkg_rows = component_rows(
        per_pkg, FOUNDRY, name=F.col("pkg"), kind=_kind(F.coalesce("only_libraries", F.lit(False))), type=lib,
        root=F.concat_ws("/", "src", "pkg"), rank=1, label=F.col("pkg"),
    )
    whole = projects.join(version, ["repo", "manifest_path"], "left")
    name = F.concat(folder_name(F.col("dir")), F.lit("-contracts"))
    parted = whole.join(split, ["repo", "manifest_path"], "left_semi")
    root_rows = component_rows(
        parted, FOUNDRY, name=name, kind=F.lit("contract"), type=lib, root=F.col("dir"), rank=2,
        description=F.concat(F.lit("Foundry project (Solidity "), known, F.lit(")")),
    )
    flat = whole.join(split, ["repo", "manifest_path"], "left_anti").join(_library_flags(counts, ["repo", "manifest_path"]), ["repo", "manifest_path"], "left")
    flat_rows = component_rows(
        flat, FOUNDRY, name=name, kind=_kind(F.coalesce("only_libraries", F.lit(False))), type=lib, root=F.col("dir"), rank=2
    )

    # imports of each package, remapped, to sibling packages
    used = below.filter("pkg is not null").select("repo", "manifest_path", "pkg", F.explode("imports").alias("i"))
    path = remapped(F.col("i"), F.col("remap"))
    arcs = used.distinct().join(projects.select("repo", "manifest_path", "remap"), ["repo", "manifest_path"]).select("repo", "manifest_path", "pkg", path.alias("i"))
    inner = arcs.filter(~F.rlike("i", F.lit(r"^(?:lib/|node_modules/|\./|\.\./)")))
    dep = F.substring_index(F.regexp_replace("i", "^src/", ""), "/", 1)
    edges = inner.select("repo", "manifest_path", "pkg", dep.alias("dep")).filter("dep <> pkg").distinct().join(
        pkgs.withColumnRenamed("pkg", "dep"), ["repo", "manifest_path", "dep"], "left_semi"
    )
    edges = edges.select("repo", ckey(FOUNDRY, 1, F.col("pkg")).alias("ckey"), "dep")
    root_deps = pkgs.select("repo", ckey(FOUNDRY, 2, F.lit("")).alias("ckey"), F.col("pkg").alias("dep"))
    vendored = vendored_libraries(files, projects).withColumn("ckey", ckey(FOUNDRY, 2, F.lit("")))

    root_key = whole.select("repo", "manifest_path", ckey(FOUNDRY, 2, F.lit("")).alias("ckey"), known.alias("value"))
    pkg_key = pkgs.select("repo", "manifest_path", "pkg", ckey(FOUNDRY, 1, F.col("pkg")).alias("ckey"))
    metadata = union([
        root_key.select("repo", "ckey", F.lit("solidity_version").alias("key"), "value"),
        _declared_metadata(counts, pkg_key, ["repo", "manifest_path", "pkg"]),
        _declared_metadata(counts.join(split, ["repo", "manifest_path"], "left_anti"), root_key.select("repo", "manifest_path", "ckey"), ["repo", "manifest_path"]),
    ])
    return Inventory(
        union([pkg_rows, root_rows, flat_rows]), internal_rows(edges.unionByName(root_deps), F.col("dep")),
        external_rows(vendored, F.col("name"), F.lit(""), category="solidity-library"), metadata,
    )


def _hardhat(files: DataFrame, sol: DataFrame, filename: str, mode: str) -> Inventory:
    found = exclude_vendored(files.select("repo", "path"), manifests(files, filename, mode).withColumnRenamed("manifest_path", "path")).withColumnRenamed("path", "manifest_path")
    projects = found.select("repo", "manifest_path", "dir")
    places = F.transform(F.array(F.lit("contracts"), F.lit("src")), lambda p: join_path(F.col("dir"), p))
    options = projects.select("repo", "manifest_path", F.posexplode(places).alias("rank", "src"))
    held = _below(files.select("repo", "path"), options).groupBy("repo", "manifest_path").agg(F.min_by("src", "rank").alias("src"))
    projects, _ = stage(projects.join(held, ["repo", "manifest_path"]), "hardhat")
    below, _ = stage(_below(sol, projects.select("repo", "src", "manifest_path")), "hardhat-sources")
    pkgs = _packages(below)
    counts = _declared(below)
    lib = F.lit("solidity-contract")
    per_pkg = pkgs.join(_library_flags(counts, ["repo", "manifest_path", "pkg"]), ["repo", "manifest_path", "pkg"], "left").join(
        projects.select("repo", "manifest_path", "src"), ["repo", "manifest_path"]
    )
    pkg_rows = component_rows(
        per_pkg, filename, name=F.col("pkg"), kind=_kind(F.coalesce("only_libraries", F.lit(False))), type=lib,
        root=F.concat_ws("/", "src", "pkg"), rank=1, label=F.col("pkg"),
    )
    split = pkgs.select("repo", "manifest_path").distinct()
    any_sol = below.select("repo", "manifest_path").distinct()
    flat = projects.join(split, ["repo", "manifest_path"], "left_anti").join(any_sol, ["repo", "manifest_path"], "left_semi")
    flat_rows = component_rows(
        flat, filename, name=F.concat(folder_name(F.col("dir")), F.lit("-contracts")), kind=F.lit("contract"), type=lib, root=F.col("dir"),
        rank=2, description=F.lit("Hardhat project"),
    )
    npm = files.filter((F.col("path") == "package.json") | F.endswith("path", F.lit("/package.json"))).select(
        "repo", F.regexp_replace("path", "/?package\\.json$", "").alias("dir"),
        F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>").alias("deps"),
    )
    wanted = flat.join(npm, ["repo", "dir"]).select("repo", "manifest_path", F.posexplode(F.map_entries("deps")).alias("pos", "d"))
    wanted = wanted.filter(F.rlike(F.lower("d.key"), F.lit("|".join(HARDHAT_DEPS)))).withColumn("ckey", ckey(filename, 2, F.lit("")))
    root_key = flat.select("repo", "manifest_path", ckey(filename, 2, F.lit("")).alias("ckey"))
    pkg_key = pkgs.select("repo", "manifest_path", "pkg", ckey(filename, 1, F.col("pkg")).alias("ckey"))
    rows = pkg_rows.unionByName(flat_rows)
    metadata = union([
        rows.select("repo", "ckey", F.lit("framework").alias("key"), F.lit("hardhat").alias("value")),
        _declared_metadata(counts, pkg_key, ["repo", "manifest_path", "pkg"]),
        _declared_metadata(counts, root_key, ["repo", "manifest_path"]),
    ])
    none = rows.limit(0)
    return Inventory(
        rows, internal_rows(none, F.lit("")), external_rows(wanted, F.col("d.key"), F.col("d.value"), F.col("pos"), "solidity-tooling"), metadata
    )


def discover(files: DataFrame, mode: str = "segment") -> Inventory:
    sol, _ = stage(facts(files), "sol-facts")
    return merge([_foundry(files, sol, mode), *[_hardhat(files, sol, name, mode) for name in HARDHAT]])
