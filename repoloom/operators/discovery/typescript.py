"""npm packages (TypeScript and JavaScript)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.text import json_type, json_variant
from repoloom.operators.discovery.common import (
    Inventory, component_rows, external_rows, flag, folder_name, folders_holding, folders_with, internal_rows, manifests, workspace_members,
)
from repoloom.runtime import stage

FILE = "package.json"
# Dependencies that mark a frontend or a server.
FRONTEND_DEPS = [
    "react", "vue", "svelte", "angular", "@angular/core",
    "next", "nuxt", "gatsby", "remix", "@remix-run/react",
    "solid-js", "preact", "lit",
]
SERVER_DEPS = ["express", "fastify", "koa", "hapi", "@hapi/hapi", "nestjs", "@nestjs/core", "hono"]
# Version prefixes of dependencies inside the repository.
LOCAL_VERSION = "^(?:file|workspace|link):"
MAPS = ["dependencies", "peerDependencies", "devDependencies", "scripts"]
TEXTS = ["name", "description", "private", "workspaces", "main", "bin"]


def truthy(raw: Column) -> Column:
    """Does a raw JSON value count as set?"""
    return ~F.coalesce(raw, F.lit("")).isin("", "false", "null", "0", "[]", "{}")


def parsed(found: DataFrame) -> DataFrame:
    """Manifest fields; files that are no JSON object are left out."""
    good = found.filter(json_type(json_variant(F.col("content"))) == "OBJECT")
    raw = good.select("repo", "manifest_path", "dir", F.json_tuple("content", *TEXTS, *MAPS).alias(*TEXTS, *[f"_{m}" for m in MAPS]))
    empty = F.create_map().cast("map<string,string>")
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), empty)
    return raw.select("repo", "manifest_path", "dir", *TEXTS, *[as_map(f"_{m}").alias(m) for m in MAPS])


def is_workspace_root() -> Column:
    return truthy(F.col("private")) & truthy(F.col("workspaces")) & ~truthy(F.col("main"))


def members(files: DataFrame, mode: str = "segment") -> DataFrame:
    """(repo, workspace, pos, manifest_path): packages named by workspace roots,
    whose patterns are an array or an object with ``packages``."""
    found = manifests(files, FILE, mode)
    roots = parsed(found).filter(is_workspace_root())
    listed = F.coalesce(F.get_json_object("workspaces", "$.packages"), F.col("workspaces"))
    rows = roots.select("repo", "manifest_path", "dir", F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "pattern"))
    return workspace_members(rows, found.select("repo", "manifest_path", "dir"))


def _kind() -> Column:
    names = F.array_union(F.map_keys("dependencies"), F.map_keys("devDependencies"))
    has = lambda words: F.arrays_overlap(names, F.lit(words))
    script = lambda s: F.map_contains_key("scripts", s)
    main = truthy(F.col("main"))
    return (
        F.when(F.col("wrangler"), "service").when(truthy(F.col("bin")), "cli").when(has(FRONTEND_DEPS), "frontend")
        .when(has(SERVER_DEPS) & (script("start") | main), "service")
        .when(main & (script("start") | script("serve")), "service").otherwise("library")
    )


def discover(files: DataFrame, mode: str = "segment") -> Inventory:
    # a workspace root gives way to its members, which are manifests themselves
    pkgs = parsed(manifests(files, FILE, mode)).filter(~is_workspace_root())
    pkgs = flag(pkgs, folders_holding(files, ["wrangler.toml", "wrangler.jsonc"]), ["repo", "dir"], "wrangler")
    typed = folders_holding(files, ["tsconfig.json"]).unionByName(folders_with(files, ".ts"))
    pkgs, _ = stage(flag(pkgs, typed, ["repo", "dir"], "ts"), "npm-packages")
    name = F.coalesce("name", folder_name(F.col("dir")))
    rows = component_rows(
        pkgs, FILE, name=name, kind=_kind(), type=F.when(F.col("ts"), "typescript-package").otherwise("javascript-package"),
        root=F.col("dir"), description=F.col("description"),
    )
    entries = lambda m, section: F.transform(
        F.map_entries(m), lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("version"))
    )
    listed = F.concat(entries("dependencies", 0), entries("peerDependencies", 1))
    deps = pkgs.select("repo", "manifest_path", F.posexplode(listed).alias("pos", "d")).join(
        rows.select("repo", "manifest_path", "ckey"), ["repo", "manifest_path"]
    )
    version = F.coalesce("d.version", F.lit(""))
    local = F.rlike(version, F.lit(LOCAL_VERSION))
    return Inventory(
        rows, internal_rows(deps.filter(local), F.col("d.name"), F.col("pos")),
        external_rows(deps.filter(~local), F.col("d.name"), version, F.col("pos")),
    )
