"""Cargo crates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.text import all_groups, contains_any, first_group, NEWLINE, strip, strip_chars
from repoloom.operators.discovery.common import (
    Inventory, component_rows, external_rows, flag, folder_name, internal_rows, manifests, workspace_members,
)
from repoloom.runtime import stage

FILE = "Cargo.toml"
# Texts and names that mark a service or a CLI; cli is also the default.
SERVICE_DEPS = ["actix-web", "axum", "warp", "rocket", "tonic", "hyper", "tower", "tide"]
CLI_DEPS = ["clap", "structopt", "argh", "gumdrop"]
SERVICE_NAMES = ["server", "service", "daemon", "node", "api"]
# Formats of manifest sections.
PACKAGE = r"(?s)\[package\](.*?)(?:\[|\z)"
DEPENDENCY_TABLE = r"(?ms)^\[(?:target\.[^\]]+\.)?(dependencies|dev-dependencies|build-dependencies)\](.*?)(?=^\[|\z)"
BIN_TABLE = r"(?ms)^\[\[bin\]\](.*?)(?=^\[|\z)"
WORKSPACE_MEMBERS = r"(?s)\[workspace\].*?members\s*=\s*\[(.*?)\]"


def package_field(content: Column, field: str) -> Column:
    return first_group(F.regexp_extract(content, PACKAGE, 1), rf"(?m)^\s*{field}\s*=\s*[\"']([^\"']*)[\"']")


def is_workspace(content: Column) -> Column:
    return F.rlike(content, F.lit(r"(?m)^\[workspace\]"))


def members(files: DataFrame, mode: str = "segment") -> DataFrame:
    """(repo, workspace, pos, manifest_path): crates named by workspaces."""
    found = manifests(files, FILE, mode)
    block = F.regexp_replace(F.regexp_extract("content", WORKSPACE_MEMBERS, 1), r"(?m)^\s*#.*$", "")
    listed = all_groups(block, r"[\"']([^\"']+)[\"']")
    rows = found.filter(is_workspace(F.col("content"))).select("repo", "manifest_path", "dir", F.posexplode(listed).alias("pos", "pattern"))
    return workspace_members(rows, found.select("repo", "manifest_path", "dir"))


def dependencies(crates: DataFrame) -> DataFrame:
    """(repo, ckey, section, pos, name, version, local) over all dependency tables."""
    content = F.col("content")
    tables = F.arrays_zip(all_groups(content, DEPENDENCY_TABLE, 1).alias("section"), all_groups(content, DEPENDENCY_TABLE, 2).alias("body"))
    rows = crates.select("repo", "ckey", F.posexplode(tables).alias("t", "table"))
    rows = rows.select("repo", "ckey", "t", "table.section", F.posexplode(F.split("table.body", NEWLINE)).alias("l", "line"))
    pattern = r"^\s*([a-zA-Z0-9_-]+)\s*=\s*(.*)"
    value = strip(F.regexp_extract("line", pattern, 2))
    bare = strip_chars(value, "\"'")
    inline = F.coalesce(first_group(value, r"version\s*=\s*[\"']([^\"']+)"), F.lit(""))
    return rows.filter(F.rlike("line", F.lit(pattern))).select(
        "repo", "ckey", "section", (F.col("t") * 1_000_000 + F.col("l")).alias("pos"), F.regexp_extract("line", pattern, 1).alias("name"),
        F.when(F.startswith(bare, F.lit("{")), inline).otherwise(bare).alias("version"), F.rlike(value, F.lit(r"\bpath\s*=")).alias("local"),
    )


def _kind() -> Column:
    content = F.col("content")
    low, name = F.lower(content), F.lower(F.coalesce(package_field(content, "name"), F.lit("")))
    runs = (
        F.when(contains_any(low, SERVICE_DEPS), "service").when(contains_any(low, CLI_DEPS), "cli")
        .when(contains_any(name, SERVICE_NAMES), "service").otherwise("cli")
    )
    has_bin = F.rlike(content, F.lit(r"(?m)^\[\[bin\]\]")) | F.col("main_rs")
    has_lib = F.rlike(content, F.lit(r"(?m)^\[lib\]")) | F.col("lib_rs")
    own = F.coalesce(package_field(content, "name"), F.lit(""))
    bins = F.transform(all_groups(content, BIN_TABLE), lambda b: F.regexp_extract(b, r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", 1))
    other_bin = F.exists(bins, lambda b: (b != "") & (b != own))
    return F.when(~has_bin, "library").when(has_lib & ~other_bin, "library").otherwise(runs)


def _holding(files: DataFrame, tail: str) -> DataFrame:
    """(repo, dir) of folders with the file ``tail`` at that place below them."""
    hit = (F.col("path") == tail) | F.endswith("path", F.lit("/" + tail))
    return files.filter(hit).select("repo", F.regexp_replace("path", f"/?{tail}$", "").alias("dir"))


def discover(files: DataFrame, mode: str = "segment") -> Inventory:
    # a workspace root gives way to its members, which are manifests themselves
    crates = manifests(files, FILE, mode).filter(~is_workspace(F.col("content")))
    crates = flag(crates, _holding(files, "src/main.rs"), ["repo", "dir"], "main_rs")
    crates, _ = stage(flag(crates, _holding(files, "src/lib.rs"), ["repo", "dir"], "lib_rs"), "crates")
    name = F.coalesce(package_field(F.col("content"), "name"), folder_name(F.col("dir")))
    rows = component_rows(
        crates, FILE, name=name, kind=_kind(), type=F.lit("rust-crate"), root=F.col("dir"), description=package_field(F.col("content"), "description")
    )
    keyed = crates.select("repo", F.concat_ws("|", F.lit(FILE), "manifest_path", F.lit(0), F.lit("")).alias("ckey"), "content")
    deps = dependencies(keyed)
    first = deps.filter("not local and section = 'dependencies'").groupBy("repo", "ckey", "name").agg(
        F.min("pos").alias("pos"), F.min_by("version", "pos").alias("version")
    )
    local = deps.filter("local").select("repo", "ckey", "name").distinct()
    return Inventory(rows, internal_rows(local, F.col("name")), external_rows(first, F.col("name"), F.col("version"), F.col("pos")))
