"""Shared parts of the ecosystem jobs: files -> inventory.

Every job selects its manifests, extracts fields with column functions, turns
each file-system question into a join with the files table, and aggregates
source signals per folder. Contents never travel: what a job needs from a
source file is reduced to a few flags or names before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.paths import ancestors, basename, dirname, glob_regex_col, join_path, segments
from repoloom.runtime import stage
from repoloom.sources.files import EXCLUDES, MANIFESTS, excluded

EXTERNAL = ["repo", "ckey", "pos", "name", "version", "category"]


@dataclass(frozen=True)
class Inventory:
    """Components and, by ``ckey``, their dependencies and metadata.

    components: repo, ckey, name, kind, type, root_path, manifest_path,
    description, ord. internal: repo, ckey, pos, dep. external: repo, ckey,
    pos, name, version, category. metadata: repo, ckey, key, value.
    """

    components: DataFrame
    internal: DataFrame
    external: DataFrame
    metadata: DataFrame | None = None


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def merge(parts: list[Inventory]) -> Inventory:
    meta = [p.metadata for p in parts if p.metadata is not None]
    return Inventory(
        union([p.components for p in parts]), union([p.internal for p in parts]),
        union([p.external for p in parts]), union(meta) if meta else None,
    )


def manifests(files: DataFrame, filename: str, mode: str = "segment") -> DataFrame:
    """(repo, manifest_path, dir, content) of one kind of manifest, exclusions applied."""
    eco = next(m[1] for m in MANIFESTS if m[0] == filename)
    path = F.col("path")
    if "part" in files.columns:
        files = files.filter(F.col("part") == part_of(F.lit(filename)))
    hit = ((path == filename) | F.endswith(path, F.lit("/" + filename))) & ~excluded(path, EXCLUDES[eco], mode)
    return files.filter(hit).select("repo", path.alias("manifest_path"), dirname(path).alias("dir"), "content")


def sources(files: DataFrame, suffix: str) -> DataFrame:
    """(repo, path, dir, content) of source files; ``content`` is read only if used."""
    return files.filter(F.endswith("path", F.lit(suffix))).select("repo", "path", dirname(F.col("path")).alias("dir"), "content")


#: Suffix of the source files whose contents an ecosystem looks into.
SUFFIXES = {"go": ".go", "python": ".py", "solidity": ".sol", "swift": ".swift"}


def part_of(path: Column) -> Column:
    """Folder of a file in the table that :func:`read_once` writes."""
    part = F.when(basename(path).isin([m[0] for m in MANIFESTS if not m[0].endswith(tuple(SUFFIXES.values()))]), "manifest")
    for name, suffix in SUFFIXES.items():
        part = part.when(F.endswith(path, F.lit(suffix)), name)
    return part.otherwise("other")


def read_once(files: DataFrame, facts: dict[str, Callable[[Column], dict[str, Column]]]) -> DataFrame:
    """Files with contents of manifests alone and, by ecosystem, the facts of their sources.

    One pass over the contents: what the jobs ask of a source file, as columns
    of its text, is computed in the scan; what they write is laid out by
    ecosystem, so that each job reads its own part. ``files`` may hold any
    columns beside (repo, path, content).
    """
    path, text = F.col("path"), F.col("content")
    own = [
        F.when(F.endswith(path, F.lit(SUFFIXES[name])), F.struct(*[c.alias(n) for n, c in columns(F.when(F.endswith(path, F.lit(SUFFIXES[name])), text)).items()])).alias(f"facts_{name}")
        for name, columns in facts.items()]
    kept = F.when(basename(path).isin([m[0] for m in MANIFESTS]), text).alias("content")
    return stage(files.select("repo", "path", kept, *own, part_of(path).alias("part")), "files-once", by="part")[0]


def source_facts(files: DataFrame, name: str, columns: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(repo, path, dir, …) of an ecosystem's sources: from files read once, else from their contents."""
    folder = dirname(F.col("path")).alias("dir")
    if f"facts_{name}" in files.columns:
        return files.filter(F.col("part") == name).select("repo", "path", folder, f"facts_{name}.*")
    return sources(files, SUFFIXES[name]).select("repo", "path", "dir", *[c.alias(n) for n, c in columns(F.col("content")).items()])


def ckey(filename: str, rank: int, label: Column) -> Column:
    return F.concat_ws("|", F.lit(filename), "manifest_path", F.lit(rank), label)


def component_rows(
    df: DataFrame, filename: str, *, name: Column, kind: Column, type: Column, root: Column,
    rank: int = 0, label: Column | None = None, description: Column | None = None, order: Column | None = None,
) -> DataFrame:
    """Component columns from rows with ``repo`` and ``manifest_path``.

    ``rank`` and ``label`` order the components of one manifest and make their
    key; ``order`` replaces the label in the order (path parts, say).
    """
    _, _, precedence, pattern = next(m for m in MANIFESTS if m[0] == filename)
    tag = F.lit("") if label is None else label
    where = F.array(tag) if order is None else order
    return df.select(
        "repo", ckey(filename, rank, tag).alias("ckey"), name.alias("name"), kind.alias("kind"), type.alias("type"),
        F.when(root == "", ".").otherwise(root).alias("root_path"), "manifest_path",
        (F.lit("") if description is None else F.coalesce(description, F.lit(""))).alias("description"),
        F.struct(
            F.lit(precedence).alias("precedence"), F.lit(pattern).alias("pattern"),
            segments(F.col("manifest_path")).alias("parts"), F.lit(rank).alias("rank"), where.alias("label"),
        ).alias("ord"),
    )


def internal_rows(df: DataFrame, dep: Column, pos: Column | None = None) -> DataFrame:
    """Dependency rows; without ``pos`` they are read in name order."""
    at = F.lit(0) if pos is None else pos
    return df.select("repo", "ckey", at.cast("bigint").alias("pos"), dep.alias("dep"))


def external_rows(df: DataFrame, name: Column, version: Column, pos: Column | None = None, category: str = "") -> DataFrame:
    at = F.lit(0) if pos is None else pos
    return df.select(
        "repo", "ckey", at.cast("bigint").alias("pos"), name.alias("name"),
        F.coalesce(version, F.lit("")).alias("version"), F.lit(category).alias("category"),
    )


def no_external(df: DataFrame) -> DataFrame:
    return external_rows(df.limit(0).select("repo", "ckey"), F.lit(""), F.lit(""))


def folder_name(folder: Column) -> Column:
    """Name of a folder; the repository's own name at its root."""
    return F.when(folder == "", F.substring_index("repo", "/", -1)).otherwise(basename(folder))


def under(rows: DataFrame, roots: DataFrame, root: str = "root") -> DataFrame:
    """Rows (repo, dir, …) joined to the roots (repo, ``root``, …) above them.

    Equality on exploded folders; the root '' holds everything.
    """
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(ancestors(F.col("dir"))))
    return rows.withColumn(root, F.explode(above)).join(roots, ["repo", root])


def folders_with(files: DataFrame, suffix: str) -> DataFrame:
    """Distinct (repo, dir) of folders with such a file anywhere below."""
    direct = files.filter(F.endswith("path", F.lit(suffix))).select("repo", dirname(F.col("path")).alias("dir")).distinct()
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(ancestors(F.col("dir"))))
    return direct.select("repo", F.explode(above).alias("dir")).distinct()


def folders_holding(files: DataFrame, names: list[str]) -> DataFrame:
    """Distinct (repo, dir) of folders that hold one of ``names`` directly."""
    path = F.col("path")
    hit = reduce(lambda a, b: a | b, [(path == n) | F.endswith(path, F.lit("/" + n)) for n in names])
    return files.filter(hit).select("repo", dirname(path).alias("dir")).distinct()


def flag(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add boolean ``name``: is the row's key in ``keys``?"""
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def workspace_members(roots: DataFrame, members: DataFrame) -> DataFrame:
    """Which manifests do workspace patterns name?

    ``roots``: (repo, manifest_path, dir, pos, pattern); ``members``: (repo,
    manifest_path, dir). A pattern without wildcard folders fixes both the depth
    and the literal folders before the first wildcard; members are found by
    equality on those, then tested against the whole pattern.
    """
    clean = F.regexp_replace(F.regexp_replace("pattern", r"^(?:\./)+", ""), "/+$", "")
    whole = join_path(F.col("dir"), clean)
    parts = segments(whole)
    wild = F.transform(parts, lambda s: F.rlike(s, F.lit(r"[*?\[]")))
    first = F.array_position(wild, F.lit(True)).cast("int")
    fixed = F.when(first > 0, F.array_join(F.slice(parts, F.lit(1), first - 1), "/")).otherwise(whole)
    asked = roots.filter(~F.startswith("pattern", F.lit("!"))).select(
        "repo", F.col("manifest_path").alias("workspace"), "pos", fixed.alias("_head"), F.size(parts).alias("_depth"), glob_regex_col(whole).alias("_regex")
    )
    heads = F.concat(F.array(F.lit("")), ancestors(F.col("dir")))
    offered = members.filter("dir <> ''").select("repo", "manifest_path", "dir", F.size(segments(F.col("dir"))).alias("_depth"), F.explode(heads).alias("_head"))
    return offered.join(asked, ["repo", "_head", "_depth"]).filter(F.rlike("dir", F.col("_regex"))).select(
        "repo", "workspace", "pos", "manifest_path"
    )
