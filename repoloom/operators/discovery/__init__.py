"""Component discovery: one job per ecosystem, ``files -> Inventory``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from repoloom.functions.running import running_totals
from repoloom.functions.text import json_type, json_type_name, json_variant
from repoloom.operators.discovery import go, python, rust, solidity, swift, typescript
from repoloom.operators.discovery.common import Inventory, manifests, merge, read_once
from repoloom.operators.inventory import dedupe_components, resolve_internal_deps
from repoloom.runtime import stage
from repoloom.sources import files as file_rules

Job = Callable[[DataFrame, str], Inventory]

# In order of precedence: the first component found at a root path stays.
ECOSYSTEMS: dict[str, Job] = {
    "go": go.discover,
    "python": python.discover,
    "typescript": typescript.discover,
    "rust": rust.discover,
    "solidity": solidity.discover,
    "swift": swift.discover,
}


#: Ecosystems of the library, which read files through :func:`read_files`; others get the files as they are.
OWN = tuple(ECOSYSTEMS)
FACTS = {"go": go.fact_columns, "python": python.fact_columns, "solidity": solidity.fact_columns, "swift": swift.fact_columns}


def register(name: str, job: Job, manifests: list[str], excludes: list[str] = ()) -> None:
    """Add an ecosystem after the known ones.

    ``job(files, mode)`` returns an :class:`Inventory`, most easily built with
    the helpers in ``common``.
    """
    if name in ECOSYSTEMS:
        raise ValueError(f"ecosystem {name!r} exists")
    precedence = len(ECOSYSTEMS)
    file_rules.MANIFESTS.extend((m, name, precedence, i) for i, m in enumerate(manifests))
    file_rules.EXCLUDES[name] = list(excludes)
    ECOSYSTEMS[name] = job


def unregister(name: str) -> None:
    ECOSYSTEMS.pop(name)
    file_rules.EXCLUDES.pop(name, None)
    file_rules.MANIFESTS[:] = [m for m in file_rules.MANIFESTS if m[1] != name]


def read_files(files: DataFrame, ecosystems: list[str]) -> DataFrame:
    """``files`` as the jobs of these ecosystems need them, in one pass over the contents; :func:`discover` takes either."""
    if "part" in files.columns:
        return files
    return read_once(files, {name: FACTS[name] for name in ecosystems if name in FACTS})


def _written(inventory: Inventory, name: str) -> Inventory:
    """Components and internal dependencies of one ecosystem as tables of their own.

    One plan over all ecosystems has some hundred exchanges and broadcasts,
    which the driver holds together; written one by one, those of a single
    job are the most at a time.
    """
    components, _ = stage(inventory.components, f"{name}-components")
    internal, _ = stage(inventory.internal, f"{name}-internal")
    return replace(inventory, components=components, internal=internal)


def discover(files: DataFrame, ecosystems: list[str] | None = None, mode: str = "segment") -> Inventory:
    """Inventory of all repositories in ``files`` (repo, path, content).

    Components are unique per root path and numbered in discovery order
    (``ordinal``, counted per repository over range partitions); internal
    dependencies are component names, by ``component``.
    """
    chosen = list(ECOSYSTEMS) if ecosystems is None else ecosystems
    known = [name for name in chosen if name in OWN]
    once = read_files(files, known) if len(known) > 1 else files
    raw = merge([_written(ECOSYSTEMS[name](once if name in OWN else files, mode), name) for name in chosen])
    first = dedupe_components(raw.components, F.col("ord"))
    numbered = running_totals(first, ["repo"], ["ord"], {"ordinal": F.lit(1).cast("bigint")})
    components, _ = stage(numbered.drop("ord"), "components")
    owner = components.select("repo", "ckey", F.col("name").alias("component"))
    internal, _ = stage(raw.internal.join(owner, ["repo", "ckey"]).select("repo", "ckey", "component", "pos", "dep"), "internal")
    external = raw.external.join(owner, ["repo", "ckey"]).select("repo", "component", "pos", "name", "version", "category")
    metadata = None
    if raw.metadata is not None:
        metadata = raw.metadata.join(owner, ["repo", "ckey"]).select("repo", "component", "key", "value")
    resolved = resolve_internal_deps(components, internal).drop("ckey")
    return Inventory(components.drop("ckey"), resolved, external, metadata)


def manifest_errors(files: DataFrame, mode: str = "segment") -> DataFrame:
    """(repo, path, error): JSON manifests that discovery has to leave out."""
    found = manifests(files, typescript.FILE, mode)
    kind = json_type(json_variant(F.col("content")))
    error = F.when(kind.isNull(), "Invalid JSON").when(kind != "OBJECT", F.concat(F.lit("must be a JSON object, got "), json_type_name(kind)))
    return found.select("repo", F.col("manifest_path").alias("path"), error.alias("error")).filter("error is not null")


def discover_corpus(repos: DataFrame, files: DataFrame, mode: str = "segment") -> tuple[Inventory, DataFrame]:
    """(inventory, outcome) of all ``repos``, whatever happens to single ones.

    Outcome is (repo, status, error): ``clone_failed`` without any file,
    ``discovery_failed`` where unreadable manifests leave no component, else
    ``ok``; the error names the first unreadable manifest, also of a
    repository that is otherwise fine.
    """
    if list(ECOSYSTEMS) == list(OWN):  # jobs of the user get whole files
        files = read_files(files, list(OWN))
    inventory = discover(files, mode=mode)
    inventory = replace(inventory, internal=stage(inventory.internal, "resolved")[0])
    bad = manifest_errors(files, mode).groupBy("repo").agg(
        F.min_by(F.concat("path", F.lit(": "), "error"), "path").alias("error"))
    there = files.select("repo").distinct().withColumn("_there", F.lit(True))
    has = inventory.components.select("repo").distinct().withColumn("_has", F.lit(True))
    joined = repos.select("repo").distinct()
    for part in (there, has, bad):
        joined = joined.join(part, "repo", "left")
    status = (
        F.when(F.col("_there").isNull(), "clone_failed")
        .when(F.col("_has").isNull() & F.col("error").isNotNull(), "discovery_failed").otherwise("ok")
    )
    return inventory, stage(joined.select("repo", status.alias("status"), "error"), "outcome")[0]
