"""Which components does a set of changed files touch?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from repoloom.functions.paths import ancestors, dirname, segments
from repoloom.functions.running import ranks
from repoloom.operators.graph import simple_graph
from repoloom.runtime import stage


def _clean_roots(components: DataFrame) -> DataFrame:
    roots = components.filter(F.col("root_path") != "")
    return roots.select("repo", "name", "ordinal", F.regexp_replace("root_path", "/+$", "").alias("root"))


def owners(changed: DataFrame, components: DataFrame, policy: str = "first") -> DataFrame:
    """(repo, path, component): null where no root contains the path.

    Roots are found by equality on the folders above a path. Folders are made
    distinct first, so the shuffle sees each once however many files it holds.
    ``policy`` is ``first`` (inventory order) or ``longest`` (most specific root).
    """
    if policy not in ("first", "longest"):
        raise ValueError(f"unknown policy {policy!r}")
    rank = F.struct("ordinal", "name") if policy == "first" else F.struct((-F.length("root")).alias("l"), "ordinal", "name")
    best = _clean_roots(components).groupBy("repo", "root").agg(F.min(rank).alias("_rank"))
    files = changed.select("repo", "path").distinct().withColumn("_dir", dirname(F.col("path")))
    folders = files.select("repo", "_dir").distinct()
    by_folder = (
        folders.select("repo", "_dir", F.explode(ancestors(F.col("_dir"))).alias("root"))
        .join(best, ["repo", "root"]).groupBy("repo", "_dir").agg(F.min("_rank").alias("_above"))
    )
    itself = best.select("repo", F.col("root").alias("path"), F.col("_rank").alias("_self"))
    found = files.join(by_folder, ["repo", "_dir"], "left").join(itself, ["repo", "path"], "left")
    return found.select("repo", "path", F.least("_above", "_self")["name"].alias("component"))


def map_files(changed: DataFrame, components: DataFrame, policy: str = "first") -> tuple[DataFrame, DataFrame]:
    """(affected, unmapped): distinct (repo, component), and (repo, path) without owner."""
    owned = owners(changed, components, policy)
    affected = owned.filter("component is not null").select("repo", "component").distinct()
    return affected, owned.filter("component is null").select("repo", "path")


def diff_plan(repos: DataFrame, changed: DataFrame, components: DataFrame, policy: str = "first") -> DataFrame:
    """(repo, mode, affected, unmapped) for repos (repo, last_sha).

    ``full`` without an earlier commit, without an inventory, or with an empty
    diff; otherwise ``incremental``.
    """
    owned = owners(changed, components, policy)
    # distinct components first, so that counting stays partial per repo
    touched = owned.filter("component is not null").select("repo", "component").distinct().groupBy("repo").agg(F.count("*").alias("affected"))
    loose = owned.groupBy("repo").agg(F.count("*").alias("changed"), F.count_if(F.col("component").isNull()).alias("unmapped"))
    known = components.select("repo").distinct().withColumn("_known", F.lit(True))
    joined = repos.join(known, "repo", "left").join(loose, "repo", "left").join(touched, "repo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    blank = F.coalesce("last_sha", F.lit("")) == ""
    full = blank | F.col("_known").isNull() | (zero("changed") == 0)
    return joined.select(
        "repo", F.when(full, "full").otherwise("incremental").alias("mode"),
        F.when(full, 0).otherwise(zero("affected")).alias("affected"),
        F.when(full, 0).otherwise(zero("unmapped")).alias("unmapped"),
    )


def change_worklist(changed: DataFrame, components: DataFrame, files_per_component: int | None = None, unmapped_files: int | None = None) -> DataFrame:
    """(repo, section, component, pos, path): each affected component with its
    changed files (all files below its root count), and the files outside known
    components, both ranked by path; the limits, if given, keep the first ones."""
    affected, unmapped = map_files(changed, components)
    touched = _clean_roots(components).select("repo", F.col("name").alias("component"), "root").join(affected, ["repo", "component"], "left_semi")
    below = (
        changed.select("repo", "path", F.explode(ancestors(F.col("path"))).alias("root"))
        .join(touched, ["repo", "root"]).select("repo", "component", "path").distinct()
    )
    rows = below.select("repo", F.lit("changed").alias("section"), "component", "path").unionByName(
        unmapped.select("repo", F.lit("unmapped").alias("section"), F.lit(None).cast("string").alias("component"), "path")
    ).withColumn("_parts", segments(F.col("path")))
    limits = {"changed": files_per_component, "unmapped": unmapped_files}
    given = {section: cap for section, cap in limits.items() if cap is not None}
    ranked = ranks(rows, ["repo", "section", "component"], ["_parts"], max(given.values()) if len(given) == len(limits) else None)
    for section, cap in given.items():
        ranked = ranked.filter((F.col("section") != section) | (F.col("pos") <= cap))
    return ranked.select("repo", "section", "component", "pos", "path")


def affected_dependents(affected: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(repo, component, hop): what depends on the changed set, directly or
    through others, with the least number of steps; at most ``hops`` away if
    that is given. The changed components themselves are not repeated.

    Semi-naive: a round joins only what the round before found, so each edge is
    met once; there are as many rounds as the farthest dependent is away.
    """
    pairs = simple_graph(edges).select("repo", F.col("source").alias("component"), F.col("target").alias("_to"))
    pairs, _ = stage(pairs, "arcs")
    front, _ = stage(affected.select("repo", "component").distinct(), "hop-0")
    seen, found = [front], []
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        new = pairs.join(front.withColumnRenamed("component", "_to"), ["repo", "_to"], "left_semi").select("repo", "component").distinct()
        if len(seen) >= 16:
            seen = [stage(reduce(DataFrame.union, seen), "reached")[0]]
            found = [stage(reduce(DataFrame.union, found), "found")[0]]
        new = new.join(reduce(DataFrame.union, seen), ["repo", "component"], "left_anti")
        front, got = stage(new, f"hop-{hop}", n=F.count("*"))
        if not got["n"]:
            break
        seen.append(front)
        found.append(front.withColumn("hop", F.lit(hop)))
    return reduce(DataFrame.union, found) if found else front.limit(0).withColumn("hop", F.lit(0))
