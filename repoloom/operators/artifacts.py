"""Generated artifacts: inventories with checksums and versioned manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repoloom.functions.paths import basename
from repoloom.sources.tables import latest_manifest

# Category by top folder.
CATEGORIES = {
    "service_discovery": "discovery",
    "dependency_graphs": "graph",
    "service_analyses": "analysis",
    "architecture_docs": "architecture",
}


def artifact_inventory(files: DataFrame) -> DataFrame:
    """(service, path, size_bytes, sha256, category) of ``.md`` and ``.json``
    files (service, path, content), manifests left out."""
    some = files.filter(F.rlike("path", F.lit(r"\.(?:md|json)$")) & (basename(F.col("path")) != "manifest.json"))
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1))
    names = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return some.select(
        "service", "path", F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), F.coalesce(F.try_element_at(names, top), F.lit("")).alias("category"),
    )


def next_manifest(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest rows for ``new`` runs (service, source_repo, source_commit, model).

    Version 1 for a new service, else one more than its latest; blank commit
    and model are inherited, the source repository always is.
    """
    prev = latest_manifest(previous).select(
        "service", F.col("version").alias("_v"), F.col("source_repo").alias("_r"),
        F.col("source_commit").alias("_c"), F.col("model").alias("_m"),
    )
    own = lambda c, p: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(p), F.lit("")).alias(c)
    return new.join(prev, "service", "left").select(
        "service", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), F.current_timestamp().alias("generated_at"),
        F.coalesce("_r", "source_repo", F.lit("")).alias("source_repo"), own("source_commit", "_c"), own("model", "_m"),
    )


def compare_inventory(before: DataFrame, after: DataFrame) -> DataFrame:
    """(service, path, change): added, removed, changed or same, by checksum."""
    old = before.select("service", "path", F.col("sha256").alias("_a"))
    new = after.select("service", "path", F.col("sha256").alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
        .when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    )
    return old.join(new, ["service", "path"], "full").select("service", "path", change.alias("change"))
