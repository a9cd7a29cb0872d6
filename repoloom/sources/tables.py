"""Inventories, manifests, snapshots, corpora, audits and traces as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from repoloom.functions.text import json_variant
from repoloom.functions.kinds import parse_kind, slugify
from repoloom.functions.paths import ancestors, dirname

TRACE_SCHEMA = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_line", T.IntegerType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("token_usage", T.StructType([
        T.StructField("input", T.LongType()), T.StructField("output", T.LongType()),
    ])),
    T.StructField("error", T.StringType()),
])


def _field(item: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(default))


def components_from_json(documents: DataFrame) -> DataFrame:
    """Component rows of inventory documents (repo, content).

    A document is an object with a ``components`` array or a bare array;
    anything else, or an empty one, has no rows. Missing fields take defaults.
    """
    doc = json_variant(F.col("content"))
    items = F.coalesce(
        F.try_variant_get(doc, "$.components", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>")
    )
    rows = documents.select("repo", F.posexplode(items).alias("ordinal", "c")).filter(
        F.try_variant_get("c", "$.name", "string").isNotNull()
    )
    c = F.col("c")
    return rows.select(
        "repo", _field(c, "name").alias("name"), F.col("ordinal").cast("bigint").alias("ordinal"),
        parse_kind(_field(c, "kind")).alias("kind"), _field(c, "type", "unknown").alias("type"),
        _field(c, "root_path").alias("root_path"), _field(c, "manifest_path").alias("manifest_path"),
        _field(c, "description").alias("description"),
        F.coalesce(F.try_variant_get(c, "$.internal_dependencies", "array<string>"), F.array().cast("array<string>")).alias("internal_dependencies"),
        F.transform(
            F.coalesce(F.try_variant_get(c, "$.external_dependencies", "array<variant>"), F.array().cast("array<variant>")),
            external_dependency,
        ).alias("external_dependencies"),
    )


def external_dependency(item: Column) -> Column:
    """A dependency given as plain text or as an object with optional fields."""
    plain = F.startswith(F.schema_of_variant(item), F.lit("STRING"))
    return F.struct(
        F.when(plain, F.try_variant_get(item, "$", "string")).otherwise(_field(item, "name")).alias("name"),
        *[F.when(plain, F.lit("")).otherwise(_field(item, n)).alias(n) for n in ("version", "category", "purpose")],
    )


def load_components(spark: SparkSession, path: str) -> DataFrame:
    """Inventories below ``path/<repo>/…/components.json``; none gives no rows."""
    docs = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "components.json").load(path)
    )
    rel = F.substring_index("path", path.rstrip("/") + "/", -1)
    return components_from_json(docs.select(F.substring_index(rel, "/", 1).alias("repo"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")))


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The manifest with the highest version per service."""
    keep = [c for c in manifests.columns if c != "service"]
    top = manifests.groupBy("service").agg(F.max_by(F.struct(*keep), "version").alias("_m"))
    return top.select("service", "_m.*")


def _digest(files: DataFrame) -> Column:
    return F.col("digest") if "digest" in files.columns else F.sha2("content", 256)


def file_digests(files: DataFrame) -> DataFrame:
    """(repo, path, digest): what to keep of a snapshot for later comparisons."""
    return files.select("repo", "path", _digest(files).alias("digest"))


DIGEST_PARTS = 4


def folder_digests(digests: DataFrame) -> DataFrame:
    """(repo, folder, files, digest) of every folder with all that is below it; '' is the repository.

    A digest covers the set of (path, file digest) below the folder. It is a
    sum over files of 60-bit parts of their hashes, so files are added up
    within tasks, folders of any size are shuffled as one row per task, and no
    level waits for another. A file of null digest counts by its path alone.
    """
    own = F.sha2(F.concat("path", F.lit("\n"), F.coalesce("digest", F.lit(""))), 256)
    part = lambda i: F.conv(F.substr("_h", F.lit(15 * i + 1), F.lit(15)), 16, 10).cast("decimal(19,0)")
    names = [f"_s{i}" for i in range(DIGEST_PARTS)]
    hashed = digests.select("repo", dirname(F.col("path")).alias("_dir"), own.alias("_h"))
    direct = hashed.groupBy("repo", "_dir").agg(F.count("*").alias("files"), *[F.sum(part(i)).alias(n) for i, n in enumerate(names)])
    above = F.concat(F.array(F.lit("")), F.filter(ancestors(F.col("_dir")), lambda a: a != ""))
    spread = direct.select("repo", F.explode(above).alias("folder"), "files", *names)
    total = spread.groupBy("repo", "folder").agg(F.sum("files").alias("files"), *[F.sum(n).cast("decimal(38,0)").alias(n) for n in names])
    return total.select("repo", "folder", "files", F.sha2(F.concat_ws(":", "files", *names), 256).alias("digest"))


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, folder) of folders that differ between two tables of folder digests.

    Repositories that are equal as a whole leave before their folders are compared.
    """
    def differing(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.select("repo", "folder", F.col("digest").alias("_old")).join(
            new.select("repo", "folder", F.col("digest").alias("_new")), ["repo", "folder"], "full")
        return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("repo", "folder")

    repos = differing(before.filter("folder = ''"), after.filter("folder = ''")).select("repo")
    return differing(before.join(repos, "repo", "left_semi"), after.join(repos, "repo", "left_semi"))


def changed_below(before: DataFrame, after: DataFrame, folders_before: DataFrame | None = None, folders_after: DataFrame | None = None) -> DataFrame:
    """:func:`changed_files`, descending only into folders that differ.

    ``before`` and ``after`` are files (repo, path, and digest or content).
    With folder digests at hand, as kept from an earlier run or taken from a
    listing, contents are hashed in differing folders alone; files of equal
    folders are not shuffled either way. Without them they are made here.
    """
    folders = lambda files, given: folder_digests(file_digests(files)) if given is None else given
    open_ = changed_folders(folders(before, folders_before), folders(after, folders_after)).withColumnRenamed("folder", "_dir")
    some = lambda files: files.withColumn("_dir", dirname(F.col("path"))).join(open_, ["repo", "_dir"], "left_semi").drop("_dir")
    return changed_files(some(before), some(after))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, change) of paths that differ between two snapshots.

    Contents are reduced to a digest before the shuffle; a side that has a
    column ``digest`` (see :func:`file_digests`) is taken at its word.
    """
    digest = lambda df, name: df.select("repo", "path", _digest(df).alias(name))
    both = digest(before, "old").join(digest(after, "new"), ["repo", "path"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("repo", "path", change.alias("change"))


def select_corpus(candidates: DataFrame, per_lang: int = 4, max_size_kb: int = 200_000, pool: int | None = 2) -> DataFrame:
    """The first ``per_lang`` repositories per language that are small enough,
    among the ``pool * per_lang`` with most stars (name breaks ties), or among
    all where ``pool`` is None: then large favourites leave no language short."""
    order = Window.partitionBy("language").orderBy(F.desc("stars"), "full_name")
    if pool is not None:
        candidates = candidates.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= pool * per_lang).drop("_r")
    small = candidates.filter(F.col("size_kb") <= max_size_kb).withColumn("pick", F.row_number().over(order))
    return small.filter(F.col("pick") <= per_lang)


def load_audits(discovery: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits of repositories whose discovery went well.

    ``discovery`` has (full_name, status, …), ``audits`` (slug, audit_status, …).
    """
    good = discovery.filter("status = 'ok'").withColumn("slug", slugify(F.col("full_name")))
    return good.join(audits, "slug")


def load_traces(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Trace lines (JSON per line); a broken line gives nulls, not a failure."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(TRACE_SCHEMA).json(path)
