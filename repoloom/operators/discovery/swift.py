"""Swift packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.paths import join_path, segments
from repoloom.functions.text import all_groups, balanced_span, balanced_spans, contains_any, first_group
from repoloom.operators.discovery.common import Inventory, ckey, component_rows, external_rows, folder_name, internal_rows, manifests, source_facts, under, union
from repoloom.runtime import stage

FILE = "Package.swift"
# Formats of manifest parts.
PACKAGE_NAME = r'Package\s*\(\s*name\s*:\s*"([^"]+)"'
PACKAGE_DEP = r'\.package\s*\([^)]*url\s*:\s*"([^"]+)"[^)]*\)'
TARGET_HEAD = r"\.(?:target|executableTarget|testTarget|binaryTarget|systemLibrary)"
TARGET_NAME = r'^\.(\w+)\s*\(\s*name\s*:\s*"([^"]+)"'
TARGET_DEP = r'\.(?:product|target)\s*\(\s*name\s*:\s*"([^"]+)"[^)]*\)|"([A-Za-z_][A-Za-z0-9_]*)"'
# Names and texts that mark a service, an app or a CLI.
SERVICE_NAMES = ["server", "service", "daemon", "api", "backend", "proxy"]
SERVER_SIGNS = [
    "vapor", "hummingbird", "swiftnio", "grpc",
    "httpserver", "app.run()", "server.start",
    "niotsbootstrap", "serverbootstrap",
]
APP_SIGNS = ["uiapplication", "nsapplication", "swiftui", "@main struct", "windowgroup", "scene"]


def requirements(packages: DataFrame) -> DataFrame:
    """(repo, manifest_path, pos, name, version) of packages referenced by URL."""
    rows = packages.select("repo", "manifest_path", F.posexplode(all_groups(F.col("content"), PACKAGE_DEP, 0)).alias("pos", "d"))
    url = F.regexp_replace(F.regexp_extract("d", PACKAGE_DEP, 1), r"(?:\.git)?/*$", "")
    version = F.coalesce(
        F.concat(F.lit(">="), first_group(F.col("d"), r'from\s*:\s*"([^"]+)"')), first_group(F.col("d"), r'exact\s*:\s*"([^"]+)"'),
        first_group(F.col("d"), r'"(\d+\.\d+\.\d+)"'), F.lit(""),
    )
    return rows.select("repo", "manifest_path", "pos", F.substring_index(url, "/", -1).alias("name"), version.alias("version"))


def targets(packages: DataFrame) -> DataFrame:
    """(repo, manifest_path, dir, pos, type, target, deps, path) of all targets, each read to its own closing bracket."""
    spans = F.filter(balanced_spans(F.col("content"), TARGET_HEAD), lambda t: F.rlike(t, F.lit(TARGET_NAME)))
    rows = packages.select("repo", "manifest_path", "dir", F.posexplode(spans).alias("pos", "t"))
    listed = F.coalesce(balanced_span(first_group(F.col("t"), r"(?s)dependencies\s*:\s*(\[.*)"), "[", "]"), F.lit(""))
    names = F.transform(all_groups(listed, TARGET_DEP, 0), lambda d: F.coalesce(first_group(d, TARGET_DEP, 1), first_group(d, TARGET_DEP, 2)))
    # the path of the target itself: dependencies may have one too
    own = F.replace(F.col("t"), listed, F.lit(""))
    return rows.select(
        "repo", "manifest_path", "dir", "pos", F.regexp_extract("t", TARGET_NAME, 1).alias("type"), F.regexp_extract("t", TARGET_NAME, 2).alias("target"),
        names.alias("deps"), first_group(own, r'path\s*:\s*"([^"]+)"').alias("path"),
    )


def fact_columns(text: Column) -> dict[str, Column]:
    """What the job needs from each ``.swift`` file."""
    low = F.lower(text)
    sign = F.when(contains_any(low, SERVER_SIGNS), "service").when(contains_any(low, APP_SIGNS), "frontend")
    return {"main": F.rlike(text, F.lit(r"@main\b")), "sign": sign}


def facts(files: DataFrame) -> DataFrame:
    """(repo, path, dir, main, sign) per ``.swift`` file."""
    return source_facts(files, "swift", fact_columns)


def _signals(code: DataFrame, folders: DataFrame) -> DataFrame:
    """(repo, root, main, …, first_kind) per source folder (repo, root).

    ``first_kind`` is what the first telling file, in path order, points to.
    """
    file = F.substring_index("path", "/", -1)
    told = under(code, folders.select("repo", "root").distinct())
    order = F.when(F.col("sign").isNotNull(), segments(F.col("path")))
    return told.groupBy("repo", "root").agg(
        F.bool_or(F.col("main")).alias("main"),
        F.bool_or((file == "main.swift") & (F.col("dir") == F.col("root"))).alias("main_file"),
        F.bool_or(file == "main.swift").alias("main_below"),
        F.min_by("sign", order).alias("first_kind"),
    )


def executable_kind(name: Column, first_kind: Column) -> Column:
    low = F.lower(name)
    return F.when(contains_any(low, SERVICE_NAMES), "service").otherwise(F.coalesce(first_kind, F.lit("cli")))


def _located(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``home`` (Sources/<target>) and whether it exists."""
    home = join_path(F.col("dir"), F.concat(F.lit("Sources/"), "target"))
    with_home = rows.withColumn("home", home)
    parts = segments(F.col("path"))
    folder = files.filter(F.contains("path", F.lit("Sources/"))).select("repo", parts.alias("p"))
    spots = F.filter(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.element_at("p", i) == "Sources")
    heads = folder.filter(F.size("p") >= 3).select("repo", F.explode(F.transform(spots, lambda i: F.array_join(F.slice("p", F.lit(1), i + 1), "/"))).alias("home")).distinct()
    return with_home.join(heads.withColumn("there", F.lit(True)), ["repo", "home"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def discover(files: DataFrame, mode: str = "segment") -> Inventory:
    found = manifests(files, FILE, mode).withColumn("package", F.coalesce(first_group(F.col("content"), PACKAGE_NAME), folder_name(F.col("dir"))))
    packages, _ = stage(found, "swift-packages")
    code, _ = stage(facts(files), "swift-facts")
    all_targets, _ = stage(targets(packages), "swift-targets")
    real = F.col("type") != "testTarget"
    shape = all_targets.groupBy("repo", "manifest_path").agg(F.count("*").alias("targets"), F.count_if(real).alias("real"))
    lib = F.lit("swift-package")

    # packages with targets: one component per target that is no test
    rows = _located(all_targets.filter(real).join(shape, ["repo", "manifest_path"]), files)
    rows = rows.join(_signals(code, rows.select("repo", F.col("home").alias("root"))).withColumnRenamed("root", "home"), ["repo", "home"], "left")
    rows, _ = stage(rows, "swift-rows")
    runs = (F.col("type") == "executableTarget") | (
        (F.col("type") == "target") & F.coalesce(F.col("main") | F.col("main_file"), F.lit(False))
    )
    kind = F.when(runs, executable_kind(F.col("target"), F.col("first_kind"))).otherwise("library")
    place = F.when(F.col("path").isNotNull(), join_path(F.col("dir"), F.col("path"))).when(F.col("there"), F.col("home")).otherwise(F.col("dir"))
    label = F.format_string("%09d", "pos")
    target_rows = component_rows(rows, FILE, name=F.col("target"), kind=kind, type=lib, root=place, rank=0, label=label)

    # packages without targets, classified by their own name and Sources folder
    bare = packages.join(shape.select("repo", "manifest_path"), ["repo", "manifest_path"], "left_anti").withColumn("own", folder_name(F.col("dir")))
    bare = bare.withColumn("root", join_path(F.col("dir"), F.lit("Sources"))).withColumn("own_root", F.concat_ws("/", "root", "own"))
    whole = _signals(code, bare).select("repo", "root", (F.col("main") | F.col("main_below")).alias("runs"))
    inner = _signals(code, bare.select("repo", F.col("own_root").alias("root"))).select("repo", F.col("root").alias("own_root"), "first_kind")
    bare = bare.join(whole, ["repo", "root"], "left").join(inner, ["repo", "own_root"], "left")
    bare_rows = component_rows(
        bare, FILE, name=F.col("package"), type=lib, root=F.col("dir"), rank=0,
        kind=F.when(F.coalesce("runs", F.lit(False)), executable_kind(F.col("own"), F.col("first_kind"))).otherwise("library"),
    )

    # several targets: a root component holds the external dependencies
    many = packages.join(shape.filter("real > 1").select("repo", "manifest_path"), ["repo", "manifest_path"], "left_semi")
    root_rows = component_rows(
        many, FILE, name=F.col("package"), kind=F.lit("library"), type=lib, root=F.col("dir"), rank=1, description=F.lit("Swift package root")
    )
    several = rows.filter("real <> 1").select("repo", "manifest_path", ckey(FILE, 0, label).alias("ckey"), "target", F.explode("deps").alias("dep"))
    known = all_targets.select("repo", "manifest_path", F.col("target").alias("dep")).distinct()
    inside = several.filter("dep <> target").join(known, ["repo", "manifest_path", "dep"], "left_semi").select("repo", "ckey", F.lit(0).alias("pos"), "dep")
    root_deps = rows.filter("real > 1").select("repo", ckey(FILE, 1, F.lit("")).alias("ckey"), "pos", F.col("target").alias("dep"))
    deps = inside.unionByName(root_deps)

    reqs = requirements(packages)
    single = rows.filter("real = 1").select("repo", "manifest_path", ckey(FILE, 0, label).alias("ckey"))
    holders = union([single, root_rows.select("repo", "manifest_path", "ckey"), bare_rows.select("repo", "manifest_path", "ckey")])
    external = reqs.join(holders, ["repo", "manifest_path"])
    return Inventory(
        union([target_rows, bare_rows, root_rows]), internal_rows(deps, F.col("dep"), F.col("pos")),
        external_rows(external, F.col("name"), F.col("version"), F.col("pos")),
    )
