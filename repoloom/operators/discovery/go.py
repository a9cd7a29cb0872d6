"""Go modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.paths import basename, segments
from repoloom.functions.text import all_groups, first_group, hit_mask, NEWLINE, strip
from repoloom.operators.discovery.common import (
    Inventory, component_rows, external_rows, flag, folder_name, folders_holding, internal_rows, manifests, source_facts, under, union,
)
from repoloom.runtime import stage

FILE = "go.mod"
# Top folders that are no packages.
SKIPPED = [
    "vendor", "testdata", "test", "tests", "docs", "scripts",
    "resources", "node_modules", ".git", "contracts", "rust",
    "venv", ".venv", "inabox", "tools", "subgraphs",
]
# Signs of a service (the repeated one counts twice) and of a CLI.
SERVICE_SIGNS = [
    "listenandserve", "grpc.newserver", "net.listen",
    "http.server", "gin.default", "echo.new", "fiber.new",
    "grpcserver", "startserver", "serve(", "runserver",
    "listener", ".start(", "httpserver", "grpcserver",
]
CLI_SIGNS = ["cobra.command", "pflag.", "kingpin.", "os.args"]
# Folder names that hint at a service or a CLI.
SERVICE_NAMES = [
    "server", "apiserver", "daemon", "node", "relay", "proxy",
    "batcher", "encoder", "controller", "worker", "agent",
    "indexer", "ejector", "retriever", "dataapi", "blobapi",
]
CLI_NAMES = ["cli", "tool", "util"]
NAME_BONUS = 2


def module_path(content: Column) -> Column:
    return strip(first_group(content, r"(?m)^\s*module +(\S.*)$"))


def requirements(mods: DataFrame) -> DataFrame:
    """(repo, manifest_path, pos, name, version) of direct requirements.

    Only ``require ( … )`` blocks count; indirect ones and modules that start
    with the first three parts of the own module path are left out.
    """
    block = all_groups(F.col("content"), r"(?ms)^\s*require \([^\n]*\n(.*?)(?:^\s*\)\s*$|\z)")
    rows = mods.select("repo", "manifest_path", "module", F.posexplode(F.split(F.array_join(block, "\n"), NEWLINE)).alias("pos", "line"))
    line = strip(F.col("line"))
    parts = F.split(line, r"\s+")
    base = F.array_join(F.slice(F.split("module", "/"), 1, 3), "/")
    kept = rows.filter(
        (line != "") & ~F.startswith(line, F.lit("//")) & ~F.contains(line, F.lit("// indirect")) & (F.size(parts) >= 2)
        & ~F.startswith(parts[0], base)
    )
    return kept.select("repo", "manifest_path", "pos", parts[0].alias("name"), parts[1].alias("version"))


def imported(content: Column) -> Column:
    """Distinct import paths of a source text, from blocks and single imports."""
    blocks = all_groups(content, r"(?s)import\s*\(\s*(.*?)\s*\)")
    inner = F.flatten(F.transform(blocks, lambda b: all_groups(b, r'(?m)^[^"\n]*"([^"\n]+)"')))
    return F.array_distinct(F.concat(inner, all_groups(content, r'import\s+"([^"]+)"')))


def fact_columns(text: Column) -> dict[str, Column]:
    """What the job needs from each ``.go`` file: two bit masks of signs, whether
    it is a main package, and its imports."""
    low = F.lower(text)
    return {"svc": hit_mask(low, SERVICE_SIGNS), "cli": hit_mask(low, CLI_SIGNS), "main": is_main(text), "imports": imported(text)}


def facts(files: DataFrame) -> DataFrame:
    return source_facts(files, "go", fact_columns).drop("path")


def executable_kinds(code: DataFrame, folders: DataFrame) -> DataFrame:
    """(repo, root, kind) for executable folders (repo, root), from the facts of
    all ``.go`` files below each."""
    per = under(code.select("repo", "dir", "svc", "cli"), folders.select("repo", "root").distinct()).groupBy("repo", "root").agg(F.bit_or("svc").alias("svc"), F.bit_or("cli").alias("cli"))
    name = F.lower(folder_name(F.col("root")))
    hint = lambda words: F.when(F.rlike(name, F.lit("|".join(words))), NAME_BONUS).otherwise(0)
    service = F.bit_count("svc") + hint(SERVICE_NAMES)
    cli = F.bit_count("cli") + hint(CLI_NAMES)
    kind = F.when(service > cli, "service").when(cli > 0, "cli").otherwise("service")
    return per.select("repo", "root", kind.alias("kind"))


def is_main(content: Column) -> Column:
    """Is the first code line ``package main``?"""
    code = F.filter(F.transform(F.split(content, NEWLINE), strip), lambda l: (l != "") & ~F.rlike(l, F.lit(r"^(?://|/\*)")))
    return F.rlike(F.coalesce(F.get(code, F.lit(0)), F.lit("")), F.lit(r"^package\s+main(?:\s|$)"))


def packages(files: DataFrame, mods: DataFrame) -> DataFrame:
    """(repo, manifest_path, module, pkg) of monorepos: a root module with more
    than one top folder of Go code."""
    path = F.col("path")
    parts = segments(path)
    code = files.filter(F.endswith(path, F.lit(".go")) & F.contains(path, F.lit("/"))).select("repo", "path", parts.alias("p"))
    tops = code.groupBy("repo", F.col("p")[0].alias("pkg")).agg(
        F.max(F.size("p") == 2).alias("flat"),
        F.max((F.size("p") == 3) & (F.element_at("p", -1) == "main.go")).alias("child_main"),
    )
    binaries_only = (F.col("pkg") == "cmd") & ~F.col("flat") & F.col("child_main")
    real = tops.filter(~F.startswith("pkg", F.lit(".")) & ~F.col("pkg").isin(SKIPPED) & ~binaries_only)
    many = real.groupBy("repo").agg(F.count("*").alias("n")).filter("n > 1").select("repo")
    roots = mods.filter("dir = ''").select("repo", "manifest_path", "module")
    return real.select("repo", "pkg").join(many, "repo", "left_semi").join(roots, "repo")


def binaries(files: DataFrame, pkgs: DataFrame) -> DataFrame:
    """(repo, manifest_path, module, name, parent, root, rank) of ``cmd/<x>/main.go``
    in monorepos; of equal names the first in path order wins, packages before all."""
    pattern = r"^(?:(.*)/)?cmd/([^/]+)/main\.go$"
    mains = files.filter(F.rlike("path", F.lit(pattern))).select(
        "repo", F.regexp_replace("path", "/main\\.go$", "").alias("root"),
        F.regexp_extract("path", pattern, 1).alias("above"), F.regexp_extract("path", pattern, 2).alias("x"),
    )
    repos = pkgs.select("repo", "manifest_path", "module").distinct()
    at_top = mains.filter("above = ''").join(repos, "repo").select(
        "repo", "manifest_path", "module", F.col("x").alias("name"), F.lit("").alias("parent"), "root", F.lit(1).alias("rank")
    )
    parent = F.substring_index("above", "/", 1)
    same = (F.col("x") == F.col("pkg")) | (F.col("x") == "main")
    inside = mains.filter("above <> ''").withColumn("pkg", parent).join(pkgs, ["repo", "pkg"]).select(
        "repo", "manifest_path", "module", F.when(same, F.col("pkg")).otherwise(F.concat("pkg", F.lit("-"), "x")).alias("name"),
        F.col("pkg").alias("parent"), "root", F.lit(2).alias("rank"),
    )
    free = at_top.unionByName(inside).join(pkgs.select("repo", F.col("pkg").alias("name")), ["repo", "name"], "left_anti")
    order = F.struct("rank", segments(F.col("root")))
    row = F.struct("manifest_path", "module", "parent", "root", "rank")
    return free.groupBy("repo", "name").agg(F.min_by(row, order).alias("_r")).select("repo", "name", "_r.*")


def _monorepos(files: DataFrame, code: DataFrame, pkgs: DataFrame) -> Inventory:
    bins, _ = stage(binaries(files, pkgs), "go-binaries")
    kinds, _ = stage(executable_kinds(code, bins), "go-binary-kinds")
    lib = F.lit("go-module")
    pkg_rows = component_rows(
        pkgs, FILE, name=F.col("pkg"), kind=F.lit("library"), type=lib, root=F.col("pkg"), rank=1, label=F.col("pkg")
    )
    with_kind = bins.join(kinds, ["repo", "root"], "left")
    bin_rows = component_rows(
        with_kind, FILE, name=F.col("name"), kind=F.coalesce("kind", F.lit("service")), type=lib, root=F.col("root"),
        rank=2, label=F.col("root"), order=F.concat(F.array(F.col("rank").cast("string")), segments(F.col("root"))),
    )
    # top package of every import below the own module, per source file
    used = code.select("repo", "dir", "imports").filter(F.size("imports") > 0)
    modules = pkgs.select("repo", "module").distinct()
    tops = F.array_distinct(F.transform(
        F.filter("imports", lambda i: F.startswith(i, F.concat("module", F.lit("/")))),
        lambda i: F.split_part(F.substr(i, F.length("module") + 2), F.lit("/"), F.lit(1)),
    ))
    arcs = used.join(modules, "repo").select("repo", "dir", F.explode(tops).alias("dep")).distinct()
    arcs = arcs.join(pkgs.select("repo", F.col("pkg").alias("dep")), ["repo", "dep"], "left_semi")
    owners = pkg_rows.select("repo", F.col("root_path").alias("root"), "ckey", F.col("name").alias("own")).unionByName(
        bin_rows.select("repo", F.col("root_path").alias("root"), "ckey", F.lit("").alias("own"))
    )
    edges = under(arcs, owners).filter("dep <> own").select("repo", "ckey", "dep")
    parents = bin_rows.select("repo", "ckey", F.col("root_path").alias("root")).join(bins.select("repo", "root", "parent"), ["repo", "root"]).filter("parent <> ''")
    deps = edges.unionByName(parents.select("repo", "ckey", F.col("parent").alias("dep"))).distinct()
    return Inventory(pkg_rows.unionByName(bin_rows), internal_rows(deps, F.col("dep")), None)


def _single_modules(files: DataFrame, code: DataFrame, mods: DataFrame) -> Inventory:
    own = mods.select("repo", "manifest_path", "dir", "module")
    direct = folders_holding(files, ["main.go"])
    # every folder that holds a cmd folder
    below_cmd = files.filter(F.rlike("path", F.lit("(?:^|/)cmd/"))).select("repo", segments(F.col("path")).alias("p"))
    spots = F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.element_at("p", i) == "cmd")
    with_cmd = below_cmd.select("repo", F.explode(F.transform(spots, lambda i: F.array_join(F.slice("p", F.lit(1), i - 1), "/"))).alias("dir")).distinct()
    mains = code.filter("main").select("repo", "dir").distinct()
    marked = flag(flag(flag(own, direct, ["repo", "dir"], "has_main"), with_cmd, ["repo", "dir"], "has_cmd"), mains, ["repo", "dir"], "main_package")
    runs = F.col("has_main") | (~F.col("has_cmd") & F.col("main_package"))

    cmd = files.filter(F.rlike("path", F.lit(r"(?:^|/)cmd/[^/]+/main\.go$"))).select(
        "repo", F.regexp_replace("path", "/main\\.go$", "").alias("root"), F.regexp_extract("path", r"^(?:(.*)/)?cmd/[^/]+/main\.go$", 1).alias("dir"),
    ).join(own, ["repo", "dir"])
    folders = marked.filter(runs).select("repo", F.col("dir").alias("root")).unionByName(cmd.select("repo", "root"))
    kinds, _ = stage(executable_kinds(code, folders), "go-kinds")
    short = F.substring_index("module", "/", -1)
    first = marked.join(kinds.withColumnRenamed("root", "dir"), ["repo", "dir"], "left")
    lib = F.lit("go-module")
    rows = component_rows(
        first, FILE, name=short, kind=F.when(runs, F.coalesce("kind", F.lit("service"))).otherwise("library"), type=lib, root=F.col("dir")
    )
    cmd_rows = component_rows(
        cmd.join(kinds, ["repo", "root"], "left"), FILE, name=basename(F.col("root")), kind=F.coalesce("kind", F.lit("service")), type=lib,
        root=F.col("root"), rank=1, label=basename(F.col("root")),
    )
    deps = cmd_rows.join(own.select("repo", "manifest_path", short.alias("dep")), ["repo", "manifest_path"])
    reqs = requirements(mods).join(rows.select("repo", "manifest_path", "ckey"), ["repo", "manifest_path"])
    external = external_rows(reqs, F.col("name"), F.col("version"), F.col("pos"))
    return Inventory(rows.unionByName(cmd_rows), internal_rows(deps, F.col("dep")), external)


def discover(files: DataFrame, mode: str = "segment") -> Inventory:
    found = manifests(files, FILE, mode).withColumn("module", module_path(F.col("content"))).filter("module is not null")
    mods, _ = stage(found, "go-modules")
    code, _ = stage(facts(files), "go-facts")
    pkgs, _ = stage(packages(files, mods), "go-packages")
    split = pkgs.select("repo", "manifest_path").distinct()
    mono = _monorepos(files, code, pkgs)
    single = _single_modules(files, code, mods.join(split, ["repo", "manifest_path"], "left_anti"))
    return Inventory(
        union([mono.components, single.components]), union([mono.internal, single.internal]), single.external
    )
