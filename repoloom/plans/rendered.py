"""Repositories rendered from the test tables, as (repo, path, content).

The oracle of a query reads the tables; only the operator sees the text. Texts
are gathered per component, as a manifest is one cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repoloom.plans.bindings import view
from repoloom.runtime import stage

NL = "\n"
_WRITTEN: dict[tuple, DataFrame] = {}


def written(build):
    """Write a rendered corpus once per application and data folder."""

    def get(spark: SparkSession) -> DataFrame:
        key = (spark.sparkContext.applicationId, spark.conf.get("repoloom.tables"), build.__name__)
        if key not in _WRITTEN:
            _WRITTEN[key] = stage(build(spark), build.__name__)[0]
        return _WRITTEN[key]

    return get


def _files(df: DataFrame, path: Column, content: Column | str) -> DataFrame:
    body = F.lit(content) if isinstance(content, str) else content
    return df.select("repo", path.alias("path"), body.alias("content"))


def _at(name: str, folder: str = "root_path") -> Column:
    return F.concat(F.col(folder), F.lit("/" + name))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


@written
def components(spark: SparkSession) -> DataFrame:
    """Components with ``deps`` (names) and ``exts`` (service ids) arrays."""
    sets = lambda v, out: view(spark, v).groupBy("repo", F.col("source").alias("name")).agg(F.array_sort(F.collect_set("target")).alias(out))
    none = F.array().cast("array<string>")
    c = view(spark, "e_components").join(sets("e_edges", "deps"), ["repo", "name"], "left").join(sets("e_integrations", "exts"), ["repo", "name"], "left")
    return c.withColumn("deps", F.coalesce("deps", none)).withColumn("exts", F.coalesce("exts", none))


def of_kind(c: DataFrame, *kinds: str) -> DataFrame:
    return c.filter(F.col("kind").isin(*kinds))


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), NL)


def repos(spark: SparkSession) -> DataFrame:
    return view(spark, "e_components").select("repo").distinct()


@written
def npm(spark: SparkSession) -> DataFrame:
    c = components(spark)
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    marker = F.when(F.col("kind") == "service", F.array(pair(F.lit("express"), F.lit("^4.0.0")))).when(
        F.col("kind") == "frontend", F.array(pair(F.lit("react"), F.lit("^18.0.0")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    deps = F.map_from_entries(F.concat(
        F.transform("deps", lambda d: pair(d, F.lit("workspace:*"))), F.transform("exts", lambda d: pair(d, F.concat(F.lit("^1.0."), F.substr(d, F.lit(2))))), marker))
    script = F.when(F.col("kind") == "service", F.create_map(F.lit("start"), F.lit("node ."))).when(
        F.col("kind") == "contract", F.create_map(F.lit("serve"), F.lit("node ."))).otherwise(F.create_map().cast("map<string,string>"))
    doc = F.to_json(F.struct(
        "name", F.concat(F.lit("Package "), "name").alias("description"), F.when(F.col("kind") == "cli", F.lit("./cli.js")).alias("bin"),
        F.when(F.col("kind") == "contract", F.lit("index.js")).alias("main"), deps.alias("dependencies"), script.alias("scripts"),
    ))
    root = '{"name": "root", "private": true, "workspaces": {"packages": ["economy/*", "./medium/c*/", "standard/*"]}}'
    r = repos(spark)
    return _all([
        _files(c, _at("package.json"), doc), _files(of_kind(c, "pipeline"), _at("wrangler.toml"), ""),
        _files(c.filter("type = 'typescript-package'"), _at("tsconfig.json"), "{}"),
        _files(c.filter("type = 'python-package'"), _at("src/lib/a.ts"), "export {}"),
        _files(r, F.lit("package.json"), root), _files(r, F.lit("broken/package.json"), "{ nope"),
        _files(r, F.lit("node_modules/x/package.json"), '{"name": "vendored"}'),
    ])


@written
def go_modules(spark: SparkSession) -> DataFrame:
    c = components(spark)
    mod = F.concat(F.lit("// module file\nmodule example.org/estate/"), "name", F.lit("\n\ngo 1.21\n\nrequire (\n"),
        _lines(F.col("exts"), lambda s: F.concat(F.lit("\tvendor.dev/"), s, F.lit(" v1.0."), F.substr(s, F.lit(2)))),
        F.lit("\n\tvendor.dev/far v0.1.0 // indirect\n\texample.org/estate/"), "name", F.lit("/sub v0.0.1\n)\n\nrequire golang.org/one v1.0.0\n"))
    return _all([
        _files(c, _at("go.mod"), mod),
        _files(of_kind(c, "service"), _at("main.go"), "package main\n\nfunc main() { s := grpc.NewServer() }\n"),
        _files(of_kind(c, "cli"), _at("main.go"), "package main\n\nvar cmd = &cobra.Command{}\n"),
        _files(of_kind(c, "cli"), _at("flags/f.go"), "package flags\n\n// pflag. and http.Server\n"),
        _files(of_kind(c, "frontend"), _at("cmd/run/main.go"), "package main\n"),
        _files(of_kind(c, "pipeline"), _at("job.go"), "// Copyright\n\n/* x */\npackage main\n\nvar a = os.Args\n"),
        _files(of_kind(c, "contract"), _at("lib.go"), "package lib\n\n// ListenAndServe\n"),
        _files(c, _at("vendor/x/go.mod"), "module vendored.dev/x\n"),
    ])


@written
def go_mono(spark: SparkSession) -> DataFrame:
    c = components(spark)
    folder = lambda tail: F.concat("name", F.lit(tail))
    code = F.concat(F.lit("package p\n\nimport (\n\t\"fmt\"\n"), _lines(F.col("deps"), lambda d: F.concat(F.lit('\tx "example.org/mono/'), d, F.lit('/sub"'))),
        F.lit("\n)\n\nimport \"example.org/mono/"), "name", F.lit("/own\"\n"))
    r = repos(spark)
    return _all([
        _files(r, F.lit("go.mod"), "module example.org/mono\n"), _files(c, folder("/a/code.go"), code),
        _files(of_kind(c, "service"), folder("/cmd/apiserver/main.go"), "package main\n\nimport \"example.org/mono/missing/x\"\n"),
        _files(of_kind(c, "cli"), folder("/tool/cmd/main/main.go"), "package main\n"),
        _files(r, F.lit("cmd/sometool/main.go"), "package main\n"), _files(r, F.lit("vendor/x.go"), "package x\n"), _files(r, F.lit(".hidden/x.go"), "package x\n"),
    ])


@written
def python_mono(spark: SparkSession) -> DataFrame:
    c = components(spark)
    folder = lambda tail: F.concat(F.lit("src/my_proj/"), "name", F.lit(tail))
    line = lambda d: F.when(F.endswith(d, F.lit("7")), F.concat(F.lit("from .."), d, F.lit(" import y"))).otherwise(F.concat(F.lit("from my_proj."), d, F.lit(".mod import ("), F.lit("\n    x,\n)")))
    use = F.when(F.col("kind") == "service", "from fastapi import FastAPI\napp = FastAPI()\n").when(F.col("kind") == "cli", "import click\n\n@click.command()\ndef main(): pass\n") \
        .when(F.col("kind") == "pipeline", "import airflow.models\n").when(F.col("kind") == "frontend", "import dash\n").otherwise("import dashboard\n# import my_proj.c1\n'''\nimport my_proj.c2\n'''\n")
    r = repos(spark)
    manifest = ('[project]\nname = "my-proj"\ndescription = "All of it"\ndependencies = [\n    "requests>=2.0",\n    # "none",\n'
                '    "uvicorn[standard]>=0.1", "attrs",\n]\n\n[project.scripts]\nrun = "my_proj:main"\n')
    return _all([
        _files(r, F.lit("pyproject.toml"), manifest), _files(r, F.lit("src/my_proj/__init__.py"), ""),
        _files(r, F.lit("src/my_proj/tests/__init__.py"), ""), _files(r, F.lit("src/my_proj/tests/a.py"), ""),
        _files(r, F.lit("src/my_proj/thin/__init__.py"), ""), _files(r, F.lit("broken/syntax.py"), "import ("),
        _files(c, folder("/__init__.py"), "from . import mod\n"), _files(c, folder("/mod.py"), F.concat(use, _lines(F.col("deps"), line), F.lit("\n"))),
    ])


@written
def python_projects(spark: SparkSession) -> DataFrame:
    c = components(spark)
    head = F.concat(F.lit('name = "'), "name", F.lit('"\n'))
    quoted = F.concat(F.lit("[project]\n"), head, F.lit("dependencies = [\n"), _lines(F.col("exts"), lambda s: F.concat(F.lit('  "'), s, F.lit('>=1.0",'))), F.lit("\n]\n"))
    poetry = F.concat(F.lit("[tool.poetry]\n"), head, F.lit('[tool.poetry.dependencies]\npython = "^3.10"\n'), _lines(F.col("exts"), lambda s: F.concat(s, F.lit(' = "^1.0"'))), F.lit("\n"))
    paths = F.concat(F.lit("\n[tool.sources]\n"), _lines(F.col("deps"), lambda d: F.concat(d, F.lit(' = { path = "../'), d, F.lit('" }'))), F.lit("\n"))
    extra = F.when(F.col("kind") == "service", "[project.scripts]\na = 'flask'\n").when(F.col("kind") == "cli", "[project.scripts]\na = 'b'\n") \
        .when(F.col("kind") == "pipeline", "# dagster\n").when(F.col("kind") == "frontend", "[project.gui-scripts]\n").otherwise("")
    text = F.concat(F.when(F.col("type") == "python-package", poetry).otherwise(quoted), paths, extra)
    return _all([
        _files(c, _at("pyproject.toml"), text), _files(of_kind(c, "contract"), _at("pkg/__main__.py"), ""), _files(c, _at("setup.py"), ""),
        _files(c, _at("venv/lib/pyproject.toml"), '[project]\nname = "vendored"\n'),
    ])


@written
def cargo(spark: SparkSession) -> DataFrame:
    c = components(spark)
    ext = lambda s: F.when(F.endswith(s, F.lit("3")), F.concat(s, F.lit(' = { version = "1.3", features = ["a"] }'))).otherwise(F.concat(s, F.lit(' = "1.0"')))
    local = lambda d: F.concat(d, F.lit(' = { path = "../'), d, F.lit('" }'))
    kind = F.col("kind")
    bins = F.when(kind == "frontend", '\n[[bin]]\nname = "cargo-x"\n').when(kind == "pipeline", F.concat(F.lit('\n[[bin]]\nname = "'), "name", F.lit('"\n'))).otherwise("")
    text = F.concat(
        F.lit('[package]\nname = "'), "name", F.lit('"\ndescription = "crate"\n\n[dependencies]\n'), _lines(F.col("exts"), ext),
        F.when(kind == "service", "\naxum = '0.7'\n").otherwise("\n"), F.lit("\n[target.'cfg(unix)'.dependencies]\nnix = \"0.2\"\n\n[dev-dependencies]\nmock = \"1\"\n"),
        _lines(F.col("deps"), local), bins, F.lit("\n"),
    )
    root = '[workspace]\nmembers = [\n  "economy/*",  # services\n  "standard/c?",\n  "medium/c1*"\n]\n'
    r = repos(spark)
    return _all([
        _files(c, _at("Cargo.toml"), text), _files(of_kind(c, "service", "cli"), _at("src/main.rs"), "fn main() {}"),
        _files(of_kind(c, "pipeline", "frontend", "library"), _at("src/lib.rs"), ""), _files(r, F.lit("Cargo.toml"), root),
        _files(c, _at("target/Cargo.toml"), '[package]\nname = "built"\n'),
    ])


@written
def foundry(spark: SparkSession) -> DataFrame:
    c = components(spark)
    r = repos(spark)
    line = lambda d: F.when(F.endswith(d, F.lit("7")), F.concat(F.lit('import {X} from "src/'), d, F.lit('/B.sol";'))).otherwise(F.concat(F.lit('import "@in/'), d, F.lit('/A.sol";')))
    decl = F.when(F.col("kind") == "library", "library L {}\nlibrary M {}\n").when(F.col("kind") == "service", "interface I {}\n").otherwise("abstract contract A {}\ncontract B is A {}\n")
    code = F.concat(F.lit("pragma solidity ^0.8.20;\nimport \"lib/x/Y.sol\";\nimport './Near.sol';\n"), _lines(F.col("deps"), line), F.lit("\n"), decl)
    libs = view(spark, "e_integrations").select("repo", F.col("target").alias("lib")).distinct()
    hard = r.withColumn("repo", F.concat(F.lit("hh-"), "repo"))
    return _all([
        _files(r, F.lit("foundry.toml"), 'libs = ["lib"]\nsrc = "src"\nremappings = [\n  "@in/=src/",\n  "@in/x=no/"\n]\n'),
        _files(c, F.concat(F.lit("src/"), "name", F.lit("/A.sol")), code),
        _files(libs, F.concat(F.lit("lib/"), "lib", F.lit("/src/Z.sol")), "contract Z {}"), _files(libs, F.concat(F.lit("lib/"), "lib", F.lit("/foundry.toml")), ""),
        _files(hard, F.lit("hardhat.config.ts"), "export default {}"), _files(hard, F.lit("contracts/Token.sol"), "contract Token {}\ninterface T {}\n"),
        _files(hard, F.lit("package.json"), '{"dependencies": {"@openzeppelin/contracts": "^5", "lodash": "1", "ethers": "6"}}'),
    ])


@written
def swift_packages(spark: SparkSession) -> DataFrame:
    c = components(spark)
    kind = F.col("kind")
    urls = _lines(F.col("exts"), lambda s: F.concat(F.lit('    .package(url: "https://github.com/o/'), s, F.when(F.endswith(s, F.lit("3")), '.git", exact: "2.0.0"),').otherwise('", from: "1.2.0"),')))
    first = F.when(kind == "cli", ".executableTarget").otherwise(".target")
    # libraries have one target besides the tests, pipelines declare none
    second = F.when(kind == "library", "").otherwise(F.concat(F.lit('    .target(name: "'), "name", F.lit('Kit", dependencies: [\n      .product(name: "Vapor", package: "vapor"), .product(name: "NIO", package: "nio", condition: .when(platforms: [.linux])),\n      .target(name: "'), "name",
        F.lit('")], path: "Lib/Kit", swiftSettings: [.define("X", .when(configuration: .debug))]),\n')))
    body = F.when(kind == "pipeline", "").otherwise(F.concat(
        F.lit("    "), first, F.lit('(name: "'), "name", F.lit('"'), F.when(kind == "frontend", ', path: "App/Main"').otherwise(""), F.lit("),\n"), second,
        F.lit('    .testTarget(name: "'), "name", F.lit('Tests", dependencies: ["'), "name", F.lit('"]),\n')))
    text = F.concat(F.lit('import PackageDescription\nlet package = Package(\n  name: "Pkg'), "name", F.lit('",\n  dependencies: [\n'), urls, F.lit("\n  ],\n  targets: [\n"), body, F.lit("  ])\n"))
    src = lambda tail: F.concat("root_path", F.lit("/Sources/"), "name", F.lit(tail))
    return _all([
        _files(c, _at("Package.swift"), text), _files(of_kind(c, "service"), src("/main.swift"), "import Vapor\n"),
        _files(of_kind(c, "contract"), src("/App.swift"), "import SwiftUI\n@main struct App {}\n"), _files(of_kind(c, "library"), src("/Lib.swift"), "struct L {}\n"),
        _files(of_kind(c, "pipeline"), src("/Run.swift"), "@main\nfinal class Run {}\n"), _files(c, _at(".build/x/Package.swift"), 'let package = Package(name: "built")'),
    ])
