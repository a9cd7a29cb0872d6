"""Ecosystem jobs on small trees; each repository is one case."""

from __future__ import annotations

from pyspark.sql import DataFrameWriter, functions as F

from repoloom.operators import discovery
from repoloom.operators.discovery import go, python, rust, solidity, swift, typescript
from repoloom.operators.discovery.common import Inventory, component_rows, internal_rows, manifests, no_external
from tests.conftest import by_repo


def kinds(inv):
    return by_repo(inv.components.collect(), "name", "kind")


def roots(inv):
    return by_repo(inv.components.collect(), "name", "root_path")


def named(inv, table):
    owner = inv.components.select("repo", "ckey", F.col("name").alias("owner"))
    return table.join(owner, ["repo", "ckey"]).collect()


def links(inv):
    out: dict = {}
    for r in named(inv, inv.internal):
        out.setdefault(r.repo, set()).add((r.owner, r.dep))
    return out


def externals(inv):
    return {(r.repo, r.owner, r.name): r.version for r in named(inv, inv.external)}


def test_go(tree):
    inv = go.discover(tree({
        "lib": {"go.mod": "module example.com/org/lib\n\nrequire (\n\tgithub.com/a/testify v1.8.0\n\tgithub.com/b/gin v1.9.1\n\tx.org/sync v0.1.0 // indirect\n"
                          "\texample.com/org/lib/sub v0.0.1\n)\nrequire single.org/x v1\n", "a.go": "package lib"},
        "svc": {"go.mod": "module m/svc", "main.go": "package main\nfunc main() { http.ListenAndServe() }"},
        "tool": {"go.mod": "module m/tool", "main.go": "package main\n// cobra.Command"},
        "plain": {"go.mod": "module m/plain", "x.go": "// doc\npackage main\n"},
        "cmds": {"go.mod": "module m/cmds", "cmd/serverd/main.go": "package main", "cmd/docs/readme.md": ""},
        "none": {"go.mod": "go 1.21\n", "a.go": "package a"},
        "mono": {
            "go.mod": "module example.com/mono", "common/a.go": "package common",
            "api/b.go": 'package api\nimport (\n\t"fmt"\n\tc "example.com/mono/common/aws"\n)\n',
            "api/cmd/api/main.go": "package main", "api/cmd/extra/main.go": 'package main\nimport "example.com/mono/common"\n',
            "cmd/common/main.go": "package main", "cmd/batcher/main.go": "package main", "tests/t.go": "package tests", ".x/y.go": "package y",
        },
        "vendored": {"vendor/q/go.mod": "module q", "go.mod": "module m/top", "k.go": "package k"},
    }))
    k = kinds(inv)
    assert k["lib"] == {"lib": "library"} and k["svc"] == {"svc": "service"} and k["tool"] == {"tool": "cli"}
    assert k["plain"] == {"plain": "service"} and "none" not in k
    assert k["cmds"] == {"cmds": "library", "serverd": "service"}
    assert k["mono"] == {"common": "library", "api": "library", "api-extra": "service", "batcher": "service"}
    assert k["vendored"] == {"top": "library"}
    ext = externals(inv)
    assert {n for (r, _, n) in ext if r == "lib"} == {"github.com/a/testify", "github.com/b/gin"}
    assert ext[("lib", "lib", "github.com/b/gin")] == "v1.9.1"
    arcs = links(inv)
    assert arcs["cmds"] == {("serverd", "cmds")}
    assert arcs["mono"] == {("api", "common"), ("api-extra", "common"), ("api-extra", "api")}
    assert roots(inv)["mono"]["api-extra"] == "api/cmd/extra"


def test_python(tree):
    project = '[project]\nname = "{0}"\ndescription = "d"\ndependencies = [\n  "requests[security]>=2.0",\n  # "no",\n  "attrs", "six==1"\n]\n'
    inv = python.discover(tree({
        "deps": {"pyproject.toml": project.format("my-lib") + "[tool.x]\nother = {path = \"../other\"}\n"},
        "poetry": {"pyproject.toml": '[tool.poetry]\nname = "p"\n[tool.poetry.dependencies]\npython = "^3.9"\nclick = "^8.0"\n'},
        "cli": {"pyproject.toml": project.format("c") + "[project.scripts]\nc = 'c:main'\n"},
        "service": {"pyproject.toml": project.format("s") + "# fastapi\n", "pkg/__main__.py": ""},
        "hidden": {"pyproject.toml": project.format("h"), ".pkg/__main__.py": ""},
        "pipe": {"pyproject.toml": project.format("a") + "# airflow\n"},
        "unnamed": {"pkg/pyproject.toml": "[build-system]\n", "venv/x/pyproject.toml": project.format("v"), "setup.py": "setup()"},
        "mono": {
            "pyproject.toml": project.format("om-lx"), "om_lx/__init__.py": "", "om_lx/cli.py": "",
            "om_lx/engine/__init__.py": "from .core import run\n", "om_lx/engine/core.py": "import argparse\nfrom om_lx.cache import x\nargparse.ArgumentParser()\n",
            "om_lx/api/__init__.py": "from ..engine import core\n", "om_lx/api/routes.py": "from fastapi import FastAPI\napp = FastAPI()\nfrom om_lx import cache\n",
            "om_lx/cache/__init__.py": "# from om_lx.api import x\n'''\nimport om_lx.api\n'''\n", "om_lx/cache/store.py": "import dashboard\n",
            "om_lx/tests/__init__.py": "", "om_lx/tests/t.py": "", "om_lx/thin/__init__.py": "", "om_lx/_private/__init__.py": "", "om_lx/_private/x.py": "",
            "om_lx/engine/bad.py": "import (",
        },
        "few": {"pyproject.toml": project.format("few"), "few/__init__.py": "", "few/a/__init__.py": "", "few/a/b.py": ""},
    }))
    k = kinds(inv)
    assert {r: v for r, v in k.items() if r not in ("mono",)} == {
        "deps": {"my-lib": "library"}, "poetry": {"p": "library"}, "cli": {"c": "cli"}, "service": {"s": "service"},
        "hidden": {"h": "library"}, "pipe": {"a": "pipeline"}, "unnamed": {"pkg": "library"}, "few": {"few": "library"},
    }
    assert k["mono"] == {"om-lx": "library", "engine": "cli", "api": "service", "cache": "library"}
    ext = externals(inv)
    assert ext[("deps", "my-lib", "requests")] == ">=2.0" and ext[("deps", "my-lib", "six")] == "==1" and ext[("deps", "my-lib", "attrs")] == ""
    assert ext[("poetry", "p", "click")] == "^8.0" and ("poetry", "p", "python") not in ext
    arcs = links(inv)
    assert arcs["deps"] == {("my-lib", "other")}
    assert arcs["mono"] == {("om-lx", s) for s in ("engine", "api", "cache")} | {("engine", "cache"), ("api", "engine")}
    meta = {(r.repo, r.value) for r in inv.metadata.collect()}
    assert ("mono", "om-lx") in meta


def test_typescript(tree):
    inv = typescript.discover(tree({
        "cli": {"package.json": '{"name": "c", "bin": {"c": "x.js"}}', "tsconfig.json": ""},
        "front": {"package.json": '{"name": "f", "devDependencies": {"react": "1"}, "dependencies": {"x": "file:../x", "y": "2"}, "peerDependencies": {"z": "workspace:*"}}', "src/deep/a.ts": ""},
        "server": {"package.json": '{"name": "s", "dependencies": {"express": "4"}, "main": "i.js"}'},
        "idle": {"package.json": '{"name": "i", "dependencies": {"express": "4"}}'},
        "worker": {"package.json": '{"name": "w"}', "wrangler.jsonc": ""},
        "space": {
            "package.json": '{"name": "root", "private": true, "workspaces": ["packages/*"]}', "packages/a/package.json": "{}",
            "packages/b/package.json": '{"name": "b", "dependencies": {"a": "link:../a"}}', "packages/a/dist/package.json": '{"name": "built"}', "bad/package.json": "{", "list/package.json": "[1]",
        },
    }))
    k = kinds(inv)
    assert k == {
        "cli": {"c": "cli"}, "front": {"f": "frontend"}, "server": {"s": "service"}, "idle": {"i": "library"}, "worker": {"w": "service"},
        "space": {"a": "library", "b": "library"},
    }
    types = by_repo(inv.components.collect(), "name", "type")
    assert types["cli"]["c"] == types["front"]["f"] == "typescript-package" and types["server"]["s"] == "javascript-package"
    order = [r.dep for r in sorted(named(inv, inv.internal), key=lambda r: r.pos) if r.repo == "front"]
    assert order == ["x", "z"] and externals(inv)[("front", "f", "y")] == "2"


def test_rust(tree):
    package = '[package]\nname = "{0}"\ndescription = "d"\n'
    files = tree({
        "lib": {"Cargo.toml": package.format("l") + '[dependencies]\nserde = { version = "1.0", features = ["a"] }\nlog = "0.4"\nown = { path = "../own" }\n'
                              '[dev-dependencies]\nmock = "1"\nhelp = { path = "../help" }\n[target.\'cfg(unix)\'.dependencies]\nnix = "0.2"\nlog = "9"\n', "src/lib.rs": ""},
        "svc": {"Cargo.toml": package.format("s") + '[dependencies]\naxum = "0.7"\n', "src/main.rs": ""},
        "named": {"Cargo.toml": package.format("my-node"), "src/main.rs": ""},
        "bare": {"Cargo.toml": package.format("bare"), "src/main.rs": ""},
        "hybrid": {"Cargo.toml": package.format("h") + '[[bin]]\nname = "cargo-h"\n', "src/lib.rs": ""},
        "harness": {"Cargo.toml": package.format("h") + '[[bin]]\nname = "h"\n', "src/lib.rs": ""},
        "space": {"Cargo.toml": '[workspace]\nmembers = ["crates/*", "tools/x"]\n', "crates/a/Cargo.toml": package.format("a"),
                  "crates/a/target/Cargo.toml": package.format("t"), "tools/x/Cargo.toml": package.format("x"), "crates/a/deep/Cargo.toml": package.format("deep")},
    })
    inv = rust.discover(files)
    k = kinds(inv)
    assert k["lib"] == {"l": "library"} and k["svc"] == {"s": "service"} and k["named"] == {"my-node": "service"} and k["bare"] == {"bare": "cli"}
    assert k["hybrid"] == {"h": "cli"} and k["harness"] == {"h": "library"} and set(k["space"]) == {"a", "x", "deep"}
    assert {n: v for (r, _, n), v in externals(inv).items() if r == "lib"} == {"serde": "1.0", "log": "0.4", "nix": "0.2"}
    assert links(inv)["lib"] == {("l", "own"), ("l", "help")}
    assert {r.manifest_path for r in rust.members(files).collect()} == {"crates/a/Cargo.toml", "tools/x/Cargo.toml"}


def test_solidity(tree):
    inv = solidity.discover(tree({
        "flat": {"foundry.toml": "[profile.default]\n", "src/A.sol": "pragma solidity 0.8.1;\nlibrary L {}\n", "lib/oz/src/B.sol": "contract B {}", "lib/oz/foundry.toml": ""},
        "many": {"foundry.toml": 'src = "contracts"\nremappings = [\n  "@c/=contracts/",\n]\n', "contracts/core/A.sol": "contract A {}\ninterface I {}\n",
                 "contracts/util/U.sol": 'pragma solidity ^0.8.0;\nimport "src/core/A.sol";\nimport {X} from "core/A.sol";\nimport "./V.sol";\nlibrary U {}\n', "contracts/empty/readme.md": ""},
        "nosrc": {"foundry.toml": ""},
        "hat": {"hardhat.config.js": "", "contracts/T.sol": "contract T {}", "package.json": '{"dependencies": {"ethers": "6", "left": "1"}}'},
    }))
    k = kinds(inv)
    assert k == {"flat": {"flat-contracts": "library"}, "many": {"core": "contract", "util": "library", "many-contracts": "contract"}, "hat": {"hat-contracts": "contract"}}
    assert links(inv)["many"] == {("util", "core"), ("many-contracts", "core"), ("many-contracts", "util")}
    assert set(externals(inv)) == {("flat", "flat-contracts", "oz"), ("hat", "hat-contracts", "ethers")}
    meta = {(r.repo, r.key): r.value for r in inv.metadata.collect()}
    assert meta[("flat", "solidity_version")] == "0.8.1" and meta[("flat", "declarations.library")] == "1" and meta[("hat", "framework")] == "hardhat"


def test_swift(tree):
    manifest = 'let package = Package(\n  name: "{0}",\n  dependencies: [{1}],\n  targets: [{2}]\n)\n'
    url = '.package(url: "https://github.com/o/{0}", {1}),'
    inv = swift.discover(tree({
        "multi": {"Package.swift": manifest.format("Multi", url.format("digit.git", 'from: "1.2.0"'),
                                                   '.target(name: "Core"), .executableTarget(name: "ApiServer", dependencies: ["Core", "Vapor"]), .testTarget(name: "CoreTests", dependencies: ["Core"]),'),
                  "Sources/Core/c.swift": ""},
        "single": {"Package.swift": manifest.format("S", url.format("x", 'exact: "2.0.0"') + url.format("y", 'branch: "main"'), '.target(name: "Only", path: "Lib")')},
        "bare": {"Package.swift": manifest.format("Bare", "", ""), "Sources/bare/main.swift": "print(1)"},
        "quiet": {"Package.swift": manifest.format("Quiet", "", "")},
        "app": {"Package.swift": manifest.format("App", "", '.target(name: "Ui")'), "Sources/Ui/a.swift": "import SwiftUI\n@main struct X {}"},
        "cli": {"Package.swift": manifest.format("C", "", '.target(name: "Run")'), "Sources/Run/main.swift": "1"},
        "nested": {"Package.swift": manifest.format("N", "", '.target(name: "Core", swiftSettings: [.define("A", .when(configuration: .debug))]), '
                   '.target(name: "Web", dependencies: [.product(name: "Vapor", package: "vapor"), .product(name: "Core", package: "c", condition: .when(platforms: [.linux])), .target(name: "Base")], path: "Lib/A"), '
                   '.target(name: "Base", path: "Core")')},
    }))
    k = kinds(inv)
    assert k["multi"] == {"Core": "library", "ApiServer": "service", "Multi": "library"}
    assert k["single"] == {"Only": "library"} and k["bare"] == {"Bare": "cli"} and k["quiet"] == {"Quiet": "library"}
    assert k["app"] == {"Ui": "frontend"} and k["cli"] == {"Run": "cli"}
    assert links(inv)["multi"] == {("ApiServer", "Core"), ("Multi", "Core"), ("Multi", "ApiServer")}
    assert k["nested"] == {"Core": "library", "Web": "library", "Base": "library", "N": "library"} and roots(inv)["nested"]["Web"] == "Lib/A"
    assert {x for x in links(inv)["nested"] if x[0] != "N"} == {("Web", "Core"), ("Web", "Base")}
    assert externals(inv) == {("multi", "Multi", "digit"): ">=1.2.0", ("single", "Only", "x"): "2.0.0", ("single", "Only", "y"): ""}
    assert roots(inv)["multi"] == {"Core": "Sources/Core", "ApiServer": ".", "Multi": "."} and roots(inv)["single"]["Only"] == "Lib"


def test_discover_all_and_registry(tree):
    files = tree({
        "poly": {"go.mod": "module m/x", "a.go": "package a", "web/package.json": '{"name": "web", "dependencies": {"react": "1", "shared-ui": "file:../ui"}}',
                 "ui/package.json": '{"name": "@org/shared-ui"}', "package.json": '{"name": "same-root"}', "app.recipe": "makes soup"},
    })

    def recipes(files, mode):
        found = manifests(files, "app.recipe", mode)
        rows = component_rows(found, "app.recipe", name=F.lit("soup"), kind=F.lit("pipeline"), type=F.lit("recipe"), root=F.lit("kitchen"))
        return Inventory(rows, internal_rows(rows, F.lit("web")), no_external(rows))

    discovery.register("recipe", recipes, ["app.recipe"], ["**/old/**"])
    try:
        inv = discovery.discover(files, ["go", "typescript", "recipe"])
        comps = {r.name: (r.ordinal, r.root_path) for r in inv.components.collect()}
        # the module at the root comes first and keeps its root path
        assert comps == {"x": (0, "."), "@org/shared-ui": (1, "ui"), "web": (2, "web"), "soup": (3, "kitchen")}
        assert {(r.component, r.dep) for r in inv.internal.collect()} == {("web", "@org/shared-ui"), ("soup", "web")}
    finally:
        discovery.unregister("recipe")


def test_contents_are_read_once(spark, tree, tmp_path, monkeypatch):
    """All ecosystems together scan the contents of the files in one place, and find what each finds alone."""
    texts = {
        "go.mod": "module m/x", "cmd/x/main.go": 'package main\nimport "m/x/lib"', "py/pyproject.toml": '[project]\nname = "p"\ndependencies = ["requests"]',
        "web/package.json": '{"name": "web"}', "rs/Cargo.toml": '[package]\nname = "c"', "sol/foundry.toml": "[profile.default]\nsrc = 'src'", "sol/src/A.sol": "contract A {}",
        "sw/Package.swift": 'let package = Package(name: "S", targets: [.target(name: "T")])', "sw/Sources/T/main.swift": "1",
        **{f"py/src/p/{s}/{f}.py": f"import p.{'b' if s == 'a' else 'a'}.x" for s in "ab" for f in ("__init__", "x", "y")}, "py/src/p/__init__.py": "",
    }
    place = str(tmp_path / "estate")
    tree({"r": texts}).write.parquet(place)
    files = spark.read.parquet(place)
    alone = [discovery.discover(files, [name]) for name in discovery.OWN]
    plans = []
    write = DataFrameWriter.parquet

    def noted(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    inv = discovery.discover(files)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (inv.components, inv.internal, inv.external, inv.metadata)]
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan" in line and "estate" in line]
    assert sum("content:string" in line.split("ReadSchema:")[1] for line in scans) == 1
    rows = lambda df, *columns: {tuple(r) for r in df.select(*columns).collect()}
    named = ("name", "kind", "type", "root_path", "manifest_path")
    assert rows(inv.components, *named) == set().union(*(rows(i.components, *named) for i in alone)) and inv.components.count() >= 9
    assert rows(inv.external, "component", "name") == set().union(*(rows(i.external, "component", "name") for i in alone))
    assert {("a", "b"), ("b", "a")} <= rows(inv.internal, "component", "dep")


def test_corpus_status(spark, tree):
    files = tree({
        "good": {"package.json": '{"name": "g"}', "x/package.json": "[]"}, "bad": {"package.json": "{"}, "none": {"readme.md": "nothing here"}, "twice": {"package.json": '{"name": "a", "name": "b"}'},
    })
    repos = files.select("repo").union(spark.createDataFrame([("gone",)], "repo string"))
    inv, outcome = discovery.discover_corpus(repos, files)
    assert {(r.repo, r.name) for r in inv.components.collect()} == {("good", "g"), ("twice", "b")}
    assert {r.repo: (r.status, r.error) for r in outcome.collect()} == {
        "good": ("ok", "x/package.json: must be a JSON object, got list"), "bad": ("discovery_failed", "package.json: Invalid JSON"),
        "none": ("ok", None), "twice": ("ok", None), "gone": ("clone_failed", None),
    }


def test_corpus_is_planned_by_ecosystem(spark, tree, monkeypatch):
    """Of several ecosystems each is written from a plan of its own; what is returned reads tables."""
    from repoloom.operators import discovery, inventory

    planned = {}

    def noted(df, label, *args, **more):
        planned[label] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return stage(df, label, *args, **more)

    stage = discovery.stage
    for module in (discovery, inventory):
        monkeypatch.setattr(module, "stage", noted, raising=False)
    files = tree({"a": {"package.json": '{"name": "x", "dependencies": {"y": "1"}}', "y/package.json": '{"name": "y"}'}, "b": {"go.mod": "module example.org/b\n", "main.go": "package main\n"}, "c": {"Cargo.toml": '[package]\nname = "c"\n'}})
    repos = files.select("repo").union(spark.createDataFrame([("none",)], "repo string"))
    inv, outcome = discovery.discover_corpus(repos, files)
    assert sorted(map(tuple, outcome.collect())) == [("a", "ok", None), ("b", "ok", None), ("c", "ok", None), ("none", "clone_failed", None)]
    assert sorted((r.repo, r.name) for r in inv.components.collect()) == [("a", "x"), ("a", "y"), ("b", "b"), ("c", "c")]
    assert {f"{name}-{part}" for name in discovery.ECOSYSTEMS for part in ("components", "internal")} <= set(planned)
    assert planned["components"] <= 4 and max(planned.values()) < 25
    for df in (inv.components, inv.internal, outcome):
        assert "Join " not in df._jdf.queryExecution().optimizedPlan().toString()
