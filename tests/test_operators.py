"""Inventories, incremental selection, analyses, audits, traces, files."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from repoloom.functions.running import previous_rows, ranks, running_totals
from repoloom.functions.text import balanced_span, balanced_spans
from repoloom.operators import analyses, artifacts, audit, incremental, inventory, observability
from repoloom.sources import files as fs
from repoloom.sources import tables as tb
from repoloom.streaming import markers


def test_resolve_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc-") for _ in range(n))
    names = {r: sorted({word(rng.randint(1, 5)) for _ in range(9)}) for r in ("r1", "r2", "one")}
    names["one"] = ["core"]
    deps = [(r, "x", d) for r in names for d in {word(rng.randint(0, 6)) for _ in range(40)} | {"lib/root", ""}]
    comps = [(r, n, "lib/root" if i == 0 else f"p/{r}{i}", i) for r, ns in names.items() for i, n in enumerate(ns)]

    def want(repo, dep):
        if dep in names[repo]:
            return dep
        if dep == "lib/root":
            return names[repo][0]
        hits = [n for n in names[repo] if dep in n or n in dep]
        return hits[0] if len(hits) == 1 else None

    cdf = spark.createDataFrame(comps, "repo string, name string, root_path string, ordinal int")
    ddf = spark.createDataFrame([(*d, i) for i, d in enumerate(deps)], "repo string, component string, dep string, n int")
    got = {r.n: r.dep for r in inventory.resolve_internal_deps(cdf, ddf).collect()}
    assert got == {i: want(r, d) for i, (r, _, d) in enumerate(deps) if want(r, d) is not None}


def test_resolve_in_one_repository_of_many_names(spark):
    """100000 names with a common part: found by rare pieces, in joins on more than the repository."""
    n = 100_000
    comps = spark.range(n).selectExpr("'big' as repo", "concat('service-', lpad(hex(id * 7919), 8, 'x'), '-core') as name", "concat('p/', id) as root_path", "int(id) as ordinal")
    want = {r.root_path: r.name for r in comps.filter("ordinal % 997 = 0").collect()}
    deps = comps.filter("ordinal % 997 = 0").selectExpr("repo", "root_path as component", "case ordinal % 2 when 0 then concat('lib/', name, '/x') else substr(name, 4, 14) end as dep")
    deps = deps.unionByName(spark.createDataFrame([("big", "none", "service-"), ("big", "none", "nowhere"), ("big", "none", "-")], "repo string, component string, dep string"))
    out = inventory.resolve_internal_deps(comps, deps)
    assert {r.component: r.dep for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"^[ :+-]*Join \w+, \(repo#\d+ = repo#\d+\)$", plan, re.M) and "Cross" not in plan


def test_balanced_spans(spark):
    """The first balanced brackets and the outermost heads, against a count over characters; also in a long text."""
    def first(text, a, b):
        depth, at = 0, text.find(a)
        for i in range(at, len(text)) if at >= 0 else ():
            depth += (text[i] == a) - (text[i] == b)
            if not depth:
                return text[at : i + 1]
        return None

    rng = random.Random(9)
    texts = ["".join(rng.choice("{}ab\n(") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", "}{", "x{y}" * 3, "é{" + "a" * 500_000 + "{b}" * 100_000 + "}z{}"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", balanced_span(F.col("t"), "{", "}").alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: first(t, "{", "}") for i, t in enumerate(texts)}
    heads = {"f(a(b)c) g f (x f(y)) f(": ["f(a(b)c)", "f (x f(y))"], "none": [], "f()f()": ["f()", "f()"], "(f(1)": ["f(1)"], "": []}
    rows = spark.createDataFrame([(t,) for t in heads], "t string").select("t", balanced_spans(F.col("t"), "f").alias("s")).collect()
    assert {r.t: r.s for r in rows} == heads


def test_dependents_to_the_end(spark):
    """Least steps over cycles and branches, all repositories at once; a limit cuts."""
    rng = random.Random(5)
    edges = {("r", f"n{a}", f"n{b}") for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60))} | {("s", f"m{i + 1}", f"m{i}") for i in range(25)} | {("s", "m0", "m25"), ("t", "a", "b")}
    start = {("r", "n1"), ("r", "n2"), ("s", "m3"), ("t", "zz")}
    hop, front, k = dict.fromkeys(start, 0), start, 0
    while front:
        k += 1
        front = {(r, a) for r, a, b in edges if (r, b) in front} - hop.keys()
        hop |= dict.fromkeys(front, k)
    rows = spark.createDataFrame([(*e, "depends_on") for e in edges], "repo string, source string, target string, edge_type string")
    got = incremental.affected_dependents(spark.createDataFrame(list(start), "repo string, component string"), rows)
    assert {(r.repo, r.component): r.hop for r in got.collect()} == {n: h for n, h in hop.items() if h}
    near = incremental.affected_dependents(spark.createDataFrame(list(start), "repo string, component string"), rows, hops=2)
    assert {(r.repo, r.component): r.hop for r in near.collect()} == {n: h for n, h in hop.items() if 0 < h <= 2}


def test_running_totals_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, i % 5) for i in range(600)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(6)
    got = {(r.g, r.t): r.before for r in running_totals(df, ["g"], ["t"], {"before": F.col("v")}).collect()}
    prev = {(r.g, r.t): r.prev.t if r.prev else None for r in previous_rows(df, ["g"], ["t"], ["t"]).collect()}
    want, last, sums = {}, {}, {}
    for g, t, v in sorted(rows, key=lambda r: r[1]):
        want[(g, t)] = (sums.get(g, 0), last.get(g))
        sums[g], last[g] = sums.get(g, 0) + v, t
    assert got == {k: v[0] for k, v in want.items()} and prev == {k: v[1] for k, v in want.items()}


def test_ranks_with_a_hot_group(spark):
    """Nine tenths of the rows in one group, the null one: its rows are ranked in many tasks."""
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, concat('g', id % 70), null) as g", "hash(id) as t", "id")
    got = ranks(df, ["g"], ["t", "id"])
    places: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.t, r.id)):
        places.setdefault(r.g, []).append(r.id)
    assert {r.id: r.pos for r in got.collect()} == {i: n for ids in places.values() for n, i in enumerate(ids, 1)}
    window = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line)
    assert "_slice" in window
    assert {r.id for r in ranks(df, ["g"], ["t", "id"], 2).collect()} == {i for ids in places.values() for i in ids[:2]}
    assert ranks(df.limit(0), ["g"], ["t"]).count() == 0


def test_incremental(spark):
    comps = spark.createDataFrame(
        [("r", "all", "src", 0), ("r", "api", "src/api/", 1), ("r", "rootless", "", 2), ("r", "doc", "docs/a.md", 3), ("q", "x", "src", 0)],
        "repo string, name string, root_path string, ordinal int")
    paths = [("r", "src/api/x.py"), ("r", "srcs/x.py"), ("r", "src"), ("r", "docs/a.md"), ("r", "top.md"), ("p", "src/a")]
    changed = spark.createDataFrame(paths, "repo string, path string")
    own = lambda policy: {(r.repo, r.path): r.component for r in incremental.owners(changed, comps, policy).collect()}
    first = {("r", "src/api/x.py"): "all", ("r", "srcs/x.py"): None, ("r", "src"): "all", ("r", "docs/a.md"): "doc", ("r", "top.md"): None, ("p", "src/a"): None}
    assert own("first") == first and own("longest") == {**first, ("r", "src/api/x.py"): "api"}
    affected, unmapped = incremental.map_files(changed, comps)
    assert affected.count() + len({c for c in first.values() if c is None}) >= 1 and unmapped.count() == 3
    repos = spark.createDataFrame([("r", "s"), ("q", "s"), ("p", "s"), ("new", "")], "repo string, last_sha string")
    assert {r.repo: (r.mode, r.affected, r.unmapped) for r in incremental.diff_plan(repos, changed, comps).collect()} == {
        "r": ("incremental", 2, 2), "q": ("full", 0, 0), "p": ("full", 0, 0), "new": ("full", 0, 0)}
    work = {(r.section, r.component, r.path) for r in incremental.change_worklist(changed, comps, 1, 1).collect() if r.repo == "r"}
    assert work == {("changed", "all", "src"), ("changed", "doc", "docs/a.md"), ("unmapped", None, "srcs/x.py")}


def test_summaries(spark):
    cases = {
        "s": "# t\nintro\n## Summary\n\na\n b\n### c\n## Next\nd", "o": "x\n### Overview\n## Overview of it\n1\n2\n3\n4\n5\n6", "empty": "## Summary\n## Next\nafter",
        "prose": "# head\n\n  text here\nmore", "long": "y" * 700, "nothing": "# only\n\n", "again": "## Summary\na\n## Overview\nb\n## End\nc",
    }
    df = spark.createDataFrame([("r", k, v) for k, v in cases.items()], "repo string, component string, markdown string")
    got = {r.component: r.summary for r in analyses.extract_summary(df).collect()}
    assert got == {"s": "a\n b\n### c", "o": "1\n2\n3\n4\n5", "empty": "after", "prose": "  text here", "long": "y" * 500, "nothing": "(no summary available)", "again": "a\nb"}


def test_fold_keeps_going_after_a_failure(spark):
    comps = spark.createDataFrame([("r", n) for n in "abc"], "repo string, name string")
    edges = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b")], "repo string, source string, target string")
    levels = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("r", "c", 2)], "repo string, name string, depth int")

    def fn(row):
        if row["name"] == "b":
            raise RuntimeError("boom")
        return f"{row['name']}<{row['up']}>"

    out = analyses.fold_upstream(comps, edges, levels, [F.max("value").alias("up")], fn)
    got = {r.name: r.value for r in out.collect()}
    assert got == {"a": "a<None>", "b": "Error: component analyzer crashed: boom", "c": "c<Error: component analyzer crashed: boom>"}
    assert {(r.depth, r.succeeded, r.failed) for r in analyses.analysis_outcome(out).collect()} == {(0, 1, 0), (1, 0, 1), (2, 1, 0)}


def test_fold_along_a_long_chain(spark):
    n = 25
    comps = spark.createDataFrame([("r", f"c{i}") for i in range(n)] + [("s", "far")], "repo string, name string")
    edges = spark.createDataFrame([("r", f"c{i}", f"c{j}") for i in range(1, n) for j in {0, i - 1}], "repo string, source string, target string")
    levels = spark.createDataFrame([("r", f"c{i}", i) for i in range(n)] + [("s", "far", 3)], "repo string, name string, depth int")
    out = analyses.fold_upstream(comps, edges, levels, [F.sum("value").alias("below")], F.lit(1) + F.coalesce("below", F.lit(0)), value_type="bigint")
    want = [1, 2]
    for _ in range(2, n):
        want.append(1 + want[0] + want[-1])
    assert {(r.repo, r.name): r.value for r in out.collect()} == {**{("r", f"c{i}"): want[i] for i in range(n)}, ("s", "far"): 1}
    nothing = analyses.fold_upstream(comps.limit(0), edges, levels, [F.sum("value").alias("below")], F.lit(1), value_type="bigint")
    assert nothing.columns == ["repo", "name", "depth", "value"] and nothing.count() == 0


def test_citation_files(spark):
    analysed = spark.createDataFrame([("r", n) for n in "abcdefgh"], "repo string, component string")
    texts = {"a": "", "b": "7", "c": '{"citations": "x"}', "d": '{"citations": []}', "e": '{"other": 1}', "f": None, "g": '{"citations": {}, "citations": []}'}
    files = spark.createDataFrame([("r", k, v) for k, v in texts.items()], "repo string, component string, content string")
    got = {r.component: r.check for r in inventory.sidecar_problems(analysed, files).collect()}
    assert got == {"a": "invalid_json", "b": "no_object", "c": "no_array", "f": "invalid_json", "h": "missing_sidecar"}


def test_audit_json(spark):
    cases = {
        "fence": 'x ```json\n{"classifications": [{"component_name": "a", "proposed_kind": "cli"}]}\n``` y', "bare": 'so {"classifications": [{"component_name": "b"}]} and {more}',
        "badfence": '```\n{"a": }\n``` ', "open": "{ {} ", "none": "nothing", "string": '{"a": "}"}', "later": '```json\n{nope}\n```',
    }
    parsed = audit.extract_json(spark.createDataFrame(list(cases.items()), "repo string, raw string"))
    status = {r.repo: r.status for r in parsed.select("repo", "status").collect()}
    assert status == {"fence": "ok", "bare": "ok", "badfence": "parse_failed", "open": "parse_failed", "none": "parse_failed", "string": "parse_failed", "later": "parse_failed"}
    assert {(r.component, r.proposed) for r in audit.proposed_kinds(parsed).collect()} == {("a", "cli"), ("b", None)}


def test_edge_categories_and_budget(spark):
    comps = spark.createDataFrame([("r", "a", "cli")], "repo string, name string, kind string")
    edges = spark.createDataFrame([("r", "a", "b", "depends_on"), ("r", "a", "c", "calls")], "repo string, source string, target string, edge_type string")
    missed = spark.createDataFrame([("r", "m")], "repo string, proposed_name string")
    proposed = spark.createDataFrame(
        [("r", "a", "b", "import"), ("r", "a", "c", "import"), ("r", "m", "x", "other"), ("r", "m", "y", None), ("r", "zz", "y", "import")],
        "repo string, source string, target string, evidence_type string")
    got = {(r.source, r.target): r.category for r in audit.edge_discrepancies(comps, edges, proposed, missed).collect()}
    assert got == {("a", "c"): "plugin_gap", ("m", "x"): "dynamic_edge", ("m", "y"): "ambiguous"}
    usage = spark.createDataFrame([(i, "gpt-4o" if i % 2 else "?", 1_000_000, 0) for i in range(6)], "seq int, model string, input_tokens long, output_tokens long")
    rows = audit.cost_ledger(usage, audit.price_table(spark), 8.0).orderBy("seq").collect()
    assert [float(r.cumulative_usd) for r in rows] == [3.0, 5.5, 8.5]


def test_traces(spark):
    rows = [("s", "a", 1, "start"), ("s", "a", 2, "start"), ("s", "a", 3, "end"), ("s", "a", 4, "end"), ("s", "b", 5, "end"), ("s", "b", 6, "start")]
    df = spark.createDataFrame(rows, "session_id string, action string, sequence_id int, phase string").withColumn("ts", F.timestamp_seconds("sequence_id"))
    assert [(r.action, r.sequence_id, r.duration_ms) for r in observability.pair_traces(df).collect()] == [("a", 2, 1000.0)]
    values = spark.createDataFrame([("x" * 501, list(range(11)), {"k": "v"})], "t string, l array<int>, m map<string,string>")
    r = observability.truncate_values(values).first()
    assert r.t == "x" * 500 + "...(truncated)" and r.l == "[11 items]" and r.m == '{"k":"v"}'


def test_limits_that_can_be_lifted(spark):
    """Summaries, logged values and the choice of repositories: as the limits have them, and whole."""
    many = "# t\n## Summary\n" + "\n".join(f"line {i}" for i in range(9)) + "\n## Next\nx"
    df = spark.createDataFrame([("r", "a", many), ("r", "b", "y" * 900), ("r", "c", None)], "repo string, component string, markdown string")
    short = {r.component: r.summary for r in analyses.extract_summary(df).collect()}
    whole = {r.component: r.summary for r in analyses.extract_summary(df, None, None).collect()}
    assert short["a"].count("\n") == 4 and whole["a"] == "\n".join(f"line {i}" for i in range(9))
    assert len(short["b"]) == 500 and whole["b"] == "y" * 900 and short["c"] == whole["c"]

    values = spark.sql("select 1 as n, repeat('t', 600) as t, sequence(1, 20) as l, array('x') as s, map('k', 'v') as m, map('a', repeat('b', 600), 'c', 'd') as big, cast(null as string) as z")
    r = observability.truncate_values(values, whole="_log").first()
    assert r.t == "t" * 600 and r.l == list(range(1, 21)) and r.m == {"k": "v"} and r.z is None and r.n == 1
    assert (len(r.t_log), r.l_log, r.s_log, r.m_log, r.big_log, r.z_log) == (514, "[20 items]", '["x"]', '{"k":"v"}', "{...2 keys}", None)
    assert observability.truncate_values(values, max_text=5, max_items=50).first().t == "ttttt...(truncated)"
    with pytest.raises(ValueError):
        observability.truncate_values(values.withColumn("t_log", F.lit("")), whole="_log")

    repos = spark.range(20).selectExpr("concat('r', lpad(id, 2, '0')) as full_name", "'go' as language", "100 - id as stars", "if(id < 9, 900, 1) as size_kb")
    assert tb.select_corpus(repos, 4, 10).count() == 0
    got = sorted((r.pick, r.full_name) for r in tb.select_corpus(repos, 4, 10, pool=None).collect())
    assert got == [(1, "r09"), (2, "r10"), (3, "r11"), (4, "r12")]


def test_files(spark, tree, tmp_path):
    files = tree({"r": {
        "a/go.mod": "m", "a/env/x.py": "import os\r\nprint(1)\n", "environment/y.py": "", "lib/oz/foundry.toml": "", "foundry.toml": "", "p/lib/q/foundry.toml": "",
        "long.txt": "z" * 2001 + "\nb\nc",
    }})
    paths = lambda df: {r.path for r in df.collect()}
    assert "a/env/x.py" not in paths(fs.exclude_paths(files, "python")) and "environment/y.py" in paths(fs.exclude_paths(files, "python"))
    assert "environment/y.py" not in paths(fs.exclude_paths(files, "python", mode="substring"))
    assert paths(fs.exclude_vendored(files)) == paths(files) - {"lib/oz/foundry.toml"}
    assert {(r.path, r.ecosystem) for r in fs.match_manifests(files).collect()} >= {("a/go.mod", "go"), ("foundry.toml", "solidity")}
    assert paths(fs.glob_files(files, "**/*.py")) == {"a/env/x.py", "environment/y.py"} and paths(fs.glob_files(files, "*/x.py", prefix="a/")) == {"a/env/x.py"}
    assert [(r.line_no, r.line) for r in fs.grep(files, r"^print", include="*.py").collect()] == [(2, "print(1)")]
    window = {(r.path, r.line_no): (len(r.line), r.note) for r in fs.read_lines(files, 1, 2, max_line=2000).collect()}
    assert window[("long.txt", 1)] == (2015, "(Showing lines 1-2 of 3 total lines)") and window[("a/env/x.py", 2)] == (8, None)
    root = tmp_path / "repos" / "one" / "sub"
    root.mkdir(parents=True)
    (root / "f.txt").write_bytes(b"ok \xff")
    got = fs.scan_repos(spark, f"file:{tmp_path}/repos").collect()
    assert [(r.repo, r.path, r.content, r.size_bytes) for r in got] == [("one", "sub/f.txt", "ok �", 4)]


def test_snapshots_by_folder(spark, tree):
    old = {"same": {"a/b/x.py": "1", "top.md": "t"}, "moved": {"a/x.py": "1", "b/y.py": "2"}, "edit": {"a/b/c/x.py": "1", "a/d/y.py": "2", "z.md": "3"}, "gone": {"x": ""}}
    new = {"same": old["same"], "moved": {"b/x.py": "1", "a/y.py": "2"}, "edit": {"a/b/c/x.py": "9", "a/d/y.py": "2", "z.md": "3"}, "fresh": {"x/y": ""}}
    before, after = tb.file_digests(tree(old)), tree(new)
    assert before.columns == ["repo", "path", "digest"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    kept, made = tb.folder_digests(before), tb.folder_digests(tb.file_digests(after))
    sizes = {(r.repo, r.folder): r.files for r in kept.collect()}
    assert {k[1]: n for k, n in sizes.items() if k[0] == "edit"} == {"": 3, "a": 2, "a/b": 1, "a/b/c": 1, "a/d": 1}
    assert {r.folder for r in tb.changed_folders(kept, made).filter("repo = 'edit'").collect()} == {"", "a", "a/b", "a/b/c"}
    want = rows(tb.changed_files(tree(old), after))
    assert ("edit", "a/b/c/x.py", "modified") in want and len(want) == 7
    assert rows(tb.changed_below(before, after)) == want == rows(tb.changed_below(before, after, kept, made))
    assert rows(tb.changed_files(before, after)) == want
    # folders given as equal are not looked into: contents there are never compared
    assert rows(tb.changed_below(before, after, kept, kept)) == []
    # the digest tells a set of files apart from the same contents under other names, and is the same in any order
    assert rows(tb.folder_digests(before.repartition(7, "path"))) == rows(kept)
    assert tb.changed_below(before.limit(0), after.limit(0)).count() == 0


def test_inventory_documents_and_manifests(spark):
    docs = spark.createDataFrame([
        ("obj", '{"components": [{"name": "a", "kind": "CLI", "external_dependencies": ["x", {"name": "y", "version": "1"}]}]}'), ("arr", '[{"name": "b"}]'), ("bad", "{"), ("none", "{}"),
    ], "repo string, content string")
    rows = {r.repo: r for r in tb.components_from_json(docs).collect()}
    assert set(rows) == {"obj", "arr"} and rows["obj"].kind == "cli" and rows["arr"].type == "unknown" and rows["arr"].kind == "unknown"
    assert [(d.name, d.version) for d in rows["obj"].external_dependencies] == [("x", ""), ("y", "1")]
    prev = spark.createDataFrame([("s", 1, "repo", "c1", "m1"), ("s", 2, "repo", "c2", "m2")], "service string, version int, source_repo string, source_commit string, model string")
    new = spark.createDataFrame([("s", "other", "", "m3"), ("t", "fresh", "c9", "")], "service string, source_repo string, source_commit string, model string")
    got = {r.service: (r.version, r.source_repo, r.source_commit, r.model) for r in artifacts.next_manifest(prev, new).collect()}
    assert got == {"s": (3, "repo", "c2", "m3"), "t": (1, "fresh", "c9", "")}


def test_registered_queries(spark):
    """Some named queries against their oracle on the smallest data."""
    import duckdb

    import __spark_entry__ as entry
    from check import rows_of
    from repoloom.plans.bindings import TABLES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    runs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(runs)
    for name in ("kg9_depth_levels_acyclic", "inv2_resolve_internal_deps", "str1_completion_markers", "str2_live_summary", "snk1_inventory_records", "aud8_exemplars"):
        df = runs[name](spark, sf)
        cur = con.execute(sql[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall()), name


def test_reading_keeps_whole_lines_and_all_hits(spark):
    files = spark.createDataFrame([("r", f"d/f{i}.txt", "hit\n" + "x" * 3000 + "\nhit") for i in range(600)], "repo string, path string, content string")
    assert fs.grep(files, "^hit").count() == 1200 and fs.glob_files(files, "**/*.txt").agg({"pos": "max"}).first()[0] == 600
    read = fs.read_lines(files)
    assert read.count() == 1800 and read.filter("length(line) = 3000 and note is null").count() == 600


def test_bracket_globs(spark):
    from repoloom.functions.paths import glob_regex, glob_regex_col

    cases = [("pk[ab]/*", "pka/x", True), ("pk[ab]/*", "pkc/x", False), ("v[0-9]", "v7", True), ("v[0-9]", "v-", False), ("v[!0-9]", "vx", True),
             ("v[!0-9]", "v7", False), ("a[b", "a[b", True), ("a.b", "axb", False), ("x[.]y", "x.y", True), ("x[.]y", "xzy", False)]
    rows = spark.createDataFrame([(p, t, want, glob_regex(p)) for p, t, want in cases], "pattern string, path string, want boolean, plain string")
    rows = rows.withColumn("got", F.rlike("path", glob_regex_col(F.col("pattern")))).withColumn("other", F.rlike("path", F.col("plain")))
    assert [r for r in rows.collect() if r.got != r.want or r.other != r.want] == []


def test_duplicate_json_keys_keep_the_last(spark):
    from repoloom.functions.text import json_variant

    rows = spark.createDataFrame([('{"name": "a", "name": "b"}',), ("{broken",), (None,)], "content string")
    got = rows.select(F.try_variant_get(json_variant(F.col("content")), "$.name", "string").alias("n")).collect()
    assert [r.n for r in got] == ["b", None, None]


def test_load_dependencies_keeps_whole_lists(spark):
    """Every dependency of every component comes back from the files."""
    from repoloom.plans import catalog
    from repoloom.plans.bindings import view

    got = sorted((r.repo, r.name, r.scope, r.dependency) for r in catalog.RUNS["src8_load_dependencies"](spark, "/root/testdata/sf0.001").collect() if r.scope)
    want = [(r.repo, r.source, scope, r.target) for scope, name in (("external", "e_integrations"), ("internal", "e_edges")) for r in view(spark, name).collect()]
    assert got == sorted(want) and len(got) > 2 * len({g[:3] for g in got})


def test_announced_ends(spark, tmp_path):
    said = {
        "a": ["[APPLICATION_ANALYSIS_COMPLETE] x", "[APPLICATION_ANALYSIS_COMPLETE] y", "so [ALL_APPLICATION_ANALYSIS_COMPLETE]", "[ALL_APPLICATION_ANALYSIS_COMPLETE]"],
        "b": ["[APPLICATION_ANALYSIS_COMPLETE] x", "[ALL_APPLICATION_ANALYSIS_COMPLETE]"],
        "c": ["[APPLICATION_ANALYSIS_COMPLETE] x", "ALL_APPLICATION_ANALYSIS_COMPLETE"],
        "d": ["[ALL_APPLICATION_ANALYSIS_COMPLETE]"],
    }
    for repo, lines in said.items():
        (tmp_path / "in" / repo).mkdir(parents=True)
        (tmp_path / "in" / repo / "t.txt").write_text("\n".join(lines))
    stream = markers.announcements(markers.transcript_stream(spark, str(tmp_path / "in")))
    stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    announced = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.repo for r in announced.collect()) == ["a", "b", "d"]
    rows = spark.createDataFrame([(r, line) for r, lines in said.items() for line in lines], "repo string, line string")
    assert sorted(r.repo for r in markers.announcements(rows).collect()) == ["a", "b", "d"]
    expected = spark.createDataFrame([(r, n) for r in "abc" for n in "xy"], "repo string, name string")
    complete = markers.completeness(markers.completions(rows), expected)
    assert sorted(map(tuple, markers.unkept(announced, complete).collect())) == [("b", 2, 1), ("d", None, None)]


def test_transcripts_of_many_repositories(spark, tmp_path):
    """A file per repository, however its lines are dealt, and few tasks to list and read them."""
    from repoloom.runtime import many_files
    from repoloom.sources import sinks

    text = F.expr("case when id % 900 = 7 then null when id < 900 then 'x [APPLICATION_ANALYSIS_COMPLETE] a ok' else 'so [APPLICATION_ANALYSIS_COMPLETE] b ok' end")
    repo = F.expr("case when id % 900 > 0 then concat('r', id % 900) end")
    lines = spark.range(0, 1800, 1, 6).select(repo.alias("repo"), text.alias("value"))
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    sinks.write_lines(lines, f"file://{path}")
    names = sorted(p.relative_to(path).parent.as_posix() for p in (tmp_path / "in").rglob("*.txt"))
    assert names == sorted(["repo=__HIVE_DEFAULT_PARTITION__", *(f"repo=r{i}" for i in range(1, 900))])
    assert spark.read.text(path).select("repo", "value").exceptAll(lines.select(F.when(F.col("repo").isNull(), None).otherwise(F.col("repo")), F.coalesce("value", F.lit("")))).count() == 0
    assert spark.read.text(path).count() == 1800

    kept = spark.conf.get("spark.sql.files.openCostInBytes")
    with many_files(spark):
        stream = markers.follow_completions(markers.transcript_stream(spark, path), out, f"{tmp_path}/state")
        stream.awaitTermination()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == kept
    done = spark.read.parquet(out)
    assert done.count() == 2 * 899 and done.select("repo").distinct().count() == 899
    said = spark.sparkContext.statusTracker()
    stages = {s for j in said.getJobIdsForGroup(str(stream.runId)) for s in said.getJobInfo(j).stageIds}
    assert sum(said.getStageInfo(s).numTasks for s in stages) < 200


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_resolve_is_planned_in_pieces(spark, monkeypatch):
    """No single plan holds all look-ups, nor the plan of the dependencies more than once."""
    planned = []
    monkeypatch.setattr(inventory, "stage", lambda df, label: planned.append(joins(df)) or (spark.createDataFrame(df.collect(), df.schema), {}))
    comps = spark.createDataFrame([("r", n, f"p/{n}", i) for i, n in enumerate(["ab", "core", "util"])], "repo string, name string, root_path string, ordinal int")
    deps = spark.createDataFrame([("r", "ab", d) for d in ("core", "p/util", "lib-core", "til", "xaby", "none")], "repo string, component string, dep string")
    got = inventory.resolve_internal_deps(comps, deps)
    assert sorted(r.dep for r in got.collect()) == ["ab", "core", "core", "util", "util"]
    assert len(planned) == 3 and max(*planned, joins(got)) <= 5


def test_analyses_are_validated_in_one_pass(spark):
    comps = spark.createDataFrame([("r", n) for n in ("a", "b", "none")], "repo string, name string")
    done = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, component string")
    cites = [("x.py", 1, 2), ("/tmp/run/project/x.py", 1, 2), ("", 1, 2), ("/tmp/run/project/", 1, 2), (None, 1, 2), ("y.py", 0, 2),
             ("x.py", 0, 2), ("x.py", 3, 2), ("x.py", 9, 9), ("x.py", None, 2), ("x.py", 1, None)]
    rows = spark.createDataFrame([("r", "a", i, *c) for i, c in enumerate(cites)], "repo string, component string, idx int, file_path string, start_line int, end_line int")
    files = spark.createDataFrame([("r", "x.py", 5), ("r", "", 5)], "repo string, path string, line_count int")
    got = inventory.validate_analyses(comps, done, rows, files)
    assert sorted((r.check, r.message) for r in got.collect()) == [
        ("bad_range", "[a] Invalid line range 0-2 in x.py"), ("bad_range", "[a] Invalid line range 3-2 in x.py"),
        ("beyond_end", "[a] Citation start_line 9 > file length 5 in x.py"), ("missing_analysis", "Missing analysis file for component 'none'"),
        ("missing_file", "[a] Citation file not found: y.py"), ("missing_path", "[a] Citation [2] missing file_path"),
        ("no_citations", "[b] citations array is empty (expected 10+)")]
    assert joins(got) <= 6
