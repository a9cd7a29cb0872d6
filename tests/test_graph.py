from __future__ import annotations

import math
import random

import pytest

from repoloom.operators import graph as kg
from repoloom.runtime import stage

SHAPES = {
    "empty": [], "chain": ["b>a", "c>b"], "diamond": ["b>a", "c>a", "d>b", "d>c"], "two": ["a>b", "b>a"], "cycle_top": ["a>b", "b>a", "c>a"],
    "cycle_base": ["a>b", "b>a", "a>base", "base>deep"], "three": ["a>b", "b>c", "c>a"], "pairs": ["a>b", "b>a", "c>d", "d>c", "c>a", "e>c"],
    "self": ["a>a", "b>a"], "ghost": ["a>zz", "b>a"], "between": ["a>b", "b>a", "b>m", "m>n", "n>x", "x>y", "y>x"],
}


def expected(nodes, arcs):
    """Depth and component id by plain reachability."""
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in arcs:
            reach[a] |= reach[b]
    scc = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    depth = {n: 0 for n in nodes}
    for _ in nodes:
        for a, b in arcs:
            if scc[a] != scc[b]:
                low = depth[b] + 1
                for m in nodes:
                    if scc[m] == scc[a] and depth[m] < low:
                        depth[m] = low
    return {n: (scc[n], depth[n]) for n in nodes}


def frames(spark, graphs):
    comps = [(r, n) for r, (nodes, _) in graphs.items() for n in nodes]
    edges = [(r, a, b) for r, (_, arcs) in graphs.items() for a, b in arcs]
    return spark.createDataFrame(comps, "repo string, name string"), spark.createDataFrame(edges, "repo string, source string, target string")


def test_depths_against_reachability(spark):
    graphs = {}
    for repo, arcs in SHAPES.items():
        pairs = [tuple(a.split(">")) for a in arcs]
        nodes = sorted({n for p in pairs for n in p if n != "zz"} | {"solo"})
        graphs[repo] = (nodes, pairs)
    rng = random.Random(7)
    for i in range(30):
        nodes = [f"n{k}" for k in range(14)]
        graphs[f"random{i}"] = (nodes, [(rng.choice(nodes), rng.choice(nodes)) for _ in range(4 + i)])
    comps, edges = frames(spark, graphs)
    got = {(r.repo, r.name): (r.scc_id, r.depth) for r in kg.depth_levels(comps, edges).collect()}
    want = {(repo, n): v for repo, (nodes, arcs) in graphs.items() for n, v in expected(nodes, [a for a in arcs if a[1] != "zz"]).items()}
    assert got == want


@pytest.fixture
def rounds(monkeypatch):
    """Names of the tables that the graph jobs write."""
    written = []

    def counted(df, label, **metrics):
        written.append(label)
        return stage(df, label, **metrics)

    monkeypatch.setattr(kg, "stage", counted)
    return written


def names(n):
    return [f"n{i:05d}" for i in range(n)]


def test_long_ring_and_chain(spark, rounds):
    """Ten thousand nodes in a ring, with a chain onto it, and in a chain alone: a logarithm of rounds."""
    n = 10_000
    most = 4 * math.log2(n)
    ids = names(n)
    ring = [(a, b) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)]
    comps, edges = frames(spark, {"ring": ([*ids, "top"], [*ring, ("top", ids[4])])})
    got = {r.name: (r.scc_id, r.depth) for r in kg.depth_levels(comps, edges).collect()}
    assert got == {**{i: (ids[0], 0) for i in ids}, "top": ("top", 1)}
    assert len(rounds) <= most
    rounds.clear()
    draw = random.Random(1)
    shuffled = draw.sample(ids, n)
    comps, edges = frames(spark, {"chain": (ids, list(zip(shuffled, shuffled[1:], strict=False)))})
    got = {r.name: r.depth for r in kg.depth_levels(comps, edges).collect()}
    assert got == {i: n - 1 - k for k, i in enumerate(shuffled)} and len(rounds) <= most
    rounds.clear()
    got = {r.name: r.level for r in kg.topological_order(comps, edges).collect()}
    assert got == {i: n - 1 - k for k, i in enumerate(shuffled)} and len(rounds) <= most


def test_long_ring_with_chords_and_tails(spark, rounds):
    """A ring of 120 with two chords, a chain onto it, a chain from it, and a second ring below that."""
    n = 120
    a, b, up, down = ([f"{p}{i:03d}" for i in range(n)] for p in "abud")
    arcs = [*zip(a, [*a[1:], a[0]], strict=True), (a[10], a[70]), (a[50], a[20]), *zip(b, [*b[1:], b[0]], strict=True)]
    arcs += [*zip(up, [*up[1:], a[7]], strict=True), (a[33], down[0]), *zip(down, [*down[1:], b[3]], strict=True)]
    comps, edges = frames(spark, {"r": ([*a, *b, *up, *down], arcs)})
    got = {r.name: (r.scc_id, r.depth) for r in kg.depth_levels(comps, edges).collect()}
    want = {x: ("b000", 0) for x in b} | {x: (x, n - k) for k, x in enumerate(down)} | {x: ("a000", n + 1) for x in a}
    assert got == want | {x: (x, 2 * n + 1 - k) for k, x in enumerate(up)}
    assert len(rounds) <= 100


def test_topological_order(spark):
    comps, edges = frames(spark, {"r": (["a", "b", "c", "d"], [("b", "a"), ("c", "b"), ("d", "c"), ("a", "x")])})
    subset = comps.filter("name <> 'b'")
    assert {r.name: r.level for r in kg.topological_order(subset, edges).collect()} == {"a": 0, "c": 0, "d": 1}
    loops, arcs = frames(spark, {"r": (["a", "b"], [("a", "b"), ("b", "a")])})
    with pytest.raises(kg.CycleError):
        kg.topological_order(loops, arcs)


def test_build_and_edges(spark):
    comps = spark.createDataFrame([("r", "a", "library", 0), ("r", "b", "cli", 1), ("r", "a", "service", 2)], "repo string, name string, kind string, ordinal int")
    deps = spark.createDataFrame([("r", "b", "a"), ("r", "b", "a"), ("r", "b", "zz")], "repo string, component string, dep string")
    g = kg.build_graph(comps, deps)
    assert {(r.name, r.kind) for r in g.components.collect()} == {("a", "service"), ("b", "cli")}
    assert g.edges.count() == 2 and kg.simple_graph(g.edges).count() == 1
    calls = spark.createDataFrame([("r", "a", "b", "GRPC")], "repo string, source string, target string, protocol string")
    assert kg.add_edges(g, calls, "calls", 0.5).edges.filter("edge_type = 'calls'").first().protocol == "grpc"
    with pytest.raises(ValueError):
        kg.add_edges(g, calls, "loves")
