"""Knowledge graph: nodes, typed edges, cycles, depth levels.

A graph is three tables, each keyed by ``repo``: components, external services
and a bag of edges (source, target, edge_type, protocol, confidence).
Iterative parts work on all repositories at once and write one small table per
round (see :func:`repoloom.runtime.stage`); chains and rings shrink by half in
each, so that their length costs a logarithm of rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.kinds import EDGE_TYPES, PROTOCOLS, SERVICE_CATEGORIES, one_of
from repoloom.runtime import stage

EDGE_COLUMNS = ["repo", "source", "target", "edge_type", "protocol", "description", "confidence"]


@dataclass(frozen=True)
class Graph:
    components: DataFrame
    services: DataFrame | None
    edges: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- building ---------------------------------------------------------------


def last_per_name(components: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row per (repo, name): the last in inventory order."""
    keep = [c for c in components.columns if c not in ("repo", "name")]
    picked = components.groupBy("repo", "name").agg(F.max_by(F.struct(*keep), order).alias("_row"))
    return picked.select("repo", "name", "_row.*")


def typed_edges(pairs: DataFrame, edge_type: str, confidence: float = 1.0) -> DataFrame:
    """Edges of one type from (repo, source, target[, protocol, description])."""
    if edge_type not in EDGE_TYPES:
        raise ValueError(f"edge type {edge_type!r} is none of {EDGE_TYPES}")
    has = set(pairs.columns)
    protocol = one_of(F.col("protocol"), PROTOCOLS, "unknown") if "protocol" in has else F.lit(None)
    return pairs.select(
        "repo", "source", "target",
        F.lit(edge_type).alias("edge_type"),
        F.when(protocol.isNotNull(), protocol).cast("string").alias("protocol"),
        (F.coalesce("description", F.lit("")) if "description" in has else F.lit("")).alias("description"),
        F.lit(confidence).alias("confidence"),
    )


def build_graph(components: DataFrame, internal_deps: DataFrame) -> Graph:
    """Component nodes and ``depends_on`` edges to known names of the same repo.

    ``internal_deps`` has (repo, component, dep). A dependency listed twice
    gives two edges.
    """
    nodes = last_per_name(components)
    known = nodes.select("repo", F.col("name").alias("target"))
    pairs = internal_deps.select("repo", F.col("component").alias("source"), F.col("dep").alias("target"))
    return Graph(nodes, None, typed_edges(pairs.join(known, ["repo", "target"], "left_semi"), "depends_on"))


def add_edges(graph: Graph, pairs: DataFrame, edge_type: str, confidence: float = 1.0) -> Graph:
    return Graph(graph.components, graph.services, graph.edges.unionByName(typed_edges(pairs, edge_type, confidence)))


def add_services(graph: Graph, services: DataFrame, order: str = "ordinal") -> Graph:
    """External services (repo, id, name, category, ordinal); last one per id wins."""
    clean = services.withColumn("category", one_of(F.col("category"), SERVICE_CATEGORIES, "other"))
    keep = [c for c in clean.columns if c not in ("repo", "id")]
    picked = clean.groupBy("repo", "id").agg(F.max_by(F.struct(*keep), order).alias("_row")).select("repo", "id", "_row.*")
    return Graph(graph.components, picked, graph.edges)


# --- look-ups ---------------------------------------------------------------


def node_ids(graph: Graph) -> DataFrame:
    ids = graph.components.select("repo", F.col("name").alias("id"))
    if graph.services is not None:
        ids = ids.union(graph.services.select("repo", "id"))
    return ids.distinct()


def edges_from(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Edges whose source is in ``nodes`` (repo, id)."""
    some = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    return some.join(nodes.select("repo", F.col("id").alias("source")), ["repo", "source"], "left_semi")


def edges_to(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Edges whose target is in ``nodes`` (repo, id)."""
    some = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    return some.join(nodes.select("repo", F.col("id").alias("target")), ["repo", "target"], "left_semi")


def simple_graph(edges: DataFrame) -> DataFrame:
    """Distinct ``depends_on`` pairs."""
    some = edges.filter("edge_type = 'depends_on'") if "edge_type" in edges.columns else edges
    return some.select("repo", "source", "target").distinct()


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, source, target): what each of ``nodes`` depends on directly."""
    return edges_from(simple_graph(edges), nodes)


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, target, source): what depends directly on each of ``nodes``."""
    return edges_to(simple_graph(edges), nodes)


def with_analysis(components: DataFrame, analyses: DataFrame) -> DataFrame:
    return components.join(analyses.select("repo", F.col("component").alias("name")), ["repo", "name"], "left_semi")


def without_analysis(components: DataFrame, analyses: DataFrame) -> DataFrame:
    return components.join(analyses.select("repo", F.col("component").alias("name")), ["repo", "name"], "left_anti")


# --- contraction ------------------------------------------------------------

#: Longer than any path, so that the weights of edges inside cycles stay bounded.
_FAR = 1 << 40
#: Staged tables that are united before they are written as one.
_UNITE = 16


def _gather(parts: list[DataFrame], label: str) -> list[DataFrame]:
    """The same rows in one table, once there are many parts."""
    return [stage(_union(parts), label)[0]] if len(parts) >= _UNITE else parts


#: One round of :func:`_settle`. ``known`` is what a node's floor comes to where its last edge leads to a settled node.
_STATUS = """
select repo, source as name, count_if(target <> '') as n, max(case when target = '' then w end) as floor,
  max(case when target <> '' then target end) as next, max(case when target <> '' then w end) as w
from {rows} group by repo, source
"""
_ROUND = """
with goals as (
  select s.repo, s.name, s.n, s.floor, s.next, s.w, 
    case when s.n = 0 then s.floor when z.name is not null then greatest(s.floor, s.w + z.floor) end as known
  from {status} s left join (select repo, name, floor from {status} where n = 0) z on s.n = 1 and z.repo = s.repo and z.name = s.next
), moved as (
  select e.repo, e.source, inline(case
    when g.name is null then array(struct('' as target, e.w as w, 1 as hit))
    when g.known is not null then array(struct('' as target, e.w + g.known as w, 1 as hit))
    when g.n = 1 and g.floor is null then array(struct(g.next as target, e.w + g.w as w, 0 as hit))
    when g.n = 1 then array(struct(g.next as target, e.w + g.w as w, 0 as hit), struct('' as target, e.w + g.floor as w, 0 as hit))
    else array(struct(e.target as target, e.w as w, 0 as hit)) end)
  from {rows} e left join goals g on g.repo = e.repo and g.name = e.target where e.target <> ''
)
select repo, source, target, least(max(w), {far}) as w, sum(hit) as hit
from (select * from moved union all select repo, name, '', floor, 0 from {status} where n > 0 and floor is not null)
group by repo, source, target
"""


def _settle(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """Longest way down from each source, and the sources that reach a cycle.

    ``rows`` has (repo, source, target, w), one row per source and target: an
    edge of length w or, with the target '' that is no name, a floor. In every
    round, all at once, edges to settled nodes become floors, and edges to a
    node with a single edge jump to where that leads, so a chain shortens by
    half. One table is written per round, of the edges not yet settled.

    Returns (repo, name, depth) and (repo, name) of what reaches a cycle, null
    if nothing does. Some edge becomes a floor in each round as long as a node
    off the cycles is open, so a round without ends the search.
    """
    spark, settled, turn = rows.sparkSession, [], 0
    while True:
        status = spark.sql(_STATUS, rows=rows)
        settled = _gather([*settled, status.filter("n = 0").selectExpr("repo", "name", "floor as depth")], f"{label}-settled")
        after, seen = stage(spark.sql(_ROUND, rows=rows, status=status, far=_FAR), f"{label}-{turn}", edges=F.count_if(F.col("target") != ""), hits=F.sum("hit"))
        if not seen["hits"]:
            stuck = status.filter("n > 0").select("repo", "name")
            return _union(settled), stuck if seen["edges"] else None
        rows, turn = after.drop("hit"), turn + 1


def _inside(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with both ends among ``nodes`` (repo, name)."""
    for end in ("source", "target"):
        pairs = pairs.join(nodes.select("repo", F.col("name").alias(end)), ["repo", end], "left_semi")
    return pairs


def _flip(pairs: DataFrame) -> DataFrame:
    return pairs.select("repo", F.col("target").alias("source"), F.col("source").alias("target"))


def _spread(start: DataFrame, arcs: DataFrame, label: str) -> DataFrame:
    """Least value reaching each node: ``start`` (repo, name, mark) along ``arcs``.

    One round moves the marks that shrank one arc further.
    """
    marks, seen = stage(start.withColumn("moved", F.lit(True)), f"{label}-0", n=F.count("*"))
    out, step = arcs.select("repo", F.col("source").alias("name"), F.col("target").alias("_to")), 1
    while True:
        sent = (
            out.join(marks.filter("moved").drop("moved"), ["repo", "name"])
            .groupBy("repo", F.col("_to").alias("name")).agg(F.min("mark").alias("_in"))
        )
        better = F.col("_in").isNotNull() & (F.col("mark").isNull() | (F.col("_in") < F.col("mark")))
        merged = marks.drop("moved").join(sent, ["repo", "name"], "full").select(
            "repo", "name", F.when(better, F.col("_in")).otherwise(F.col("mark")).alias("mark"),
            better.alias("moved"),
        )
        marks, seen = stage(merged, f"{label}-{step}", moved=F.count_if("moved"))
        if not seen["moved"]:
            return marks.drop("moved")
        step += 1


@dataclass(frozen=True)
class _Followers:
    """Nodes with a single edge, out of the graph, and how to find them again."""

    entries: DataFrame  # repo, source, target, end: edges of other nodes to followers, and where those lead
    ends: DataFrame  # repo, name, end
    jumps: list[DataFrame]  # by doubled distance: repo, name, next


def _follow(pairs: DataFrame, label: str) -> tuple[DataFrame, _Followers, DataFrame, int] | None:
    """Take the nodes with a single edge out of a graph: each leads, in doubled steps, to a node with several or round a ring.

    Returns the edges among the others, now to where followers lead; the
    followers; rings (repo, name, rep); and how many edges are left. Null if
    there are no followers.
    """
    single = pairs.groupBy("repo", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("target").alias("next")).filter("n = 1")
    now, seen = stage(single.select("repo", "name", "next", F.col("name").alias("low")), f"{label}-single", n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    jumps, reach = [now], 1
    while True:
        far = now.selectExpr("repo", "name as next", "next as beyond", "low as _low")
        step = now.join(far, ["repo", "next"], "left").selectExpr(
            "repo", "name", "coalesce(beyond, next) as next", "least(low, coalesce(_low, low)) as low", "beyond is not null as open")
        step, moved = stage(step, f"{label}-jump-{len(jumps)}", open=F.count_if("open"))
        if not moved["open"]:
            break
        now, reach = step.select("repo", "name", "next", "low"), 2 * reach
        jumps.append(now)
        if reach >= seen["n"]:  # whoever still leads to a follower leads into a ring of them
            break
    names = now.select("repo", F.col("name").alias("next"))
    ends = now.join(names, ["repo", "next"], "left_anti").select("repo", "name", F.col("next").alias("end"))
    on_ring = now.join(names, ["repo", "next"], "left_semi").select("repo", F.col("next").alias("name")).distinct()
    rings = now.join(on_ring, ["repo", "name"], "left_semi").select("repo", "name", F.col("low").alias("rep"))
    lost = now.join(names, ["repo", "next"], "left_semi").select("repo", F.col("name").alias("target"))
    led = (
        pairs.join(now.select("repo", F.col("name").alias("source")), ["repo", "source"], "left_anti")
        .join(lost, ["repo", "target"], "left_anti")
        .join(ends.select("repo", F.col("name").alias("target"), "end"), ["repo", "target"], "left"))
    led, seen = stage(led, f"{label}-led", edges=F.count(F.lit(1)))
    left = led.select("repo", "source", F.coalesce("end", "target").alias("target")).distinct()
    return left, _Followers(led.filter("end is not null"), ends, jumps), rings, seen["edges"]


def _unfollow(reps: DataFrame, took: _Followers, label: str) -> DataFrame:
    """``reps`` (repo, name, rep) with the followers that lie on cycles: those on the way from an entry to its end, if both are on one cycle."""
    of = lambda end: reps.select("repo", F.col("name").alias(end), F.col("rep").alias(f"_{end}"))
    inner = took.entries.join(of("source"), ["repo", "source"]).join(of("end"), ["repo", "end"]).filter("_source = _end")
    marked, seen = stage(inner.select("repo", F.col("target").alias("name")).distinct(), f"{label}-marked", n=F.count(F.lit(1)))
    if not seen["n"]:
        return reps
    for k in reversed(range(len(took.jumps))):
        further = marked.join(took.jumps[k], ["repo", "name"]).select("repo", F.col("next").alias("name"))
        marked, _ = stage(marked.union(further).distinct(), f"{label}-marked-{k}")
    on = marked.join(took.ends, ["repo", "name"]).join(of("end"), ["repo", "end"]).select("repo", "name", F.col("_end").alias("rep"))
    return stage(reps.union(on), f"{label}-reps")[0]


def _colours(pairs: DataFrame, label: str) -> DataFrame:
    """(repo, name, rep) of some strong components, at least one of each graph.

    Every node takes the least name among itself and the nodes that reach it;
    a node that keeps its own name roots a component, made of the nodes with
    its colour that reach back to it: many roots at once.
    """
    ends = pairs.select("repo", F.col("source").alias("name")).union(pairs.select("repo", F.col("target").alias("name")))
    colour = _spread(ends.distinct().withColumn("mark", F.col("name")), pairs, f"{label}-colour")
    tint = lambda col: colour.select("repo", F.col("name").alias(col), F.col("mark").alias(f"_{col}"))
    same = pairs.join(tint("source"), ["repo", "source"]).join(tint("target"), ["repo", "target"]).filter("_source = _target")
    same, _ = stage(same.select("repo", "source", "target"), f"{label}-same")
    back = _spread(colour.filter("name = mark"), _flip(same), f"{label}-back")
    return back.select("repo", "name", F.col("mark").alias("rep"))


def _cycles(pairs: DataFrame) -> DataFrame:
    """(repo, name, scc_id) of the nodes on cycles, for a graph whose nodes all reach a cycle.

    Nodes that no cycle reaches go first. Then nodes with a single edge out, or
    in, are taken out in turn, with rings and chains of any length in a
    logarithm of rounds, until what is left has neither; of that, colours find
    components. Last, the nodes taken out join the components they lie on.
    """
    _, reached = _settle(_flip(pairs).withColumn("w", F.lit(1).cast("long")), "reached")
    if reached is None:
        return pairs.limit(0).select("repo", F.col("source").alias("name"), F.col("target").alias("scc_id"))
    left, seen = stage(_inside(pairs, reached), "core", n=F.count(F.lit(1)))
    undo: list[tuple[_Followers, DataFrame]] = []  # and the nodes that were left then with an edge to themselves
    found: list[DataFrame] = []
    none = left.limit(0).select("repo", F.col("source").alias("name"), F.col("target").alias("rep"))
    turn, idle, flipped = 0, 0, False
    while seen["n"]:
        arcs = _flip(left) if flipped else left
        took = _follow(arcs, f"follow-{turn}")
        if took:
            rest, followers, rings, _ = took
            found.append(rings)
            loops = rest.filter("source = target").select("repo", F.col("source").alias("name"))
            undo.append((followers, loops))
            rest, idle = rest.filter("source <> target"), 0
        else:
            rest, idle = arcs, idle + 1
        rest = _flip(rest) if flipped else rest
        if idle == 2:  # neither way
            part, _ = stage(_colours(rest, f"core-{turn}"), f"part-{turn}")
            found.append(part)
            for end in ("source", "target"):
                rest = rest.join(part.select("repo", F.col("name").alias(end)), ["repo", end], "left_anti")
            idle = 0
        if took or idle == 0:
            left, seen = stage(rest, f"left-{turn}", n=F.count(F.lit(1)))
        flipped, turn = not flipped, turn + 1
    reps = _union(found) if found else none
    for k, (followers, loops) in enumerate(reversed(undo)):
        alone = loops.join(reps, ["repo", "name"], "left_anti").select("repo", "name", F.col("name").alias("rep"))
        reps = _unfollow(reps.union(alone), followers, f"undo-{k}")
    # a component is named by the least of its names
    names = reps.groupBy("repo", "rep").agg(F.min("name").alias("scc_id"))
    return reps.join(names, ["repo", "rep"]).select("repo", "name", "scc_id")


# --- cycles and depth --------------------------------------------------------


def _inner_pairs(components: DataFrame, edges: DataFrame, loops: bool = False) -> DataFrame:
    """Distinct depends_on pairs between known components, self-loops only if asked for."""
    pairs = simple_graph(edges)
    if not loops:
        pairs = pairs.filter("source <> target")
    for end in ("source", "target"):
        pairs = pairs.join(components.select("repo", F.col("name").alias(end)), ["repo", end], "left_semi")
    return pairs


@dataclass(frozen=True)
class _Layers:
    scc: DataFrame  # repo, name, scc_id (only nodes of cycles)
    depth: DataFrame  # repo, name, depth (only nodes with dependencies)


def _layers(components: DataFrame, edges: DataFrame, need_depth: bool = True) -> _Layers:
    pairs, _ = stage(_inner_pairs(components, edges), "pairs")
    unit = F.lit(1).cast("long")
    flat, stuck = _settle(pairs.withColumn("w", unit), "depth")
    if stuck is None:
        return _Layers(flat.limit(0).select("repo", "name", F.col("name").alias("scc_id")), flat)
    flat, _ = stage(flat, "settled")
    inner, _ = stage(_inside(pairs, stuck), "inner")
    scc, _ = stage(_cycles(inner), "cycles")
    if not need_depth:
        return _Layers(scc, flat)

    # The part above the cycles, with every cycle shrunk to one node; what is settled below gives floors.
    def shrink(df: DataFrame, end: str) -> DataFrame:
        short = scc.select("repo", F.col("name").alias(end), F.col("scc_id").alias("_scc"))
        return df.join(short, ["repo", end], "left").withColumn(end, F.coalesce("_scc", end)).drop("_scc")

    below = (
        pairs.join(stuck.select("repo", F.col("name").alias("source")), ["repo", "source"], "left_semi")
        .join(stuck.select("repo", F.col("name").alias("target")), ["repo", "target"], "left_anti")
        .join(flat.select("repo", F.col("name").alias("target"), "depth"), ["repo", "target"], "left")
        .select("repo", "source", F.lit("").alias("target"), (F.coalesce("depth", F.lit(0)) + 1).alias("w")))
    above = shrink(inner, "target").withColumn("w", unit).unionByName(below)
    rows = shrink(above, "source").filter("source <> target").groupBy("repo", "source", "target").agg(F.max("w").alias("w"))
    by_node, rest = _settle(stage(rows, "shrunk")[0], "above")
    if rest is not None:
        raise RuntimeError("a cycle was left after shrinking the strong components")
    members = stuck.join(scc, ["repo", "name"], "left").withColumn("scc_id", F.coalesce("scc_id", "name"))
    upper = members.join(by_node.select("repo", F.col("name").alias("scc_id"), "depth"), ["repo", "scc_id"], "left")
    return _Layers(scc, flat.unionByName(upper.select("repo", "name", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))))


def strong_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, name, scc_id): nodes on a common cycle share the least of their names."""
    scc = _layers(components, edges, need_depth=False).scc
    return components.select("repo", "name").distinct().join(scc, ["repo", "name"], "left").select(
        "repo", "name", F.coalesce("scc_id", "name").alias("scc_id")
    )


def depth_levels(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, name, scc_id, depth): 0 without dependencies, else one more than the
    deepest dependency; nodes of one cycle share a level."""
    layers = _layers(components, edges)
    return (
        components.select("repo", "name").distinct()
        .join(layers.scc, ["repo", "name"], "left")
        .join(layers.depth, ["repo", "name"], "left")
        .select(
            "repo", "name", F.coalesce("scc_id", "name").alias("scc_id"),
            F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
        )
    )


class CycleError(ValueError):
    """Raised when an order is asked for nodes that depend on each other."""


def topological_order(subset: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, name, level): dependency-first order inside ``subset`` (repo, name).

    Sorting by (level, name) gives the order. Fails on a cycle.
    """
    pairs, seen = stage(_inner_pairs(subset, edges, loops=True), "pairs", loops=F.count_if(F.col("source") == F.col("target")))
    if seen["loops"]:
        raise CycleError("the subset has a dependency cycle")
    level, stuck = _settle(pairs.withColumn("w", F.lit(1).cast("long")), "order")
    if stuck is not None:
        raise CycleError("the subset has a dependency cycle")
    level = level.withColumnRenamed("depth", "level")
    return subset.select("repo", "name").distinct().join(level, ["repo", "name"], "left").select(
        "repo", "name", F.coalesce("level", F.lit(0)).cast("int").alias("level")
    )


# --- summaries ---------------------------------------------------------------


def level_summary(components: DataFrame, levels: DataFrame) -> DataFrame:
    """(repo, depth, kind, components)."""
    return (
        levels.select("repo", "name", "depth").join(components.select("repo", "name", "kind"), ["repo", "name"])
        .groupBy("repo", "depth", "kind").agg(F.count("*").alias("components"))
    )


def graph_stats(graph: Graph, analyses: DataFrame | None = None) -> DataFrame:
    """(repo, metric, value): node, service, edge and analysis counts, by kind and edge type."""

    def count(df: DataFrame, metric: Column) -> DataFrame:
        return df.groupBy("repo", metric.alias("metric")).agg(F.count("*").alias("value"))

    parts = [
        count(graph.components, F.lit("component_count")),
        count(graph.components, F.concat(F.lit("by_kind."), F.col("kind"))),
        count(graph.edges, F.lit("edge_count")),
        count(graph.edges, F.concat(F.lit("by_edge_type."), F.col("edge_type"))),
    ]
    if graph.services is not None:
        parts.append(count(graph.services, F.lit("external_service_count")))
    if analyses is not None:
        parts.append(count(analyses.select("repo", "component").distinct(), F.lit("analyzed_count")))
    return _union(parts)


def cited_by_edges(citations: DataFrame) -> DataFrame:
    """Provenance edges component -> cited file."""
    pairs = citations.select("repo", F.col("component").alias("source"), F.col("file_path").alias("target")).distinct()
    return typed_edges(pairs, "cited_by")
