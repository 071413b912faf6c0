"""Build graphs from dependency rows; degrees, cycles and orders of many graphs at once.

Graphs are two tables: nodes (project_id, name, ...) and edges (project_id, src, dst),
src depending on dst. The iterations are rounds of joins with a reliable checkpoint
each; only a round's emptiness reaches the driver. Projects that a task can hold go in
one pass instead (``whole``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ROOT
from ..functions.versions import compare_keys, with_keys
from ..session import counted, cut
from . import whole

P = "project_id"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def resolve_nodes(deps: DataFrame, prefer_resolved: bool = False) -> DataFrame:
    """One row per (project_id, name): the highest version wins, of equal ones the first by ``seq``.

    With ``prefer_resolved`` a package that has installed versions (column ``resolved``)
    goes by these alone; a version that is only asked for can't outrank them.

    Comparison isn't transitive, so the rows of a name are folded in their order;
    equal candidates are dropped first (a fold keeps the first of them anyway).
    """
    if prefer_resolved:
        best = F.max("resolved").over(Window.partitionBy(P, "name"))
        deps = deps.withColumn("__best", best).filter(F.col("resolved").eqNullSafe(F.col("__best"))).drop("__best")
    first = deps.groupBy(P, "name", "version").agg(F.min_by(F.struct("seq", "ecosystem", "is_direct", "is_dev"), "seq").alias("d"))
    first = with_keys(first, "version", "key")
    one = F.struct(F.col("d.seq").alias("seq"), "version", "key", F.col("d.ecosystem").alias("ecosystem"), F.col("d.is_direct").alias("is_direct"), F.col("d.is_dev").alias("is_dev"))
    folded = first.groupBy(P, "name").agg(F.sort_array(F.collect_list(one)).alias("c"))
    best = F.aggregate(F.slice(F.col("c"), 2, F.greatest(F.size("c") - 1, F.lit(0))), F.element_at("c", 1), lambda acc, x: F.when(compare_keys(x["key"], acc["key"]) > 0, x).otherwise(acc))
    return folded.select(P, "name", best.alias("b")).select(P, "name", "b.version", "b.ecosystem", "b.is_direct", "b.is_dev")


def project_ecosystem(deps: DataFrame) -> DataFrame:
    """The most frequent ecosystem of each project, the first seen (by ``seq``) on ties."""
    n = deps.groupBy(P, F.coalesce("ecosystem", F.lit("unknown")).alias("ecosystem")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return n.groupBy(P).agg(F.max_by("ecosystem", F.struct("n", -F.col("first"))).alias("ecosystem"))


def build_graph(deps: DataFrame) -> Graph:
    """Nodes and edges of all projects from dependency rows.

    The root points to direct dependencies without a parent, every parent (other than
    itself) to its dependency. Parents that no row names become nodes of version
    ``unknown``; the root has version 0.0.0 if it points to an orphan direct
    dependency, else ``unknown``.
    """
    from_root = deps.filter("is_direct AND parent IS NULL").select(P, F.lit(ROOT).alias("src"), F.col("name").alias("dst"))
    named = deps.filter("parent IS NOT NULL AND parent <> name").select(P, F.col("parent").alias("src"), F.col("name").alias("dst"))
    edges = from_root.unionByName(named).distinct()
    known = resolve_nodes(deps)
    roots = from_root.select(P, F.col("src").alias("name"), F.lit("0.0.0").alias("version"))
    parents = named.select(P, F.col("src").alias("name"), F.lit("unknown").alias("version"))
    missing = roots.unionByName(parents).groupBy(P, "name").agg(F.min("version").alias("version")).join(known, [P, "name"], "left_anti")
    extra = missing.select(P, "name", "version", F.lit("unknown").alias("ecosystem"), F.lit(False).alias("is_direct"), F.lit(False).alias("is_dev"))
    return Graph(known.unionByName(extra), edges)


def sizes(graph: Graph) -> DataFrame:
    """(project_id, n_nodes, n_edges), the root included."""
    n = graph.nodes.groupBy(P).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = graph.edges.groupBy(P).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, P, "left").select(P, "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """(project_id, name, in_degree, out_degree) of all end points."""
    ends = edges.select(P, F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(P, F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy(P, "name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _trim(edges: DataFrame) -> DataFrame:
    """Peel off edges into nodes without a way on, and out of nodes without a way in, until none is left to peel."""
    edges, left = counted(edges)
    while left:
        srcs, dsts = edges.select(P, F.col("src").alias("dst")).distinct(), edges.select(P, F.col("dst").alias("src")).distinct()
        edges, now = counted(edges.join(srcs, [P, "dst"], "left_semi").join(dsts, [P, "src"], "left_semi").select(P, "src", "dst"))
        if now == left:
            break
        left = now
    return edges


def scc(edges: DataFrame, most: int = whole.WHOLE) -> DataFrame:
    """(project_id, node, scc_id): strongly connected components, scc_id the smallest member.

    Self loops change nothing. Projects of up to ``most`` edges go in one pass, larger ones
    by rounds. The edges are read twice, so they should be kept.
    """
    return whole.parted(edges.filter("src <> dst").select(P, "src", "dst"), most, whole.components, _scc_by_rounds)


def _scc_by_rounds(edges: DataFrame) -> DataFrame:
    """Nodes off all cycles are trimmed. On the rest, the smallest id spreads forward to a
    fixpoint; the nodes that reach their colour's root backward within the colour are
    the root's component. They go, and the rest starts anew.
    """
    edges = cut(edges.distinct())
    nodes = edges.select(P, F.col("src").alias("node")).unionByName(edges.select(P, F.col("dst").alias("node"))).distinct()
    found, rest = None, _trim(edges)
    while not rest.isEmpty():
        colour = cut(rest.select(P, F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # forward, two steps in a round by way of the colours' own colours
            step = rest.join(colour.withColumnRenamed("node", "src"), [P, "src"]).groupBy(P, F.col("dst").alias("node")).agg(F.min("colour").alias("in"))
            new = colour.join(step, [P, "node"], "left").select(P, "node", F.least("colour", F.coalesce("in", "colour")).alias("colour"), F.col("colour").alias("old"))
            jump = new.select(P, F.col("node").alias("colour"), F.col("colour").alias("next"))
            new = cut(new.join(jump, [P, "colour"]).select(P, "node", F.col("next").alias("colour"), "old"))
            done = new.filter("colour <> old").isEmpty()
            colour = new.drop("old")
            if done:
                break
        inside = rest.join(colour.select(P, F.col("node").alias("src"), F.col("colour").alias("a")), [P, "src"]).join(colour.select(P, F.col("node").alias("dst"), F.col("colour").alias("b")), [P, "dst"])
        inside = cut(inside.filter("a = b").select(P, "src", "dst", F.col("a").alias("colour")))
        reached = frontier = cut(colour.filter("node = colour"))
        while True:
            new = inside.join(frontier.withColumnRenamed("node", "dst"), [P, "dst", "colour"]).select(P, F.col("src").alias("node"), "colour").distinct()
            frontier, n = counted(new.join(reached, [P, "node"], "left_anti"))
            if not n:
                break
            reached = reached.unionByName(frontier)
        reached = cut(reached)
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select(P, "node")
        rest = rest.join(gone.withColumnRenamed("node", "src"), [P, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [P, "dst"], "left_anti")
        rest = _trim(rest.select(P, "src", "dst"))
    if found is None:
        return nodes.withColumn("scc_id", F.col("node"))
    return nodes.join(found, [P, "node"], "left").select(P, "node", F.coalesce("colour", "node").alias("scc_id"))


def break_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """An acyclic subgraph: within a component, only edges from a higher to a lower in-degree (then name) stay."""
    own = cut(degrees(edges).select(P, F.col("name").alias("node"), "in_degree").join(components, [P, "node"]))
    side = lambda k: own.select(P, F.col("node").alias(k), F.col("scc_id").alias(f"c_{k}"), F.col("in_degree").alias(f"d_{k}"))
    both = edges.join(side("src"), [P, "src"]).join(side("dst"), [P, "dst"])
    forward = (F.col("d_src") > F.col("d_dst")) | ((F.col("d_src") == F.col("d_dst")) & (F.col("src") < F.col("dst")))
    return both.filter((F.col("c_src") != F.col("c_dst")) | forward).select(P, "src", "dst")


def witness_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(project_id, scc_id, cycle): for each component of two or more nodes one of its cycles, as a proof of it.

    The cycle begins and ends at the smallest member and is the shortest one through it; of
    several the smallest as an array. All components are searched at once from their
    smallest members; of the ways to a node the smallest is kept, and a component that has
    come back is done.
    """
    components = cut(components)
    member = lambda k, c: components.select(P, F.col("node").alias(k), F.col("scc_id").alias(c))
    inside = edges.filter("src <> dst").select(P, "src", "dst").distinct().join(member("src", "scc_id"), [P, "src"]).join(member("dst", "other"), [P, "dst"]).filter("scc_id = other")
    inside = cut(inside.select(P, "scc_id", "src", "dst"))
    way = inside.filter("src = scc_id").select(P, "scc_id", F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    seen = done = None
    while True:
        if seen is not None:
            way = way.join(seen, [P, "scc_id", "node"], "left_anti")
        way, n = counted(way)
        if not n:
            break
        back = way.filter("node = scc_id").select(P, "scc_id", F.col("path").alias("cycle"))
        done = back if done is None else done.unionByName(back)
        seen = way.select(P, "scc_id", "node") if seen is None else seen.unionByName(way.select(P, "scc_id", "node"))
        open_ = way.join(back.select(P, "scc_id"), [P, "scc_id"], "left_anti")
        way = open_.withColumnRenamed("node", "src").join(inside, [P, "scc_id", "src"]).groupBy(P, "scc_id", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
    return done if done is not None else way.select(P, "scc_id", F.col("path").alias("cycle"))


def topological_levels(edges: DataFrame, most: int = whole.WHOLE) -> DataFrame:
    """(project_id, node, level, rank) of acyclic edges: level is the longest way in, rank 0.. by (level, node).

    Nodes are peeled off level by level. Edges on cycles are never peeled: their nodes
    and those behind them come last, on one level after all others. Projects of up to
    ``most`` edges go in one pass, larger ones by rounds.
    """
    every = whole.parted(cut(edges.select(P, "src", "dst").distinct()), most, whole.levels, _levels_by_rounds)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy(P).orderBy("level", "node")) - 1)


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """(project_id, node, level)."""
    left, more = counted(edges)
    nodes = left.select(P, F.col("src").alias("node")).unionByName(left.select(P, F.col("dst").alias("node"))).distinct()
    levels, level = None, 0
    while more:
        free = left.select(P, F.col("src").alias("node")).distinct().join(left.select(P, F.col("dst").alias("node")).distinct(), [P, "node"], "left_anti")
        free, n = counted(free.withColumn("level", F.lit(level)))
        if not n:
            break
        levels = free if levels is None else levels.unionByName(free)
        left, more = counted(left.join(free.select(P, F.col("node").alias("src")), [P, "src"], "left_anti").select(P, "src", "dst"))
        level += 1
    if levels is None:
        levels = nodes.limit(0).withColumn("level", F.lit(0))
    # what was never a free source: leaves, one level below their deepest parent
    rest = nodes.join(levels, [P, "node"], "left_anti")
    above = edges.join(levels.select(P, F.col("node").alias("src"), "level"), [P, "src"]).groupBy(P, F.col("dst").alias("node")).agg((F.max("level") + 1).alias("level"))
    stuck = left.select(P, F.col("src").alias("node")).unionByName(left.select(P, F.col("dst").alias("node"))).distinct().withColumn("stuck", F.lit(True))
    leaves = rest.join(above, [P, "node"], "left").join(stuck, [P, "node"], "left").select(P, "node", F.when(F.col("stuck"), F.lit(level)).otherwise(F.coalesce("level", F.lit(level))).alias("level"))
    return levels.unionByName(leaves)
