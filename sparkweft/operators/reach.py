"""Reachability, distances and bounded walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_PATH_NODES, MAX_PATHS, UNREACHABLE
from ..functions.scores import exploit_score
from ..session import counted, cut, if_small
from . import whole

P = "project_id"


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_hops: int | None = None, most: int = whole.WHOLE) -> DataFrame:
    """(project_id, source, node, hops): what each seed (project_id, source) reaches, itself excluded.

    Only the seeds' closure is made, never that of all nodes. Projects of up to ``most``
    edges are searched in one pass, and their closure is stored nowhere; larger ones by rounds.
    """
    if direction not in ("down", "up"):
        raise ValueError("direction is down or up")
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    return whole.parted(edges, most, lambda e, s: whole.reach(e, s, a, b, max_hops), lambda e, s: _reach_by_rounds(e, s, a, b, max_hops), seeds.select(P, "source"))


def _reach_by_rounds(edges: DataFrame, seeds: DataFrame, a: str, b: str, max_hops: int | None) -> DataFrame:
    """Semi-naive: a round joins the last round's new pairs with the edges and keeps what wasn't seen."""
    steps = cut(edges.select(P, F.col(a).alias("at"), F.col(b).alias("to")).distinct())
    frontier = seeds.select(P, "source").distinct().withColumn("at", F.col("source"))
    seen, hops = None, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        new = frontier.join(steps, [P, "at"]).filter("to <> source").select(P, "source", F.col("to").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, [P, "source", "node"], "left_anti")
        new, n = counted(new.withColumn("hops", F.lit(hops)))
        if hops > 1 and not n:
            break
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.select(P, "source", F.col("node").alias("at"))
    return seen if seen is not None else seeds.select(P, "source", F.col("source").alias("node"), F.lit(0).alias("hops")).limit(0)


def hops_to(edges: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(project_id, node, hops): the fewest steps, up to ``most``, from each node to any target (project_id, node); 0 for targets."""
    frontier, n = counted(targets.select(P, "node").distinct().withColumn("hops", F.lit(0)))
    seen, hops = frontier, 0
    while hops < most and n:
        hops += 1
        new = edges.join(frontier.select(P, F.col("node").alias("dst")), [P, "dst"]).select(P, F.col("src").alias("node")).distinct()
        frontier, n = counted(new.join(seen, [P, "node"], "left_anti").withColumn("hops", F.lit(hops)))
        seen = seen.unionByName(frontier)
    return seen


def attack_paths(edges: DataFrame, blast: DataFrame, sinks: DataFrame, max_nodes: int = MAX_PATH_NODES, top: int = MAX_PATHS, simple_paths: bool = False, most: int = whole.WHOLE) -> DataFrame:
    """The best ``top`` walks from each vulnerable node to a sink.

    ``blast``: project_id, source_node, cvss_score, multiplier. ``sinks``: node, sink_type.
    A walk ends at its first sink and has at most ``max_nodes`` nodes; it may come by a
    node again unless ``simple_paths``. Steps from which no sink can be reached within
    the nodes left are never taken. The score uses the source's multiplier; NETWORK if
    nothing leads to the source, else LOCAL. Ties go by path. Returns project_id, source,
    path, sink_node, sink_type, path_length (nodes), exploit_score, exploitability, rank.

    For one source the score never rises with the length, so its best walks are the
    first ones by (length, path), and two exact rules keep a round small. A source with
    ``top`` finished walks is done. Of its open walks of one length that stand at one
    node only the ``top`` smallest go on, as whatever follows can follow each of them
    (not so with ``simple_paths``, where what can follow depends on the walk). Without
    ``simple_paths`` projects of up to ``most`` edges go in one pass by the same rules.
    """
    kinds = if_small(sinks.select(F.col("node").alias("dst"), "sink_type"))
    sources = blast.select(P, F.col("source_node").alias("source"))
    rounds = lambda e, s: _walks_by_rounds(e, s, kinds, max_nodes, top, simple_paths)
    ended = rounds(edges, sources) if simple_paths else whole.parted(edges, most, lambda e, s: whole.walks(e, s, kinds, max_nodes, top), rounds, sources)
    entered = edges.select(P, F.col("dst").alias("source")).distinct().withColumn("entered", F.lit(True))
    scored = ended.join(blast.select(P, F.col("source_node").alias("source"), "cvss_score", "multiplier"), [P, "source"]).join(entered, [P, "source"], "left")
    n = F.size("path")
    rows = scored.select(
        P, "source", "path", F.col("at").alias("sink_node"), "sink_type", n.alias("path_length"),
        exploit_score(F.col("cvss_score"), n, F.col("multiplier")).alias("exploit_score"),
        F.when(F.col("entered"), "LOCAL").otherwise("NETWORK").alias("exploitability"),
    )
    best = Window.partitionBy(P, "source").orderBy(F.desc("exploit_score"), "path_length", "path")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def _walks_by_rounds(edges: DataFrame, sources: DataFrame, kinds: DataFrame, max_nodes: int, top: int, simple_paths: bool) -> DataFrame:
    """(project_id, source, at, path, sink_type): finished walks, the best ``top`` of each source among them."""
    hot = edges.join(kinds, "dst").select(P, F.col("dst").alias("node"))
    far = hops_to(edges, hot, max_nodes - 1).select(P, F.col("node").alias("dst"), "hops")
    steps = cut(edges.join(far, [P, "dst"]).join(kinds, "dst", "left").select(P, F.col("src").alias("at"), "dst", "sink_type", "hops"))
    walk = sources.select(P, "source", F.col("source").alias("at"), F.array("source").alias("path"))
    ended = None
    for n in range(2, max_nodes + 1):
        nxt = walk.join(steps, [P, "at"]).filter(F.col("hops") <= max_nodes - n)
        if simple_paths:
            nxt = nxt.filter(~F.array_contains("path", F.col("dst")))
        nxt = nxt.select(P, "source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), "sink_type")
        if not simple_paths:
            smallest = Window.partitionBy(P, "source", "at").orderBy("path")
            nxt = nxt.withColumn("__n", F.row_number().over(smallest)).filter(F.col("__n") <= top).drop("__n")
        nxt, found = counted(nxt)
        done = nxt.filter("sink_type IS NOT NULL")
        ended = done if ended is None else ended.unionByName(done)
        full = ended.groupBy(P, "source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= top).select(P, "source")
        if not found:
            break
        walk = nxt.filter("sink_type IS NULL").drop("sink_type").join(full, [P, "source"], "left_anti")
    return ended


def _both_ways(edges: DataFrame) -> DataFrame:
    """(project_id, at, to): the steps over edges taken both ways."""
    plain = edges.filter("src <> dst")
    return cut(plain.select(P, F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(plain.select(P, F.col("dst").alias("at"), F.col("src").alias("to"))).distinct())


def _shortest_ways(steps: DataFrame, starts: DataFrame, max_hops: int | None) -> DataFrame:
    """(project_id, u, node, path): the smallest shortest path from each start (project_id, node, most) to all within ``most`` steps (null: any)."""
    frontier = cut(starts.select(P, F.col("node").alias("u"), "node", "most", F.array("node").alias("path")))
    seen, hops = frontier, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        open_ = frontier.filter(F.col("most").isNull() | (F.col("most") >= hops))
        new = open_.withColumnRenamed("node", "at").join(steps, [P, "at"]).groupBy(P, "u", F.col("to").alias("node")).agg(F.min(F.concat("path", F.array("to"))).alias("path"), F.first("most").alias("most"))
        frontier, n = counted(new.join(seen.select(P, "u", "node"), [P, "u", "node"], "left_anti"))
        if not n:
            break
        seen = seen.unionByName(frontier)
    return seen.select(P, "u", "node", "path")


def metric_closure(edges: DataFrame, terminals: DataFrame, max_hops: int | None = None, most: int = whole.WHOLE) -> DataFrame:
    """(project_id, u, v, weight, path) for each pair u < v of a project's terminals (project_id, node).

    Hop distance over edges taken both ways, with the smallest shortest path; pairs that
    don't meet have weight 1000 and no path. Projects of up to ``most`` edges go in one
    pass, larger ones by rounds. All pairs are its result: see :func:`terminal_tree` for a
    tree of them and :func:`near_closure` for those that a spanning tree can use.
    """
    return whole.parted(edges, most, lambda e, t: whole.distances(e, t, max_hops), lambda e, t: _closure_by_rounds(e, t, max_hops), terminals.select(P, "node"))


def terminal_tree(edges: DataFrame, terminals: DataFrame, max_hops: int | None = None, most: int = whole.WHOLE) -> DataFrame:
    """(project_id, u, v, weight, path): the rows of :func:`metric_closure` that are its :func:`mst`."""

    def rounds(some: DataFrame, ends: DataFrame) -> DataFrame:
        closure = cut(_closure_by_rounds(some, ends, max_hops))
        return mst(closure).join(closure.select(P, "u", "v", "path"), [P, "u", "v"]).select(P, "u", "v", "weight", "path")

    return whole.parted(edges, most, lambda e, t: whole.tree(e, t, max_hops), rounds, terminals.select(P, "node"))


def _closure_by_rounds(edges: DataFrame, terminals: DataFrame, max_hops: int | None) -> DataFrame:
    """A breadth-first search from all terminals at once."""
    terminals = terminals.select(P, "node").distinct()
    seen = _shortest_ways(_both_ways(edges), terminals.withColumn("most", F.lit(None).cast("int")), max_hops)
    pairs = terminals.select(P, F.col("node").alias("u")).join(terminals.select(P, F.col("node").alias("v")), P).filter("u < v")
    found = seen.select(P, "u", F.col("node").alias("v"), "path")
    return pairs.join(found, [P, "u", "v"], "left").select(P, "u", "v", F.coalesce(F.size("path") - 1, F.lit(UNREACHABLE)).alias("weight"), "path").select(
        P, "u", "v", F.when(F.col("path").isNull(), F.lit(UNREACHABLE)).otherwise(F.col("weight")).alias("weight"), "path"
    )


def _regions(steps: DataFrame, terminals: DataFrame) -> DataFrame:
    """(project_id, node, root, far): the nearest terminal of each node, the smallest of equally near ones, and its distance."""
    frontier, n = counted(terminals.select(P, "node", F.col("node").alias("root"), F.lit(0).alias("far")))
    seen, far = frontier, 0
    while n:
        far += 1
        new = frontier.select(P, F.col("node").alias("at"), "root").join(steps, [P, "at"]).groupBy(P, F.col("to").alias("node")).agg(F.min("root").alias("root"))
        frontier, n = counted(new.join(seen, [P, "node"], "left_anti").withColumn("far", F.lit(far)))
        seen = seen.unionByName(frontier)
    return seen


def border_tree(edges: DataFrame, terminals: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(project_id, u, v, weight): a minimum spanning forest of the terminals' distances, without the distances.

    One search from all terminals at once gives each node its nearest terminal. An edge
    between two regions is a way between their terminals; the shortest one of each pair of
    neighbouring regions is enough for a forest of the same weights as that of all pairs.
    There are at most as many rows as nodes and edges, however many terminals there are.
    Terminals that don't meet stay apart. Which of equally heavy trees comes out may differ
    from that of all pairs.
    """
    steps = _both_ways(edges) if steps is None else steps
    regions = cut(_regions(steps, terminals.select(P, "node").distinct()))
    side = lambda c, k: regions.select(P, F.col("node").alias(c), F.col("root").alias(k), F.col("far").alias(f"far_{k}"))
    border = steps.join(side("at", "u"), [P, "at"]).join(side("to", "v"), [P, "to"]).filter("u < v")
    return mst(border.groupBy(P, "u", "v").agg(F.min(F.col("far_u") + F.col("far_v") + 1).alias("weight")))


def near_closure(edges: DataFrame, terminals: DataFrame, max_hops: int | None = None) -> DataFrame:
    """The rows of :func:`metric_closure` that its spanning tree can have: pairs no further apart than the tree's longest edge.

    All minimum spanning trees have the same weights, so :func:`border_tree` tells the
    longest edge in each project before any pair is searched, and a search from a
    terminal ends there. The tree of these pairs, ties by (weight, u, v), is that of all
    pairs but for pairs that don't meet, which have no path. A project of one terminal is
    not searched at all.
    """
    steps = _both_ways(edges)
    most = border_tree(edges, terminals, steps).groupBy(P).agg(F.max("weight").cast("int").alias("most"))
    seen = _shortest_ways(steps, terminals.select(P, "node").distinct().join(most, P), max_hops)
    met = seen.join(terminals.select(P, "node").distinct(), [P, "node"], "left_semi").filter("u < node")
    return met.select(P, "u", F.col("node").alias("v"), (F.size("path") - 1).alias("weight"), "path")


def mst(closure: DataFrame) -> DataFrame:
    """Minimum spanning tree of each project's closure, by the total order (weight, u, v); Boruvka rounds."""
    pairs = cut(closure.select(P, "u", "v", "weight"))
    label = cut(pairs.select(P, F.col("u").alias("node")).unionByName(pairs.select(P, F.col("v").alias("node"))).distinct().withColumn("c", F.col("node")))
    tree = None
    while True:
        side = lambda k: label.select(P, F.col("node").alias(k), F.col("c").alias(f"c{k}"))
        cross = pairs.join(side("u"), [P, "u"]).join(side("v"), [P, "v"]).filter("cu <> cv")
        ends = cross.select(P, F.col("cu").alias("c"), "u", "v", "weight", "cu", "cv").unionByName(cross.select(P, F.col("cv").alias("c"), "u", "v", "weight", "cu", "cv"))
        best, n = counted(ends.groupBy(P, "c").agg(F.min(F.struct("weight", "u", "v", "cu", "cv")).alias("__edge")).select(P, "__edge.*").distinct())
        if not n:
            break
        own = best.select(P, "u", "v", "weight")
        tree = own if tree is None else tree.unionByName(own)
        names = cut(label.select(P, "c").distinct().withColumn("to", F.col("c")))
        links = best.select(P, F.col("cu").alias("c"), F.col("cv").alias("d")).unionByName(best.select(P, F.col("cv").alias("c"), F.col("cu").alias("d")))
        while True:  # the smallest name spreads over the chosen edges
            low = links.join(names.select(P, F.col("c").alias("d"), F.col("to").alias("t")), [P, "d"]).groupBy(P, "c").agg(F.min("t").alias("t"))
            new = cut(names.join(low, [P, "c"], "left").select(P, "c", F.least("to", F.coalesce("t", "to")).alias("to"), F.col("to").alias("old")))
            names = new.drop("old")
            if new.filter("to <> old").isEmpty():
                break
        label = cut(label.join(names, [P, "c"]).select(P, "node", F.col("to").alias("c")))
    return tree if tree is not None else pairs.limit(0)
