"""Minimum patch sets: terminals, spanning tree, candidates, cover, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BLAST_THRESHOLD
from ..functions.scores import effort, savings_pct
from ..session import cut, kept
from .graph import break_cycles, scc, topological_levels
from .reach import mst, near_closure, terminal_tree

P = "project_id"


def terminals(blast: DataFrame, threshold: float = BLAST_THRESHOLD, fallback: int = 5) -> DataFrame:
    """(project_id, node): blast score above the threshold, else a project's first ``fallback`` by rank."""
    over = blast.withColumn("hits", F.sum(F.when(F.col("blast_radius_score") > threshold, 1).otherwise(0)).over(Window.partitionBy(P)))
    return over.filter((F.col("blast_radius_score") > threshold) | ((F.col("hits") == 0) & (F.col("rank") <= fallback))).select(P, F.col("source_node").alias("node"))


def patch_candidates(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(project_id, package): terminals and the nodes on the shortest paths (column ``path``) behind the tree's edges."""
    on = tree.select(P, F.explode("path").alias("package"))
    return on.unionByName(ends.select(P, F.col("node").alias("package"))).distinct()


def path_cover(candidates: DataFrame, paths: DataFrame, ends: DataFrame) -> DataFrame:
    """(project_id, package, covered): the packages kept by one pass in order of coverage.

    Candidates go by the number of paths (project_id, path_id, path) that hold them,
    then name; one is kept if it is the first of them on some path. If a path holds
    none, all terminals come too; without paths the terminals are the answer.
    """
    nodes = paths.select(P, "path_id", F.explode("path").alias("package")).distinct()
    on = nodes.join(candidates, [P, "package"])
    cover = on.groupBy(P, "package").agg(F.count(F.lit(1)).alias("covered"))
    ranked = on.join(cover, [P, "package"]).groupBy(P, "path_id").agg(F.min_by("package", F.struct((-F.col("covered")).alias("c"), "package")).alias("package"))
    kept = ranked.select(P, "package").distinct()
    n = paths.select(P, "path_id").distinct().groupBy(P).agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.groupBy(P).agg(F.count(F.lit(1)).alias("h"))
    full = n.join(hit, P, "left").filter("h = n").select(P)
    extra = ends.select(P, F.col("node").alias("package")).join(full, P, "left_anti")
    return kept.unionByName(extra).distinct().join(cover, [P, "package"], "left").select(P, "package", F.coalesce("covered", F.lit(0)).alias("covered"))


def update_order(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """(project_id, package, update_rank): parents first, on the edges among the packages, cycles broken."""
    inner = edges.join(packages.select(P, F.col("package").alias("src")), [P, "src"], "left_semi").join(packages.select(P, F.col("package").alias("dst")), [P, "dst"], "left_semi")
    inner = cut(inner.select(P, "src", "dst").filter("src <> dst"))
    levels = topological_levels(break_cycles(inner, scc(inner)))
    rows = packages.join(levels.select(P, F.col("node").alias("package"), "level"), [P, "package"], "left")
    return rows.select(P, "package", (F.row_number().over(Window.partitionBy(P).orderBy(F.coalesce("level", F.lit(0)), "package")) - 1).alias("update_rank"))


def minimum_patch_set(edges: DataFrame, blast: DataFrame, paths: DataFrame, threshold: float = BLAST_THRESHOLD, max_hops: int | None = None, near_pairs: bool = False) -> DataFrame:
    """One row per project with vulnerable nodes: the packages to update, in order, and what it saves.

    A single terminal is the set, with effort LOW. Every path counts as eliminated, as a
    patched package breaks it; ``paths_covered`` counts those that hold a chosen package.
    With ``near_pairs`` only pairs of terminals that a spanning tree can use are searched:
    the same rows in more, smaller rounds, for projects of many terminals.
    """
    ends = cut(terminals(blast, threshold))
    if near_pairs:
        closure = cut(near_closure(edges, ends, max_hops))
        tree = mst(closure).join(closure.select(P, "u", "v", "path"), [P, "u", "v"])
    else:
        tree = terminal_tree(edges, ends, max_hops)
    candidates = kept(patch_candidates(tree, ends))
    cover = path_cover(candidates, paths, ends)
    single = ends.groupBy(P).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("package")).filter("n = 1").select(P, "package")
    chosen = kept(cover.select(P, "package").join(single, P, "left_anti").unionByName(single))
    order = update_order(edges, chosen)
    members = order.groupBy(P).agg(F.sort_array(F.collect_list(F.struct("update_rank", "package"))).alias("o"))
    hit = paths.select(P, "path_id", F.explode("path").alias("package")).join(chosen, [P, "package"], "left_semi").select(P, "path_id").distinct().groupBy(P).agg(F.count(F.lit(1)).alias("paths_covered"))
    every = paths.select(P, "path_id").distinct().groupBy(P).agg(F.count(F.lit(1)).alias("attack_paths_eliminated"))
    naive = blast.groupBy(P).agg(F.count(F.lit(1)).alias("total_vulnerable_count"))
    rows = naive.join(members, P, "left").join(hit, P, "left").join(every, P, "left").join(single.select(P, F.lit(True).alias("single")), P, "left")
    n = F.coalesce(F.size("o"), F.lit(0))
    return rows.select(
        P, F.sort_array(F.col("o.package")).alias("packages_to_update"), n.alias("packages_to_update_count"), "total_vulnerable_count",
        F.coalesce("attack_paths_eliminated", F.lit(0)).alias("attack_paths_eliminated"), F.coalesce("paths_covered", F.lit(0)).alias("paths_covered"),
        savings_pct(F.col("total_vulnerable_count"), n).alias("savings_percent"), F.col("o.package").alias("update_order"),
        F.when(F.col("single"), "LOW").otherwise(effort(n)).alias("estimated_effort"),
        F.format_string("%d of %d vulnerable packages' updates cover %d attack paths.", n, F.col("total_vulnerable_count"), F.coalesce("paths_covered", F.lit(0))).alias("reasoning"),
    )
