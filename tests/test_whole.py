"""Projects in one pass against the same projects by rounds of joins."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import graph, patchset, reach

#: Some of the projects below have more edges than this, some have fewer.
SOME = 12


@pytest.fixture(scope="module", params=["long", "string"])
def given(spark, request):
    """(edges, starts, sinks): six projects, a ring behind a chain, a project without edges, rows without names; nodes numbers or texts."""
    rng = random.Random(5)
    links, starts = set(), {(90, 1), (90, 2), (0, 77)}
    for project in range(6):
        n = rng.randint(4, 9)
        links |= {(project, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(4, 22))}
        starts |= {(project, x) for x in rng.sample(range(n), rng.randint(1, 4))}
    links |= {(7, k, k + 1) for k in range(14)} | {(7, 14, 11), (None, 1, 2), (7, None, 2), (7, 3, None)}
    starts |= {(7, 0), (7, 12), (7, None), (None, 1)}
    of = lambda rows, names, key=lambda r: str(r): spark.createDataFrame(sorted(rows, key=key), names).select(F.col("project_id"), *(F.col(c.split()[0]).cast(request.param) for c in names.split(", ")[1:]))
    sinks = spark.createDataFrame([(2, "crypto"), (5, "database"), (13, "network")], "node long, sink_type string").withColumn("node", F.col("node").cast(request.param))
    return of(links, "project_id long, src long, dst long").localCheckpoint(), of(starts, "project_id long, node long").localCheckpoint(), sinks


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def blast(starts):
    return starts.withColumnRenamed("node", "source_node").withColumns({"cvss_score": F.lit(7.3), "multiplier": F.lit(2.0)})


RUNS = {
    "scc": lambda e, s, k, most: graph.scc(e, most),
    "levels": lambda e, s, k, most: graph.topological_levels(e.filter("src < dst"), most),
    "reachable": lambda e, s, k, most: reach.reachable(e, s.withColumnRenamed("node", "source"), most=most),
    "two hops up": lambda e, s, k, most: reach.reachable(e, s.withColumnRenamed("node", "source"), "up", 2, most=most),
    "paths": lambda e, s, k, most: reach.attack_paths(e, blast(s), k, max_nodes=7, top=4, most=most),
    "closure": lambda e, s, k, most: reach.metric_closure(e, s, most=most),
    "tree": lambda e, s, k, most: reach.terminal_tree(e, s, 3, most=most),
}


@pytest.mark.parametrize("name", RUNS)
def test_same_rows_by_one_pass_and_by_rounds(spark, given, name):
    want = rows(RUNS[name](*given, SOME))
    assert want and rows(RUNS[name](*given, 10**6)) == want


def test_trees_are_those_of_all_pairs(spark, given, monkeypatch):
    monkeypatch.setattr("sparkweft.operators.whole.PAIRS", 2)  # a tree is made of many parts
    edges, starts, _ = given
    closure = reach.metric_closure(edges, starts)
    assert rows(reach.terminal_tree(edges, starts).drop("path")) == rows(reach.mst(closure))


def jobs(spark, run):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, group)
    try:
        run().collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_rounds_for_small_projects(spark):
    """Jobs don't grow with the length of ways: the driver kept what it knew of hundreds."""
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(40)] + [(1, 40, 0)], "project_id long, src long, dst long")
    ends = spark.createDataFrame([(1, 0), (1, 20)], "project_id long, node long")
    assert jobs(spark, lambda: graph.scc(edges)) < 12
    assert jobs(spark, lambda: reach.reachable(edges, ends.withColumnRenamed("node", "source"))) < 12
    assert jobs(spark, lambda: patchset.patch_candidates(reach.terminal_tree(edges, ends), ends)) < 12
