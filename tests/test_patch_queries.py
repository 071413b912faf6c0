"""The registered patch-set queries on small tables with known answers."""

import datetime
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkweft import queries as library
from sparkweft.operators import patchset, reach
from sparkweft.plans.portfolio import Portfolio

#: Two vulnerable packages, 21 and 24, six hops apart; their attack paths to the sink 12 meet at 4.
LINES = [(1, 1, [21, 1, 2, 4, 12]), (2, 1, [24, 8, 6, 4])]
PARTS = (1, 2, 4, 5, 6, 8, 11, 12, 13, 21, 24)


def tables(spark, folder, lines):
    """The given tables, with these orders (key, customer, parts in line order)."""
    at = datetime.datetime(2024, 1, 1)
    rows = {
        "part": ([(p, 15, "Brand#21" if p == 12 else "Brand#2") for p in PARTS], "p_partkey long, p_size int, p_brand string"),
        "orders": ([(o, c) for o, c, _ in lines], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, k, p, 1, 1.0, 1.0) for o, _, keys in lines for k, p in enumerate(keys)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"),
        "events": ([(1, 1, "x", 1.0, at)], "event_id long, user_id long, event_type string, value double, ts timestamp"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("far"), LINES)


def run(spark, name, folder):
    return library.queries()[name](spark, folder)


@pytest.mark.parametrize("name", ["metric_closure", "closure_mst"])
def test_terminals_far_apart_have_their_distance(spark, far, name):
    assert [tuple(r) for r in run(spark, name, far).collect()] == [(1, 21, 24, 6)]


def test_packages_between_far_terminals_are_candidates(spark, far):
    row = run(spark, "minimum_patch_set", far).first()
    assert (row["packages_to_update"], row["paths_covered"]) == ([4], 2)


def test_cover_can_choose_packages_between_terminals(spark, far):
    assert [tuple(r) for r in run(spark, "patch_cover", far).collect()] == [(1, 4, 2)]


def test_report_has_the_unbounded_patch_set(spark, far):
    assert run(spark, "scan_report", far).first()["minimum_patch_set"]["packages_to_update"] == [4]


def test_update_order_has_all_packages_and_breaks_cycles(spark, tmp_path):
    folder = tables(spark, tmp_path, [(1, 1, [13, 1, 2, 4]), (2, 1, [4, 1])])
    got = run(spark, "update_order", folder).orderBy("update_rank").collect()
    assert [r["package"] for r in got] == [13, 1, 2, 4]  # 4 > 1 goes: 1 has the higher in-degree


def brute_order(links, packages):
    """Parents first among the packages: within a cycle only edges to a lower in-degree (then name) stay."""
    inner = {(a, b) for a, b in links if a in packages and b in packages and a != b}
    reach = {n: {n} for n in packages}
    for _ in packages:
        for a, b in inner:
            reach[a] |= reach[b]
    into = Counter(b for _, b in inner)
    left = {(a, b) for a, b in inner if a not in reach[b] or into[a] > into[b] or (into[a] == into[b] and a < b)}
    level = dict.fromkeys(packages, 0)
    for _ in packages:
        for a, b in left:
            level[b] = max(level[b], level[a] + 1)
    return sorted(packages, key=lambda n: (level[n], n))


def brute_patch(links, scores, paths, threshold):
    """(packages in order, paths covered) by plain Python."""
    ranked = sorted(scores, key=lambda n: (-scores[n], n))
    ends = [n for n in ranked if scores[n] > threshold] or ranked[:5]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    closure = {}
    for u in ends:
        best, level = {u: (u,)}, {u: (u,)}
        while level:
            found = {}
            for at, way in level.items():
                for to in near[at] - {at}:
                    if to not in best:
                        found[to] = min(found.get(to, (*way, to)), (*way, to))
            best |= found
            level = found
        closure |= {(u, v): best.get(v) for v in ends if u < v}
    of, tree = {n: n for n in ends}, []
    for u, v in sorted(closure, key=lambda e: (len(closure[e]) - 1 if closure[e] else 1000, *e)):
        if of[u] != of[v]:
            tree.append((u, v))
            old = of[v]
            of = {n: of[u] if c == old else c for n, c in of.items()}
    candidates = set(ends).union(*(closure[e] or () for e in tree))
    covered = Counter(n for p in paths for n in set(p) & candidates)
    firsts = [min(some, key=lambda n: (-covered[n], n)) if (some := set(p) & candidates) else None for p in paths]
    chosen = set(firsts) - {None} | (set() if paths and None not in firsts else set(ends))
    chosen = set(ends) if len(ends) == 1 else chosen
    return brute_order(links, chosen), sum(bool(set(p) & chosen) for p in paths)


@pytest.mark.parametrize("near_pairs", [False, True])
def test_patch_sets_against_brute_force(spark, near_pairs):
    rng = random.Random(19)
    edges, blast, paths, want = [], [], [], {}
    for project in range(12):
        n = rng.randint(4, 16)
        links = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(3, 2 * n))} - {(k, k) for k in range(n)})
        scores = {k: round(rng.uniform(0, 10), 2) for k in rng.sample(range(n), rng.randint(1, min(n, 6)))}
        own = [rng.sample(range(n), rng.randint(2, 4)) for _ in range(rng.choice([0, 3, 6]))]
        edges += [(project, *e) for e in links]
        blast += [(project, k, s, i + 1) for i, (k, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0])))]
        paths += [(project, i, p) for i, p in enumerate(own)]
        want[project] = brute_patch(links, scores, own, 5.0)
    got = patchset.minimum_patch_set(
        spark.createDataFrame(edges, "project_id long, src long, dst long"), spark.createDataFrame(blast, "project_id long, source_node long, blast_radius_score double, rank int"), spark.createDataFrame(paths, "project_id long, path_id long, path array<long>"), near_pairs=near_pairs
    )
    assert {r["project_id"]: (r["update_order"], r["paths_covered"]) for r in got.collect()} == want
    assert any(set(order) - {b[1] for b in blast if b[0] == project} for project, (order, _) in want.items())  # some packages between


def test_update_order_against_brute_force(spark):
    rng = random.Random(23)
    links = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(34)})
    packages = rng.sample(range(14), 11)
    got = patchset.update_order(spark.createDataFrame([(1, *e) for e in links], "project_id long, src long, dst long"), spark.createDataFrame([(1, p) for p in packages], "project_id long, package long"))
    assert [r["package"] for r in got.orderBy("update_rank").collect()] == brute_order(links, packages)


def test_report_is_made_of_the_stages(spark, far):
    """Every nested part of a report holds the rows of its stage, ranked."""
    p = Portfolio.of(spark, far)
    rows = {r["project_id"]: r.asDict(True) for r in p.report().collect()}
    assert set(rows) == {r["project_id"] for r in p.nodes.select("project_id").distinct().collect()}
    group = lambda df: {k: list(v) for k, v in itertools.groupby(sorted(df.collect(), key=lambda r: (r["project_id"], r["rank"])), key=lambda r: r["project_id"])}
    blast, advice, clusters = group(p.blast), group(p.advice), group(p.clusters)
    paths = defaultdict(list)
    for r in sorted(p.paths.collect(), key=lambda r: r["rank"]):
        paths[r["project_id"], r["source"]].append(r["path"])
    summary, sets = {r["project_id"]: r["risk"] for r in p.summary.collect()}, {r["project_id"]: r["packages_to_update"] for r in p.patch.collect()}
    for k, r in rows.items():
        assert [x["source_node"] for x in r["blast_radius_results"] or []] == [x["source_node"] for x in blast.get(k, [])]
        assert all([w["path"] for w in x["attack_paths"] or []] == paths[k, x["source_node"]] for x in r["blast_radius_results"] or [])
        assert [x["package_name"] for x in r["patch_recommendations"] or []] == [x["package_name"] for x in advice.get(k, [])]
        assert [x["nodes"] for x in r["circular_trust_clusters"] or []] == [x["nodes"] for x in clusters.get(k, [])]
        assert r["risk"] == summary[k] and (r["minimum_patch_set"] or {}).get("packages_to_update") == sets.get(k)
    assert {r["project_id"]: r["total"] for r in rows.values()} == {r["project_id"]: r["n"] for r in p.nodes.groupBy("project_id").agg(F.count_distinct("name").alias("n")).collect()}


def test_trees_without_all_pairs(spark):
    """Border trees weigh as much as those of all pairs; near pairs give the very tree of all pairs, ties included."""
    rng = random.Random(31)
    links, ends = set(), set()
    for project in range(25):
        n = rng.randint(3, 24)
        links |= {(project, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(2, 2 * n))}  # loops and parts that don't meet too
        ends |= {(project, x) for x in rng.sample(range(n), rng.randint(1, min(n, 9)))}
    edges, terminals = spark.createDataFrame(sorted(links), "project_id long, src long, dst long"), spark.createDataFrame(sorted(ends), "project_id long, node long")
    every = reach.metric_closure(edges, terminals)
    full = {tuple(r) for r in reach.mst(every).collect() if r["weight"] < 1000}
    weights = lambda rows: Counter((r[0], r[3]) for r in rows)
    assert weights(reach.border_tree(edges, terminals).collect()) == weights(full) and len(full) > 40
    near = reach.near_closure(edges, terminals)
    assert {tuple(r) for r in reach.mst(near).collect()} == full
    rows = {tuple(map(str, r)) for r in every.collect()}
    assert {tuple(map(str, r)) for r in near.collect()} < rows


def test_trees_of_a_grid_search_near_pairs_alone(spark):
    """Every node of a path is a terminal: only neighbours are pairs."""
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(30)], "project_id long, src long, dst long")
    terminals = spark.createDataFrame([(1, k) for k in range(31)], "project_id long, node long")
    assert sorted((r["u"], r["v"]) for r in reach.near_closure(edges, terminals).collect()) == [(k, k + 1) for k in range(30)]
    assert reach.near_closure(edges, terminals.limit(1)).isEmpty() and reach.near_closure(edges.limit(0), terminals).isEmpty()
