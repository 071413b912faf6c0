"""Graph operators on small graphs with known answers, and invariants."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkweft.constants import sink_table
from sparkweft.operators import graph, match, patchset, reach, report, risk

P = "project_id"
DEPS = [
    ("a", 1, "web", "3.1.0", "npm", False, True, None), ("a", 2, "cli", "0.4", "npm", False, True, None), ("a", 3, "queue", "7.2.1", "npm", True, True, None),
    ("a", 4, "router", "2.2", "npm", False, False, "web"), ("a", 5, "url", "1.9.9", "npm", False, False, "router"), ("a", 6, "url", "1.8.0", "npm", False, False, "queue"),
]
DEP = "project_id string, seq long, name string, version string, ecosystem string, is_dev boolean, is_direct boolean, parent string"
VULN = "project_id string, name string, cvss_score double, primary_cve string"


def edges(spark, text, project="a"):
    return spark.createDataFrame([(project, *e.split(">")) for e in text.split()] or [], f"{P} string, src string, dst string")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["scc_id"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def test_build_graph(spark):
    g = graph.build_graph(spark.createDataFrame(DEPS, DEP))
    assert {(r["src"], r["dst"]) for r in g.edges.collect()} == {("__root__", "web"), ("__root__", "cli"), ("__root__", "queue"), ("web", "router"), ("router", "url"), ("queue", "url")}
    nodes = {r["name"]: r["version"] for r in g.nodes.collect()}
    assert nodes == {"__root__": "0.0.0", "web": "3.1.0", "cli": "0.4", "queue": "7.2.1", "router": "2.2", "url": "1.9.9"}
    assert tuple(graph.sizes(g).first()) == ("a", 6, 6)


def test_resolution_and_majority(spark):
    rows = [("a", 1, "x", "1.0.0", "npm", False, True, None), ("a", 2, "x", "1.10.0", "pip", True, False, None), ("a", 3, "x", "1.9.0", "pip", False, False, None), ("a", 4, "y", "1.0", "npm", False, True, "ghost"), ("a", 5, "y", "1.0.0", "pip", True, True, None)]
    df = spark.createDataFrame(rows, DEP)
    got = {r["name"]: (r["version"], r["ecosystem"]) for r in graph.resolve_nodes(df).collect()}
    assert got == {"x": ("1.10.0", "pip"), "y": ("1.0", "npm")}
    assert graph.project_ecosystem(df).first()["ecosystem"] == "pip"
    assert "ghost" in {r["name"] for r in graph.build_graph(df).nodes.collect()}


@pytest.mark.parametrize(("text", "want"), [("A>B B>C C>A", [["A", "B", "C"]]), ("A>B B>C", [["A"], ["B"], ["C"]]), ("A>B C>D D>E E>C", [["A"], ["B"], ["C", "D", "E"]]), ("A>A", []), ("A>B B>A B>C C>D D>C D>E E>F F>D", [["A", "B"], ["C", "D", "E", "F"]])])
def test_scc(spark, text, want):
    assert groups(graph.scc(edges(spark, text))) == want


def test_break_cycles_and_levels(spark):
    e = edges(spark, "A>B B>C C>A C>D D>E E>D A>F F>G")
    left = graph.break_cycles(e, graph.scc(e))
    assert left.count() < e.count()
    assert all(x == sorted(x)[:1] for x in groups(graph.scc(left)))
    rank = {r["node"]: r["rank"] for r in graph.topological_levels(left).collect()}
    assert sorted(rank.values()) == list(range(len(rank)))
    assert all(rank[r["src"]] < rank[r["dst"]] for r in left.collect())


def test_reach_and_distances(spark):
    e = edges(spark, "A>B B>C C>A C>D X>Y")
    seeds = spark.createDataFrame([("a", "A"), ("a", "Y")], f"{P} string, source string")
    assert {(r["source"], r["node"], r["hops"]) for r in reach.reachable(e, seeds).collect()} == {("A", "B", 1), ("A", "C", 2), ("A", "D", 3)}
    assert {(r["source"], r["node"]) for r in reach.reachable(e, seeds, "up").collect()} == {("A", "C"), ("A", "B"), ("Y", "X")}
    ends = spark.createDataFrame([("a", x) for x in "ADX"], f"{P} string, node string")
    close = {(r["u"], r["v"]): r["weight"] for r in reach.metric_closure(e, ends).collect()}
    assert close == {("A", "D"): 2, ("A", "X"): 1000, ("D", "X"): 1000}
    assert reach.mst(reach.metric_closure(e, ends)).count() == 2


@pytest.mark.parametrize(("sink", "kind", "level"), [("requests", "network", "MEDIUM"), ("python_dotenv", "credential", "CRITICAL"), ("sqlalchemy", "database", "HIGH")])
def test_blast_and_paths(spark, sink, kind, level):
    e, sinks = edges(spark, f"app>bad bad>mid mid>{sink}"), sink_table(spark).withColumnRenamed("name", "node")
    blast = risk.blast_radius(e, spark.createDataFrame([("a", "bad", 7.5, "CVE-1")], VULN), sinks)
    row = blast.first()
    assert (row["reachable_count"], row["sinks_reachable"], row["sink_types"], row["data_sensitivity"]) == (2, [sink], [kind], level)
    paths = reach.attack_paths(e, blast, sinks).collect()
    assert [(p["path"], p["sink_type"], p["path_length"], p["exploitability"]) for p in paths] == [(["bad", "mid", sink], kind, 3, "LOCAL")]


def walks(links, source, sinks, most, simple):
    """Brute force: every walk from a source to its first sink."""
    open_, out = [(source,)], []
    while open_:
        nxt = [w + (d,) for w in open_ for s, d in links if s == w[-1] and not (simple and d in w)]
        out += [w for w in nxt if w[-1] in sinks]
        open_ = [w for w in nxt if w[-1] not in sinks and len(w) < most]
    return out


@pytest.mark.parametrize("simple", [False, True])
def test_attack_paths_are_the_best_of_all_walks(spark, simple):
    rng = random.Random(12)
    nodes = [f"n{i}" for i in range(9)]
    links = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)} | {("n1", "db"), ("n5", "db"), ("n7", "net"), ("db", "n2")})
    links = [x for x in links if x[0] != x[1]]
    sinks = {"db": "database", "net": "network"}
    e = spark.createDataFrame([("a", *x) for x in links], f"{P} string, src string, dst string")
    blast = spark.createDataFrame([("a", n, 7.3, 2.0) for n in ("n0", "n3", "db")], f"{P} string, source_node string, cvss_score double, multiplier double")
    got = reach.attack_paths(e, blast, spark.createDataFrame(list(sinks.items()), "node string, sink_type string"), max_nodes=6, simple_paths=simple).collect()
    for source in ("n0", "n3", "db"):
        every = sorted(walks(links, source, sinks, 6, simple), key=lambda w: (-round(7.3 / len(w) * 2, 4), len(w), w))
        assert [tuple(r["path"]) for r in sorted((r for r in got if r["source"] == source), key=lambda r: r["rank"])] == every[:10]
    assert len(got) > 15


def test_attack_paths_of_a_complete_graph(spark):
    """200 packages that all depend on each other have 198 ** 8 walks of ten nodes; ten of each source are kept in a round."""
    n = spark.range(200)
    e = n.select(F.col("id").alias("src")).crossJoin(n.select(F.col("id").alias("dst"))).filter("src <> dst").withColumn(P, F.lit("a"))
    blast = spark.createDataFrame([("a", 3, 9.0, 3.0), ("a", 150, 5.0, 3.0)], f"{P} string, source_node long, cvss_score double, multiplier double")
    got = reach.attack_paths(e, blast, spark.createDataFrame([(77, "crypto")], "node long, sink_type string")).collect()
    assert sorted((r["source"], r["rank"], r["path"]) for r in got if r["rank"] <= 3) == [(s, k + 1, [s, *mid, 77]) for s in (3, 150) for k, mid in enumerate(([], [0], [1]))]
    assert len(got) == 20


def test_recommendations_merge(spark):
    schema = f"{P} string, source_node string, cve_id string, cvss_score double, reachable_count long, sink_types array<string>, blast_radius_score double"
    blast = spark.createDataFrame([("a", "x", "C1", 9.5, 0, [], 3.0), ("a", "y", "C2", 7.0, 4, ["network", "crypto"], 8.0), ("a", "z", "C3", 1.0, 1, ["network"], 8.0)], schema)
    paths = spark.createDataFrame([("a", "y", 1, ["y", "q"]), ("a", "y", 2, ["y", "r", "q"])], f"{P} string, source string, rank int, path array<string>")
    rows = report.fallback_recommendations(blast, spark.createDataFrame([("a", "pip")], f"{P} string, ecosystem string"), paths)
    reviewed = rows.filter("package_name = 'z'").withColumn("confidence", F.lit("HIGH")).withColumn("recommended_version", F.lit("2.1"))
    got = report.merge_recommendations(reviewed, rows, 2).orderBy("rank").collect()
    assert [(r["package_name"], r["recommended_version"], r["confidence"]) for r in got] == [("z", "2.1", "HIGH"), ("y", "latest", "MEDIUM")]
    text = {r["package_name"]: (r["threat_explanation"], r["attack_path_summary"]) for r in rows.collect()}
    assert text["y"] == ("C2 has a score of 7.0 in y. From it 4 packages can be reached. Sensitive access: crypto, network.", "path: y > q")
    assert text["x"] == ("C1 has a score of 9.5 in x. No other package can be reached from it.", "no path to a sensitive package")


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3), ("b", 4)], f"{P} string, total long")
    for fmt in ("json", "parquet"):
        report.write_report(rows, f"{tmp_path}/{fmt}", fmt)
        assert sorted(map(tuple, spark.read.format(fmt).load(f"{tmp_path}/{fmt}").select(P, "total").collect())) == [("a", 3), ("b", 4)]


def test_own_sink_counts_but_is_not_listed(spark):
    blast = risk.blast_radius(edges(spark, "jsonwebtoken>x"), spark.createDataFrame([("a", "jsonwebtoken", 5.0, "C")], VULN), sink_table(spark).withColumnRenamed("name", "node")).first()
    assert (blast["sinks_reachable"], blast["data_sensitivity"], blast["blast_radius_score"]) == ([], "CRITICAL", 15.0)


@pytest.mark.parametrize(("n", "score", "level"), [(2, 0, "LOW"), (4, 0, "MEDIUM"), (7, 0, "HIGH"), (11, 0, "CRITICAL"), (3, 8.5, "HIGH"), (2, 9.5, "CRITICAL")])
def test_trust_clusters(spark, n, score, level):
    ring = " ".join(f"n{i:02d}>n{(i + 1) % n:02d}" for i in range(n)) + " n00>down"
    e = edges(spark, ring)
    got = risk.trust_clusters(graph.scc(e), spark.createDataFrame([("a", "n01", float(score), "C")], VULN), e).collect()
    assert [(c["size"], c["risk_level"], c["combined_blast_radius"]) for c in got] == [(n, level, 1)]


def test_topological_risk_of_leaves_is_the_score(spark):
    g = graph.build_graph(spark.createDataFrame(DEPS, DEP))
    v = spark.createDataFrame([("a", "url", 7.5, "C1"), ("a", "cli", 7.2, "C2")], VULN)
    assert {(r["name"], r["topological_risk_score"]) for r in risk.topological_risk(g.edges, g.nodes, v).collect()} == {("url", 7.5), ("cli", 7.2)}


def test_match_and_rollup(spark):
    nodes = spark.createDataFrame([("a", "Follow-Redirects", "1.14.8", "npm"), ("a", "x", "1.0", "npm"), ("a", "org:y", "3", "maven")], f"{P} string, name string, version string, ecosystem string")
    cves = spark.createDataFrame([("C1", "follow_redirects", "npm", "", "1.15.0", True, True, 6.1), ("C2", "follow_redirects", "pip", "1.0", "1.14.8", True, False, 8.0), ("C3", "x", "npm", "1.0", "", False, True, 9.0), ("C4", "y", "unknown", "", "", False, False, 5.0)], "cve_id string, package_name string, ecosystem string, version_start string, version_end string, version_start_incl boolean, version_end_excl boolean, cvss_score double")
    got = match.vulnerable_nodes(match.match_cves(nodes, cves)).collect()
    assert [(r["name"], r["cvss_score"], r["cve_ids"], r["primary_cve"]) for r in got] == [("Follow-Redirects", 8.0, ["C2", "C1"], "C2")]
    assert {r["cve_id"] for r in match.match_cves(nodes, cves, ecosystem_aware=True).collect()} == {"C1"}
    assert "C4" in {r["cve_id"] for r in match.match_cves(nodes, cves, match_artifact=True).collect()}
    assert {"Follow-Redirects", "x"} <= {r["name"] for r in match.known_packages(nodes, cves).collect()}


def test_patch_set(spark):
    e = edges(spark, "root>hub hub>a hub>b hub>c root>alone a>requests b>requests c>requests")
    sinks = sink_table(spark).withColumnRenamed("name", "node")
    v = spark.createDataFrame([("a", x, 9.0, "C") for x in ("a", "b", "c", "alone")], VULN)
    blast = risk.blast_radius(e, v, sinks)
    paths = reach.attack_paths(e, blast, sinks).withColumn("path_id", F.struct("source", "rank"))
    row = patchset.minimum_patch_set(e, blast, paths, threshold=10.0).first()
    assert row["total_vulnerable_count"] == 4 and row["packages_to_update_count"] <= 4 and row["paths_covered"] == row["attack_paths_eliminated"] == 3
    order = spark.createDataFrame([("a", "leaf"), ("a", "mid")], f"{P} string, package string")
    assert [r["package"] for r in patchset.update_order(edges(spark, "root>mid mid>leaf"), order).orderBy("update_rank").collect()] == ["mid", "leaf"]


def test_diff_and_reports(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("a", "y", "1")], f"{P} string, name string, version string")
    new = spark.createDataFrame([("a", "x", "2"), ("a", "z", "1")], f"{P} string, name string, version string")
    got = {tuple(r)[1:] for r in match.dependency_diff(old, new).collect()}
    assert got == {("added", "x", None, "2"), ("added", "z", None, "1"), ("removed", "x", "1", None), ("removed", "y", "1", None), ("version_changed", "x", "1", "2")}
    none = spark.createDataFrame([], f"{P} string, risk_level string")
    blast = spark.createDataFrame([("a", 7.5)], f"{P} string, cvss_score double")
    projects = spark.createDataFrame([("a",), ("b",)], f"{P} string")
    summary = report.risk_summary(blast, none, projects)
    assert {tuple(r) for r in summary.collect()} == {("a", "HIGH"), ("b", "CLEAN")}
    assert [r[P] for r in report.ci_gate(summary, "HIGH").collect()] == ["a"]


def test_witness_cycles(spark):
    """Every component of two or more has one cycle of its own edges, the shortest through its smallest member."""
    rng = random.Random(8)
    edges = sorted({(p, rng.randrange(14), rng.randrange(14)) for p in range(12) for _ in range(8 + 2 * p)})
    df = spark.createDataFrame(edges, "project_id int, src int, dst int")
    components = graph.scc(df).collect()
    scc = {(r["project_id"], r["node"]): r["scc_id"] for r in components}
    size = Counter((r["project_id"], r["scc_id"]) for r in components)
    got = {(r["project_id"], r["scc_id"]): r["cycle"] for r in graph.witness_cycles(df, graph.scc(df)).collect()}
    assert set(got) == {k for k, n in size.items() if n >= 2}
    own = {p: {(a, b) for q, a, b in edges if q == p and a != b and scc[p, a] == scc[p, b]} for p in range(12)}
    for (p, c), cycle in got.items():
        best, ways = None, [[c]]
        while best is None:
            ways = [w + [b] for w in ways for a, b in own[p] if a == w[-1] and (b == c or b not in w)]
            best = min((w for w in ways if w[-1] == c), default=None)
        assert cycle == best and cycle[0] == cycle[-1] == c
    assert graph.witness_cycles(df.limit(0), graph.scc(df.limit(0))).count() == 0
