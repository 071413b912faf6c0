"""Points in ranges, and versions in ranges of all kinds, against brute force."""

import random

from pyspark.sql import functions as F

from sparkweft.operators.intervals import points_in_ranges
from sparkweft.operators.match import match_cves
from tests.test_functions import compared


def joined(spark, points, ranges):
    p = spark.createDataFrame(points, "k string, i int, v long")
    r = spark.createDataFrame(ranges, "k string, j int, a long, b long, a_in boolean, b_in boolean")
    return points_in_ranges(p, r, ["k"], "v", "a", "b", F.col("a_in"), F.col("b_in"))


def test_points_in_ranges(spark):
    """Open, empty, reversed and repeated ranges, values at their ends, keys of one side only: every pair once."""
    rng = random.Random(4)
    end = lambda: rng.choice([None, rng.randint(-40, 40)])
    points = [(rng.choice("aab"), i, rng.randint(-45, 45)) for i in range(300)] + [("only", 900, 1), ("a", 901, None), (None, 902, 1)]
    ranges = [(rng.choice("aab"), j, end(), end(), rng.random() < 0.5, rng.random() < 0.5) for j in range(200)] + [("c", 900, None, None, True, True), (None, 901, None, None, True, True)]
    want = sorted(
        (i, j) for k, i, v in points for q, j, a, b, a_in, b_in in ranges
        if k == q and None not in (k, v) and (a is None or v > a or (a_in and v == a)) and (b is None or v < b or (b_in and v == b))
    )
    assert sorted((r["i"], r["j"]) for r in joined(spark, points, ranges).collect()) == want and len(want) > 5000


def test_one_point_and_empty_tables(spark):
    assert [r["j"] for r in joined(spark, [("a", 1, 5)], [("a", 1, None, None, True, True), ("a", 2, 5, 5, True, True), ("a", 3, 5, 5, True, False)]).orderBy("j").collect()] == [1, 2]
    assert joined(spark, [], [("a", 1, None, None, True, True)]).isEmpty() and joined(spark, [("a", 1, 5)], []).isEmpty()


def test_ranges_are_met_by_nodes_alone(spark):
    """No comparison is left beside the equi-join of points and ranges."""
    plan = joined(spark, [("a", 1, 5)], [("a", 1, 2, 9, True, True)])._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Generate")]
    assert "__level" in top and "__node" in top and ">" not in top.replace("=>", "").replace("->", "").split("Join Inner", 1)[1].split("\n")[0]


def test_mixed_versions_against_brute_force(spark):
    rng = random.Random(6)

    def version():
        numbers = [rng.randint(0, 3) for _ in range(rng.randint(1, 3))]
        label = rng.choice(["", "", "", "rc.1", "beta", "2", "10a"])
        return ".".join(map(str, numbers)) + (f"-{label}" if label else ""), (*(numbers + [0, 0])[:3], *([label] if label else []))

    nodes = [(f"p{i % 9}", rng.choice("xyz"), *version()) for i in range(250)]
    cves = [(f"C{j}", rng.choice("xyzq"), 5.0, "npm", rng.choice([None, version()]), rng.choice([None, version()]), rng.random() < 0.5, rng.random() < 0.5) for j in range(120)]
    want = set()
    for p, n, _, v in nodes:
        for c, q, _, _, a, b, a_in, b_out in cves:
            above = a is None or compared(v, a[1]) >= (0 if a_in else 1)
            if n == q and above and (b is None or compared(v, b[1]) <= (-1 if b_out else 0)):
                want.add((p, n, c))
    text = lambda x: x and x[0]
    got = match_cves(
        spark.createDataFrame([x[:3] for x in nodes], "project_id string, name string, version string"),
        spark.createDataFrame([(*x[:4], text(x[4]), text(x[5]) or "", *x[6:]) for x in cves], "cve_id string, package_name string, cvss_score double, ecosystem string, version_start string, version_end string, version_start_incl boolean, version_end_excl boolean"),
    ).collect()
    assert sorted((r["project_id"], r["name"], r["cve_id"]) for r in got) == sorted(want) and len(want) > 500
