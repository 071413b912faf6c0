"""Scalar functions against literal expectations."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweft.functions import names, scores, versions


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


KEYS = {
    "1.2.3": (1, 2, 3), "v2": (2, 0, 0), "7": (7, 0, 0), "10.4": (10, 4, 0), "1.2.3.4": (1, 2, 3, 4), "1.2.3.4.5": (1, 2, 3, 4, "5"), "3.1.0.9-rc.2": (3, 1, 0, 9, "rc.2"),
    "1.0a1": (1, 0, 0, "0a1"), "1.2.3+b": (1, 2, 0, "3+b"), "5.6-beta-2": (5, 6, 0, "beta-2"), "1-2": (1, 0, 0, "2"), "1..2": (1, 0, 0, ".2"), "4.5.": (4, 0, 0, "5."), "4.5-": (4, 0, 0, "5-"),
    "4.": (4, "", 0), "a.b": ("a", 0, 0), "12a.1": ("12a", 0, 0), "vx1": ("vx1", 0, 0), "  8.1 ": (8, 1, 0), "": (0, 0, 0), "*": (0, 0, 0), "-": (0, 0, 0), "unknown": (0, 0, 0), None: (0, 0, 0),
    "99999999999999999999.1": (99999999999999999999, 1, 0),
}


def test_parse_version(spark):
    got = values(spark, versions.parse_version, list(KEYS))
    assert {v: tuple(p["s"] if p["n"] is None else int(p["s"] or p["n"]) for p in k) for v, k in zip(KEYS, got, strict=True)} == KEYS


def compared(a, b):
    """Brute force for plain keys: part by part, as text where the kinds differ."""
    n = max(len(a), len(b))
    for x, y in zip(a + (0,) * (n - len(a)), b + (0,) * (n - len(b)), strict=True):
        if type(x) is not type(y):
            x, y = str(x), str(y)
        if x != y:
            return -1 if x < y else 1
    return 0


def test_compare(spark):
    pairs = [(a, b) for a in KEYS for b in KEYS]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", versions.compare_versions(F.col("a"), F.col("b")).alias("c")).collect()
    assert len(got) == len(pairs) and all(r["c"] == compared(KEYS[r["a"]], KEYS[r["b"]]) for r in got)
    assert one(spark, versions.compare_versions(F.lit("1.10"), F.lit("1.9")))[0] == 1 and one(spark, versions.compare_versions(F.lit("2.0"), F.lit("2.0.0")))[0] == 0


def test_ranges(spark):
    """All kinds of ends around generated versions, against brute force."""
    rng = random.Random(8)
    version = lambda: ".".join(str(rng.randint(0, 3)) for _ in range(rng.randint(1, 4)))
    rows = [(rng.choice(["", version()]), rng.choice(["", version()]), rng.random() < 0.5, rng.random() < 0.5, version()) for _ in range(400)]
    df = spark.createDataFrame(rows, "s string, e string, si boolean, ee boolean, v string")
    hit = versions.range_contains(versions.parse_version(F.col("v")), versions.bound_key(F.col("s")), versions.bound_key(F.col("e")), F.col("si"), F.col("ee"))
    key = lambda v: tuple(map(int, v.split(".")))

    def within(s, e, si, ee, v):
        low = not s or compared(key(v), key(s)) >= (0 if si else 1)
        return low and (not e or compared(key(v), key(e)) <= (-1 if ee else 0))

    got = df.select("s", "e", "si", "ee", "v", hit.alias("hit")).collect()
    assert all(r["hit"] == within(*r[:5]) for r in got) and 50 < sum(r["hit"] for r in got) < 350


SPECS = {
    "==2.28.0": "2.28.0", ">=2.0,<3": "2.0", ">= 2 , ==1.5": "1.5", "~=1.4b2": "1.4b2", "": "unknown", "*": "unknown", "== 1 ; x": "1", "==": "unknown", "==,>=3": "3", "rc-7.x": "7.x", "<\t9": "9", ">=;4": "4",
}


def test_requested_pip_versions(spark):
    assert dict(zip(SPECS, values(spark, names.extract_pip_version, list(SPECS)), strict=True)) == SPECS
    assert {s: names.pip_version(s) for s in SPECS} == SPECS


def test_names(spark):
    assert values(spark, names.normalise_pip, ["Flask-SQL.x y"]) == ["flask_sql_x_y"]
    assert values(spark, names.normalise_name, ["Node-Fetch.x"]) == ["node_fetch.x"]
    assert values(spark, names.npm_request, ["^18.2.0", ">=1.0 <2", "git+https://x", "file:../a", "^", "github:a/b"]) == ["18.2.0", "1.0", "git", None, "unknown", "git"]


def test_scores(spark):
    assert values(spark, lambda x: scores.cvss_band(x.cast("double")), ["9", "7.5", "4", "0.1", "0"]) == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "CLEAN"]
    levels = {"credential": "CRITICAL", "crypto": "CRITICAL", "database": "HIGH", "file_write": "HIGH", "network": "MEDIUM"}
    assert values(spark, lambda x: scores.sensitivity(F.array(x)), list(levels)) == list(levels.values())
    assert one(spark, scores.sensitivity(F.array().cast("array<string>")))[0] == "LOW"
    row = one(spark, scores.exploit_score(F.lit(9.0), F.lit(3), F.lit(2.0)), scores.blast_score(F.lit(8.0), F.lit(3), F.lit(1.5)), scores.topo_risk(F.lit(5.0), F.lit(0), F.lit(1)), scores.savings_pct(F.lit(16), F.lit(5)))
    assert list(row) == [6.0, 24.0, 5.0, 68.75]
    assert values(spark, lambda x: scores.effort(x.cast("int")), ["4", "5", "15", "16"]) == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert values(spark, scores.exploitability, ["CVSS:3.1/AV:N/x", "av:a", "AV:L"]) == ["NETWORK", "ADJACENT", "LOCAL"]
    assert values(spark, scores.normalise_confidence, ["high", "0.7", "7", "-1", "?", None]) == [0.9, 0.7, 1.0, 0.0, 0.0, 0.0]
    assert values(spark, scores.split_breaking_changes, ["a; b,, c", None, "1,2,3,4,5,6,7"]) == [["a", "b", "c"], [], ["1", "2", "3", "4", "5", "6"]]
    assert values(spark, lambda x: scores.extract_json_object(x, ("k",)), ['```json\n{"k": 1}\n```', '{"x": 1}', "none", "{bad"]) == ['{"k": 1}', None, None, None]
    assert values(spark, lambda x: scores.risk_at_least(x, "high"), ["CRITICAL", "HIGH", "LOW"]) == [True, True, False]


def test_upgrade_commands(spark):
    df = spark.createDataFrame([("npm", "@s/a"), ("pip", "b"), ("maven", "g:c"), ("unknown", "d"), (None, "e")], "ecosystem string, name string")
    got = {r["name"]: r["c"] for r in df.select("name", scores.upgrade_command(F.col("ecosystem"), F.col("name")).alias("c")).collect()}
    assert got == {"@s/a": "npm install @s/a@latest", "b": "pip install --upgrade b", "g:c": "mvn versions:use-latest-releases -Dincludes=g:c", "d": None, "e": None}


def test_bloom_parameters():
    assert scores.bloom_params(100_000, 0.001) == (1_437_759, 10)
    for n, p in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            scores.bloom_params(n, p)


def test_numbers_of_any_length(spark):
    rows = [("1.20240101000000000000000", "1.3", 1), ("1.99999999999999999999", "1.100000000000000000000", -1), ("0000000000000000000000012.1", "12.1", 0), ("9223372036854775807", "9223372036854775808", -1), ("2.123456789012345678901234567890123456789012345678", "2.123456789012345678901234567890123456789012345679", -1), ("5.99999999999999999999", "5.a", 1)]
    got = spark.createDataFrame(rows, "a string, b string, c int").select("c", versions.compare_versions(F.col("a"), F.col("b")).alias("got"), versions.compare_versions(F.col("b"), F.col("a")).alias("back")).collect()
    assert [(r["got"], r["back"]) for r in got] == [(c, -c) for _, _, c in rows]


def test_a_key_names_each_step_once(spark):
    df = spark.createDataFrame([("1.2.3-rc",)], "v string").select(versions.parse_version(F.col("v")).alias("k"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") < 10


def test_versions_of_numbers_alone_have_a_sort_key(spark):
    plain = {v for v, k in KEYS.items() if all(isinstance(p, int) and p < versions.HUGE for p in k)}
    got = dict(zip(KEYS, values(spark, lambda x: versions.sort_key(versions.parse_version(x)), list(KEYS)), strict=True))
    assert {v for v, k in got.items() if k is not None} == plain
    assert all((got[a] > got[b]) - (got[a] < got[b]) == compared(KEYS[a], KEYS[b]) for a in plain for b in plain)
