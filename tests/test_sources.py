"""Manifest and feed readers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import graph
from sparkweft.sources import cve_feed, manifests

FILES = {
    "package.json": json.dumps({"dependencies": {"web-frame": "3.7.1", "sorter": "^2.11.4", "g": "git+https://x", "l": "file:../l"}, "devDependencies": {"proof": "8.0.3"}}),
    "requirements.txt": "# comment\ngetter==1.19.3\nsmallweb>=3.1.0\nmatrix\n\n-r other.txt\ntokens[extra]==5.6.2  # why\n",
    "Pipfile": '[packages]\nrequests = "==2.28"\nflask = {version = ">=2.0"}\n[dev-packages]\nblack = "*"\n[requires]\npython_version = "3.11"\n',
    "pyproject.toml": '[project]\ndependencies = ["fastapi>=0.95", "httpx"]\n[project.optional-dependencies]\ndev = ["pytest==7.0"]\n[tool.poetry.dependencies]\npython = "^3.11"\npydantic = "^2.0"\n[tool.poetry.dev-dependencies]\nmypy = "*"\n',
    "pom.xml": "<project xmlns='http://maven.apache.org/POM/4.0.0'><dependencies><dependency><groupId>org.s</groupId><artifactId>core</artifactId><version>5.3</version></dependency><dependency><groupId>j</groupId><artifactId>unit</artifactId><scope>test</scope></dependency></dependencies></project>",
    "package-lock.json": json.dumps({"lockfileVersion": 2, "packages": {"": {"dependencies": {"a": "^1"}}, "node_modules/a": {"version": "1.2.0", "dependencies": {"b": "~2"}}, "node_modules/a/node_modules/b": {"version": "2.1.0", "dev": True}}}),
}


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("p", f"/r/{n}", c) for n, c in FILES.items()], "project_id string, manifest_path string, content string")


def test_all_formats(files):
    rows = manifests.load_manifests(files).collect()
    by = lambda n: {(r["name"], r["version"], r["is_dev"]) for r in rows if r["manifest_path"] == f"/r/{n}"}
    assert by("package.json") == {("web-frame", "3.7.1", False), ("sorter", "2.11.4", False), ("g", "git", False), ("proof", "8.0.3", True)}
    assert by("requirements.txt") == {("getter", "1.19.3", False), ("smallweb", "3.1.0", False), ("matrix", "unknown", False), ("tokens", "5.6.2", False)}
    assert by("Pipfile") == {("requests", "2.28", False), ("flask", "2.0", False), ("black", "unknown", True)}
    assert by("pyproject.toml") == {("fastapi", "0.95", False), ("httpx", "unknown", False), ("pytest", "7.0", False), ("pydantic", "2.0", False), ("mypy", "unknown", True)}
    assert by("pom.xml") == {("org.s:core", "5.3", False), ("j:unit", "unknown", True)}
    lock = {(r["name"], r["version"], r["is_direct"], r["parent"]) for r in rows if r["manifest_path"].endswith("lock.json")}
    assert lock == {("a", "1.2.0", True, "__root__"), ("b", "2.1.0", False, None), ("a", "1", False, "__root__"), ("b", "2", False, "a")}


def test_lock_version_1(spark):
    lock = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0", "dependencies": {"b": {"version": "2.0", "dev": True}}}, "c": {}}}
    df = spark.createDataFrame([("p", "/r/package-lock.json", json.dumps(lock))], "project_id string, manifest_path string, content string")
    got = {(r["name"], r["version"], r["is_dev"], r["parent"]) for r in manifests.parse_package_lock_v1(df).collect()}
    assert got == {("a", "1.0", False, None), ("c", "unknown", False, None), ("b", "2.0", True, "a")}


def manifest(spark, name, content):
    return spark.createDataFrame([("p", f"/r/{name}", content)], "project_id string, manifest_path string, content string")


def test_lock_version_1_nests_without_bound(spark):
    inner = {}
    for depth in range(49, -1, -1):
        inner = {f"d{depth:02d}": {"version": f"{depth}.0", **({"dependencies": inner} if inner else {})}}
    got = manifests.parse_package_lock_v1(manifest(spark, "package-lock.json", json.dumps({"dependencies": inner}))).orderBy("seq").collect()
    assert [(r["name"], r["version"], r["parent"]) for r in got] == [(f"d{k:02d}", f"{k}.0", f"d{k - 1:02d}" if k else None) for k in range(50)]


def test_lock_version_1_knows_direct_packages_and_keeps_the_order(spark):
    lock = {"packages": {"": {"dependencies": {"b": "^1"}, "devDependencies": {"y": "1"}}}, "dependencies": {"b": {"version": "1", "dependencies": {"y": {}, "x": {}}}, "a": {}}}
    got = manifests.parse_package_lock_v1(manifest(spark, "package-lock.json", json.dumps(lock))).orderBy("seq").collect()
    assert [(r["seq"], r["name"], r["is_direct"]) for r in got] == [(1, "b", True), (2, "y", True), (3, "x", False), (4, "a", False)]


def test_installed_versions_can_be_preferred(spark):
    lock = {"lockfileVersion": 2, "packages": {"": {"dependencies": {"a": "^1"}}, "node_modules/a": {"version": "1.2.0", "dependencies": {"b": "~9"}}, "node_modules/b": {"version": "2.1.0"}}}
    deps = manifests.load_manifests(manifest(spark, "package-lock.json", json.dumps(lock)))
    version = lambda **kw: {r["name"]: r["version"] for r in graph.resolve_nodes(deps, **kw).collect()}
    assert version() == {"a": "1.2.0", "b": "9"} and version(prefer_resolved=True) == {"a": "1.2.0", "b": "2.1.0"}


def test_lock_of_many_packages(spark):
    lock = {"lockfileVersion": 3, "packages": {"": {"dependencies": {"p0": "1"}}} | {f"node_modules/p{i}": {"version": f"{i}.0", "dependencies": {"q": "1"}} for i in range(200_000)}}
    got = manifests.load_manifests(manifest(spark, "package-lock.json", json.dumps(lock)))
    row = got.agg(F.count(F.lit(1)), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()
    assert tuple(row) == (400_001, 400_001, 1, 400_001)


def test_wrong_shapes_are_errors_and_the_rest_is_read(spark):
    rows = [
        ("p", "/a/package-lock.json", json.dumps({"lockfileVersion": 2, "packages": ["x"]})), ("p", "/b/package-lock.json", json.dumps({"dependencies": 3})),
        ("p", "/c/package.json", json.dumps({"dependencies": ["x"], "devDependencies": {"ok": "1"}})), ("p", "/d/package.json", "[1]"), ("p", "/e/package.json", json.dumps({"dependencies": {"fine": "2"}})), ("p", "/f/package.json", ""), ("p", "/g/package.json", None),
    ]
    df = spark.createDataFrame(rows, "project_id string, manifest_path string, content string")
    assert {r["name"] for r in manifests.load_manifests(df).collect()} == {"ok", "fine"}
    assert {r["manifest_path"][:2] for r in manifests.parse_errors(df).collect()} == {"/a", "/b", "/c", "/d", "/f", "/g"}


def test_one_odd_entry_leaves_the_rest(spark):
    text = {
        "a/package.json": '{"dependencies":{"a":"1","a":"2","b":"3"},"devDependencies":7}',
        "b/package-lock.json": '{"lockfileVersion":3,"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"1.0","dependencies":{"c":5}},"node_modules/b":"odd","node_modules/d":{"dependencies":["x"]}}}',
        "c/package-lock.json": '{"dependencies":{"a":{"version":"1","dependencies":["x"]},"b":4,"c":{"version":"2","dependencies":{"d":{},"e":"odd"}}}}',
        "d/package-lock.json": '{"lockfileVersion":"x","packages":{"node_modules/a":{"version":"1"}}}',
        "e/requirements.txt": None,
        "f/package.json": '{"dependencies":{"a":"1"}} and more',
        "g/package.json": '{"dependencies":{"a":"1"}} {"dependencies":{"b":"1"}}',
        "h/package-lock.json": '{"lockfileVersion":2,"packages":{"node_modules/a":{"version":"1"},"node_modules/a":{"version":"2"}}}',
        "i/package.json": ' {"name":"empty"} ',
    }
    df = spark.createDataFrame([("p", f"/{n}", c) for n, c in text.items()], "project_id string, manifest_path string, content string")
    rows, errors = manifests.read_all(df)
    got = {}
    for r in rows.collect():
        got.setdefault(r["manifest_path"][1], set()).add((r["name"], r["version"]))
    assert got == {"a": {("a", "2"), ("b", "3")}, "b": {("a", "1.0"), ("a", "1"), ("c", "unknown"), ("d", "unknown")}, "c": {("a", "1"), ("c", "2"), ("d", "unknown")}, "h": {("a", "2")}}
    assert sorted((r["manifest_path"][1], r["error"]) for r in errors.collect()) == [
        ("a", "devDependencies is no object"), ("b", "package 'node_modules/b' is no object"), ("c", "dependencies of package 'a' is no object"), ("c", "package 'b' is no object"), ("c", "package 'e' is no object"),
        ("d", "lockfileVersion is no number"), ("e", "no content"), ("f", "no JSON object"), ("g", "no JSON object"),
    ]


def test_errors_do_not_stop_the_rest(spark):
    rows = [("p", "/r/package.json", "{bad"), ("p", "/r/Pipfile", "= ="), ("p", "/r/pom.xml", "<a>"), ("p", "/r/x.lock", ""), ("p", "/r/requirements.txt", "ok==1")]
    df = spark.createDataFrame(rows, "project_id string, manifest_path string, content string")
    assert [r["name"] for r in manifests.load_manifests(df).collect()] == ["ok"]
    assert {r["manifest_path"] for r in manifests.parse_errors(df).collect()} == {"/r/package.json", "/r/Pipfile", "/r/pom.xml", "/r/x.lock"}


def test_discovery(spark, tmp_path):
    for p in ("a/package.json", "a/Package-Lock.json", "a/README.md", "a/node_modules/x/package.json", "b/pom.xml", "b/other.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    found = manifests.discover_manifests(spark, str(tmp_path)).orderBy("folder", "priority").collect()
    got = [(r["manifest_path"].split("/")[-2:], r["priority"]) for r in found]
    assert {r["manifest_path"] for r in manifests.read_manifests(spark, str(tmp_path)).collect()} == {r["manifest_path"] for r in found}
    assert got == [(["a", "Package-Lock.json"], 0), (["a", "package.json"], 1), (["b", "pom.xml"], 5)]


def test_feed(spark, tmp_path):
    match = lambda uri, **kw: {"vulnerable": True, "cpe23Uri": uri} | kw
    item = {
        "cve": {"CVE_data_meta": {"ID": "CVE-1"}, "description": {"description_data": [{"lang": "en", "value": "x" * 3000}]}}, "publishedDate": "2020-01-01",
        "impact": {"baseMetricV3": {"cvssV3": {"baseScore": 9.8, "vectorString": "AV:N"}}, "baseMetricV2": {"cvssV2": {"baseScore": 5.0}}},
        "configurations": {"nodes": [{"cpe_match": [match("cpe:2.3:a:apache:log4j-core:*", versionStartExcluding="2.0", versionEndIncluding="2.15")], "children": [{"cpe_match": [], "children": [{"cpe_match": [match("cpe:2.3:a:x:json:1.0"), match("cpe:2.3:o:x:os:1"), match("cpe:2.3:a:*:y:1")]}]}]}]},
    }
    with gzip.open(tmp_path / "feed.json.gz", "wt") as f:
        json.dump({"CVE_Items": [item, {"cve": {"CVE_data_meta": {"ID": ""}}}]}, f)
    got = {r["package_name"]: r for r in cve_feed.flatten_cve_items(cve_feed.read_cve_feed(spark, str(tmp_path))).collect()}
    assert set(got) == {"log4j_core", "json"}
    log = got["log4j_core"]
    assert (log["ecosystem"], log["version_start"], log["version_end"], log["version_start_incl"], log["version_end_excl"], log["cvss_score"], len(log["description"])) == ("maven", "2.0", "2.15", False, False, 9.8, 2000)
    assert got["json"]["ecosystem"] == "npm"


def test_feed_children_of_any_depth(spark, tmp_path):
    node = {"cpe_match": [{"vulnerable": True, "cpe23Uri": "cpe:2.3:a:v:bottom:*"}]}
    for k in range(5):
        node = {"cpe_match": [{"vulnerable": True, "cpe23Uri": f"cpe:2.3:a:v:level{k}:*"}], "children": [node, {"cpe_match": None}]}
    (tmp_path / "f.json").write_text(json.dumps({"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": "CVE-9"}}, "configurations": {"nodes": [node]}}]}))
    got = {r["package_name"] for r in cve_feed.flatten_cve_items(cve_feed.read_cve_feed(spark, str(tmp_path))).collect()}
    assert got == {"bottom", *(f"level{k}" for k in range(5))}


def test_one_broken_feed_does_not_stop_the_others(spark, tmp_path):
    item = {"cve": {"CVE_data_meta": {"ID": "CVE-1"}}, "configurations": {"nodes": [{"cpe_match": [{"vulnerable": True, "cpe23Uri": "cpe:2.3:a:v:lib:*"}]}]}}
    with gzip.open(tmp_path / "2021.json.gz", "wt") as f:
        json.dump({"CVE_Items": [item]}, f)
    (tmp_path / "2022.json.gz").write_bytes(b"\x1f\x8b broken")
    (tmp_path / "2023.json").write_text('{"CVE_Items": []}')
    plan = spark.createDataFrame([(n.split(".")[0], str(tmp_path / n)) for n in ("2021.json.gz", "2022.json.gz", "2023.json", "2024.json")], "feed string, path string")
    kept = []
    got = {r["feed"]: r for r in cve_feed.ingest_feeds(spark, plan, lambda df: kept.extend(df.collect()), "2024-06-01 00:00:00").collect()}
    assert [r["cve_id"] for r in kept] == ["CVE-1"]
    assert {f: (r["entries"], r["error"] is None, r["last_modified"] is not None) for f, r in got.items()} == {"2021": (1, True, True), "2022": (0, False, False), "2023": (0, True, False), "2024": (0, False, False)}


def test_refresh_plan(spark):
    feeds = spark.createDataFrame([("2023", "/a"), ("2024", "/b"), ("modified", "/m")], "feed string, path string")
    plan = lambda last, **kw: {r["feed"] for r in cve_feed.refresh_plan(spark.sql(f"SELECT 'all' AS feed, {last} AS last_modified"), feeds, "2024-06-02 00:00:00", **kw).collect()}
    assert plan("cast(null as timestamp)") == {"2023", "2024"}
    assert plan("timestamp'2024-06-01 12:00:00'") == set()
    assert plan("timestamp'2024-05-01 00:00:00'") == {"modified"}
    assert plan("timestamp'2024-06-01 12:00:00'", force=True) == {"2023", "2024"}


def _feed(ident):
    node = {"cpe_match": [{"vulnerable": True, "cpe23Uri": f"cpe:2.3:a:v:{ident}:*"}]}
    return json.dumps({"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": f"CVE-{ident}"}}, "configurations": {"nodes": [node]}}]})


def test_malformed_feeds_are_errors(spark, tmp_path):
    texts = {"2021": _feed("a"), "2022": _feed("b")[:-9], "2023": "hello", "2024": "", "2025": json.dumps({"other": 1}), "2026": _feed("c")}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    plan = spark.createDataFrame([(n, str(tmp_path / f"{n}.json")) for n in [*texts, "2027"]], "feed string, path string")
    stored = []
    got = {r["feed"]: r for r in cve_feed.ingest_feeds(spark, plan, lambda e: stored.extend(e.collect()), "2024-06-02 00:00:00").collect()}
    assert {r["package_name"] for r in stored} == {"a", "c"}
    assert {n: (r["entries"], r["error"] is None, r["last_modified"] is None) for n, r in got.items()} == {"2021": (1, True, False), "2026": (1, True, False)} | {n: (0, False, True) for n in ("2022", "2023", "2024", "2025", "2027")}


def test_feeds_as_a_stream(spark, tmp_path):
    for name, text in {"a": _feed("a"), "b": _feed("b")[:-9], "c": _feed("c")}.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(text)
    run = lambda: cve_feed.feed_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), 1).awaitTermination()
    names = lambda: sorted(r["package_name"] for r in spark.read.parquet(str(tmp_path / "out" / "entries")).collect())
    run()
    assert names() == ["a", "c"]
    errors = spark.read.parquet(str(tmp_path / "out" / "errors")).collect()
    assert [(r["file"].rsplit("/", 1)[-1], r["error"][:14]) for r in errors] == [("b.json", "malformed JSON")]
    (tmp_path / "in" / "d.json").write_text(_feed("d"))
    run()  # goes on where it was
    assert names() == ["a", "c", "d"]
