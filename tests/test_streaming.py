"""Streams run to their end over files that arrive in two goes."""

from pyspark.sql import functions as F

from sparkweft.streaming import changes

CVE = "cve_id string, package_name string, ecosystem string, version_start string, version_end string, version_start_incl boolean, version_end_excl boolean, cvss_score double, seen_at timestamp"


def test_changes_over_batches(spark, tmp_path):
    src, out, log = (str(tmp_path / d) for d in ("in", "out", "log"))
    given = []

    def put(rows):
        given.extend(rows)
        spark.createDataFrame(rows, "project_id string, taken_at string, name string, version string").withColumn("taken_at", F.to_timestamp("taken_at")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(changes.SNAPSHOT).parquet(src)
        changes.dependency_change_stream(stream, out, log).awaitTermination()

    put([("p", "2024-01-01", "x", "1"), ("p", "2024-01-01", "y", "1"), ("q", "2024-01-01", "z", "1"), (None, "2024-01-01", "bad", "1")])
    assert spark.read.schema(changes.CHANGE).parquet(out).count() == 0
    put([("p", "2024-01-02", "x", "2"), ("p", "2024-01-03", "x", "2"), ("p", "2024-01-03", "w", "1")])
    got = {(r["project_id"], r["change_type"], r["name"], r["old_version"], r["new_version"]) for r in spark.read.schema(changes.CHANGE).parquet(out).collect()}
    assert got == {("p", "added", "x", None, "2"), ("p", "removed", "x", "1", None), ("p", "version_changed", "x", "1", "2"), ("p", "removed", "y", "1", None), ("p", "added", "w", None, "1")}
    put([("q", "2023-12-31", "late", "1"), ("q", "2024-01-05", "z", "1"), ("q", "2024-01-05", "v", None)])  # older than the state; then a new one
    rows = spark.createDataFrame([r for r in given if r[0] and r[2] != "late"], "project_id string, taken_at string, name string, version string").withColumn("taken_at", F.to_timestamp("taken_at"))
    want = changes.snapshot_changes(rows).collect()
    assert sorted(map(str, spark.read.schema(changes.CHANGE).parquet(out).collect())) == sorted(map(str, want)) and len(want) == 6


def entries(spark, rows):
    return spark.createDataFrame([(*r, "2024-01-01 00:00:00") for r in rows], CVE.replace("seen_at timestamp", "seen_at string")).withColumn("seen_at", F.to_timestamp("seen_at"))


def test_upsert_and_alerts(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "cves")
    row = lambda cve, end, score: (cve, "lib", "npm", "", end, False, True, score)
    for rows in ([row("C1", "1.0", 9.5), row("C2", "2.0", 3.0)], [row("C1", "3.0", 9.9)]):
        entries(spark, rows).coalesce(1).write.mode("append").parquet(src)
        changes.cve_upsert_stream(spark.readStream.schema(CVE).parquet(src), path, str(tmp_path / "log")).awaitTermination()
    stored = {(r["cve_id"], r["version_end"]) for r in changes.current_cves(spark, path).collect()}
    assert stored == {("C1", "3.0"), ("C2", "2.0")}
    nodes = spark.createDataFrame([("p", "Lib", "1.5")], "project_id string, name string, version string")
    alerts = changes.cve_alerts(spark.readStream.schema(CVE).parquet(src), nodes, "HIGH")
    q = alerts.writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "log2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["name"], r["cve_id"], r["severity"]) for r in spark.table("alerts").collect()] == [("Lib", "C1", "CRITICAL")]


def test_a_snapshot_over_three_batches(spark, tmp_path):
    src, out, log = (str(tmp_path / d) for d in ("in", "out", "log"))
    given = []

    def put(*rows):
        given.extend(rows)
        spark.createDataFrame(rows, "project_id string, taken_at string, name string, version string").withColumn("taken_at", F.to_timestamp("taken_at")).coalesce(1).write.mode("append").parquet(src)
        changes.dependency_change_stream(spark.readStream.schema(changes.SNAPSHOT).parquet(src), out, log, "0 seconds").awaitTermination()
        return {(r["project_id"], r["change_type"], r["name"], r["old_version"], r["new_version"]) for r in spark.read.schema(changes.CHANGE).parquet(out).collect()}

    put(("p", "2024-01-01", "x", "1"), ("p", "2024-01-01", "y", "1"), ("q", "2024-01-01", "z", "1"), (None, "2024-01-01", "bad", "1"))
    put(("p", "2024-01-08", "x", "2"))
    put(("p", "2024-01-08", "y", "1"), ("q", "2024-01-08", "z", None))
    assert put(("p", "2024-01-08", "w", "5")) == set()  # the second snapshot is still open
    got = put(("r", "2024-01-09", "only", "1"), ("p", "2024-01-02", "late", "1"))
    assert got == {("p", "added", "x", None, "2"), ("p", "removed", "x", "1", None), ("p", "version_changed", "x", "1", "2"), ("p", "added", "w", None, "5"), ("q", "added", "z", None, None), ("q", "removed", "z", "1", None)}
    rows = spark.createDataFrame([r for r in given if r[0] and r[2] != "late"], "project_id string, taken_at string, name string, version string").withColumn("taken_at", F.to_timestamp("taken_at"))
    assert got == {(r["project_id"], r["change_type"], r["name"], r["old_version"], r["new_version"]) for r in changes.snapshot_changes(rows).collect()}


def test_a_package_that_comes_after_its_cve(spark, tmp_path):
    cve, pkg, log = (str(tmp_path / d) for d in ("cve", "pkg", "log"))
    package = "project_id string, name string, version string, added_at timestamp"

    def run(cves, packages):
        if cves:
            entries(spark, cves).coalesce(1).write.mode("append").parquet(cve)
        if packages:
            spark.createDataFrame([(*r, "2024-01-03") for r in packages], package.replace("timestamp", "string")).withColumn("added_at", F.to_timestamp("added_at")).coalesce(1).write.mode("append").parquet(pkg)
        alerts = changes.alerts_both_ways(spark.readStream.schema(CVE).parquet(cve), spark.readStream.schema(package).parquet(pkg), "HIGH")
        out = str(tmp_path / "out")
        alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["project_id"], r["version"], r["cve_id"]) for r in spark.read.schema(alerts.schema).parquet(out).collect())

    row = lambda cve, end, score: (cve, "lib", "npm", "", end, False, True, score)
    assert run([row("C1", "2.0", 9.5), row("low", "9", 3.0)], [("p", "Lib", "2.5")]) == []
    assert run([], [("q", "lib", "1.5")]) == [("q", "1.5", "C1")]
    assert run([row("C2", "3.0", 8.0)], []) == [("p", "2.5", "C2"), ("q", "1.5", "C1"), ("q", "1.5", "C2")]


def test_compaction(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "cves")
    row = lambda i, end: (f"C{i}", "lib", "npm", "", end, False, True, 5.0)
    want = {}
    for n in range(7):
        some = [row(i, f"{n}.{k}") for i in range(n, 40, n + 1) for k in (0, 1)]
        want |= {r[0]: set() for r in some}
        for r in some:
            want[r[0]].add(r[4])
        entries(spark, some).coalesce(1).write.mode("append").parquet(src)
        changes.cve_upsert_stream(spark.readStream.schema(CVE).parquet(src), path, str(tmp_path / "log"), 3).awaitTermination()
        got = {}
        for r in changes.current_cves(spark, path).collect():
            assert r["version_end"] not in got.setdefault(r["cve_id"], set())
            got[r["cve_id"]].add(r["version_end"])
        assert got == want
    folders = [p for p in tmp_path.glob("cves/folder=*/batch=*/bucket=*") if list(p.glob("*.parquet"))]
    assert len(folders) <= 3 * changes.BUCKETS and any("merged" in str(p) for p in folders)
