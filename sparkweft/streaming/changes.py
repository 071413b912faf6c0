"""Streams of snapshots and of vulnerabilities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.names import normalise_name
from ..functions.scores import cvss_band, risk_at_least
from ..functions.versions import bound_key, parse_version, range_contains

P = "project_id"
SNAPSHOT = "project_id string, taken_at timestamp, name string, version string"
CHANGE = "project_id string, taken_at timestamp, change_type string, name string, old_version string, new_version string"
_KEPT = "taken_at timestamp, names array<string>, versions array<string>"


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """Changes between successive snapshots of each project (project_id, taken_at, name, version).

    Returns project_id, taken_at, change_type, name, old_version, new_version; the first
    snapshot of a project changes nothing. A changed version is also added and removed.
    """
    rows = rows.select(P, "taken_at", "name", "version").distinct()
    times = rows.select(P, "taken_at").distinct().withColumn("next_at", F.lead("taken_at").over(Window.partitionBy(P).orderBy("taken_at")))
    first = times.groupBy(P).agg(F.min("taken_at").alias("first"))
    old = rows.join(times, [P, "taken_at"]).filter("next_at IS NOT NULL").select(P, F.col("next_at").alias("taken_at"), "name", "version")
    new = rows.join(first, P).filter("taken_at > first").select(P, "taken_at", "name", "version")
    key, none = [P, "taken_at", "name"], F.lit(None).cast("string")
    added = new.join(old, [*key, "version"], "left_anti").select(*key, F.lit("added").alias("change_type"), none.alias("old_version"), F.col("version").alias("new_version"))
    removed = old.join(new, [*key, "version"], "left_anti").select(*key, F.lit("removed").alias("change_type"), F.col("version").alias("old_version"), none.alias("new_version"))
    changed = old.withColumnRenamed("version", "old_version").join(new.withColumnRenamed("version", "new_version"), key).filter("old_version <> new_version")
    every = added.unionByName(removed).unionByName(changed.select(*key, F.lit("version_changed").alias("change_type"), "old_version", "new_version"))
    return every.select(P, "taken_at", "change_type", "name", "old_version", "new_version")


def _differences(old: set[tuple], new: set[tuple]) -> Iterator[tuple]:
    """(change_type, name, old_version, new_version) between two sets of (name, version)."""
    yield from (("added", name, None, v) for name, v in new - old)
    yield from (("removed", name, v, None) for name, v in old - new)
    before: dict[str, list] = {}
    for name, v in old:
        before.setdefault(name, []).append(v)
    yield from (("version_changed", name, v, w) for name, w in new for v in before.get(name, ()) if None not in (v, w) and v != w)


def dependency_changes(snapshots: DataFrame) -> DataFrame:
    """The changes of a stream of snapshots; the state keeps each project's last one.

    Rows without project, time or name are skipped. Snapshots that come late, no newer
    than the last one kept, are left out of comparison. A snapshot must arrive whole in
    one micro-batch. The result is that of :func:`snapshot_changes` over all rows.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = None, set()
        if state.exists:
            at, names, versions = state.get
            last = set(zip(names, versions, strict=True))
        taken: dict[pd.Timestamp, set] = {}
        for part in parts:
            for t, name, version in part[["taken_at", "name", "version"]].itertuples(index=False):
                if at is None or t > pd.Timestamp(at):
                    taken.setdefault(t, set()).add((name, version))
        out = []
        for t in sorted(taken):
            if at is not None:
                out += [(key[0], t, *change) for change in _differences(last, taken[t])]
            at, last = t, taken[t]
        if taken:
            names, versions = zip(*sorted(last, key=str))
            state.update((at.to_pydatetime(), list(names), list(versions)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"taken_at": "datetime64[us]"})

    known = snapshots.filter("project_id IS NOT NULL AND taken_at IS NOT NULL AND name IS NOT NULL").select(P, "taken_at", "name", "version")
    return known.groupBy(P).applyInPandasWithState(step, CHANGE, _KEPT, "append", GroupStateTimeout.NoTimeout)


_OPEN = "at bigint, names array<string>, versions array<string>, open_at array<bigint>, open_names array<string>, open_versions array<string>"


def spread_changes(snapshots: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """The changes of a stream of snapshots whose rows may come in any number of micro-batches.

    A snapshot is open until the stream's watermark (the latest time seen, less
    ``lateness``) has passed its time; then an event-time timer closes it and it is compared
    with the one before. So the last snapshot waits for a later row of any project. Rows
    of closed snapshots come too late and are left out, and so are rows without project,
    time or name. Per project the state holds the last closed snapshot and the open ones.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, taken = None, set(), {}
        if state.exists:
            at, names, versions, *opened = state.get
            last = set(zip(names, versions, strict=True))
            for t, *row in zip(*opened, strict=True):
                taken.setdefault(t, set()).add(tuple(row))
        if not state.hasTimedOut:
            for part in parts:
                for t, name, version in part[["at", "name", "version"]].itertuples(index=False):
                    if at is None or t > at:
                        taken.setdefault(t, set()).add((name, version))
        out, mark = [], state.getCurrentWatermarkMs()
        for t in sorted(t for t in taken if t < mark * 1000):
            if at is not None:
                out += [(key[0], t, *change) for change in _differences(last, taken[t])]
            at, last = t, taken.pop(t)
        rows = [(t, *row) for t, some in taken.items() for row in some]
        state.update((at, [n for n, _ in last], [v for _, v in last], [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        if taken:
            state.setTimeoutTimestamp(max(min(taken) // 1000 + 1, mark + 1))
        yield pd.DataFrame(out, columns=[P, "at", "change_type", "name", "old_version", "new_version"]).astype({"at": "int64"})

    known = snapshots.filter("project_id IS NOT NULL AND taken_at IS NOT NULL AND name IS NOT NULL").select(P, "taken_at", "name", "version")
    known = known.withWatermark("taken_at", f"{lateness} 1 millisecond")  # rows at the watermark itself would be late
    made = known.withColumn("at", F.unix_micros("taken_at")).groupBy(P).applyInPandasWithState(step, CHANGE.replace("taken_at timestamp", "at bigint"), _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(P, F.timestamp_micros("at").alias("taken_at"), "change_type", "name", "old_version", "new_version")


def dependency_change_stream(snapshots: DataFrame, out: str, checkpoint: str, lateness: str | None = None) -> StreamingQuery:
    """Append the changes of a stream of snapshots to the Parquet files of ``out``, until its input is used up.

    By :func:`dependency_changes`, or with ``lateness`` by :func:`spread_changes`.
    """
    made = dependency_changes(snapshots) if lateness is None else spread_changes(snapshots, lateness)
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cve_alerts(cves: DataFrame, nodes: DataFrame, min_severity: str = "HIGH") -> DataFrame:
    """New CVE rows (a stream or a batch) against the nodes: project_id, name, cve_id, cvss_score, severity, seen_at.

    Stream-static join on the name, the range as its residual; an alert is given once
    within the watermark.
    """
    static = nodes.select(P, "name", normalise_name(F.col("name").cast("string")).alias("key"), parse_version(F.col("version")).alias("v"))
    rows = cves.filter(risk_at_least(cvss_band(F.col("cvss_score")), min_severity)).withColumn("key", normalise_name(F.col("package_name").cast("string")))
    hit = rows.join(static, "key").filter(range_contains(F.col("v"), bound_key(F.col("version_start")), bound_key(F.col("version_end")), F.col("version_start_incl"), F.col("version_end_excl")))
    out = hit.select(P, "name", "cve_id", "cvss_score", cvss_band(F.col("cvss_score")).alias("severity"), "seen_at")
    return out.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark([P, "name", "cve_id"]) if out.isStreaming else out.dropDuplicates([P, "name", "cve_id"])


def alerts_both_ways(cves: DataFrame, packages: DataFrame, min_severity: str = "HIGH", within: str = "365 days", lateness: str = "1 day") -> DataFrame:
    """Alerts for new CVEs on known packages and for new packages with known CVEs, from two streams.

    ``cves``: cve_entries with seen_at. ``packages``: project_id, name, version, added_at. A
    stream-stream join keeps both sides in state for ``within`` of event time, and a pair
    of rows gives one alert, whichever came first. Returns project_id, name, version,
    cve_id, cvss_score, severity, seen_at, added_at.
    """
    span = F.expr(f"INTERVAL {within}")
    rows = cves.filter(risk_at_least(cvss_band(F.col("cvss_score")), min_severity)).select(
        "cve_id", "cvss_score", "seen_at", normalise_name(F.col("package_name").cast("string")).alias("key"),
        bound_key(F.col("version_start")).alias("lo"), bound_key(F.col("version_end")).alias("hi"), "version_start_incl", "version_end_excl",
    ).withWatermark("seen_at", lateness)
    known = packages.select(P, "name", "version", "added_at", normalise_name(F.col("name").cast("string")).alias("__key"), parse_version(F.col("version")).alias("v")).withWatermark("added_at", lateness)
    near = (F.col("added_at") >= F.col("seen_at") - span) & (F.col("added_at") <= F.col("seen_at") + span)
    hit = rows.join(known, (F.col("key") == F.col("__key")) & near)
    hit = hit.filter(range_contains(F.col("v"), F.col("lo"), F.col("hi"), F.col("version_start_incl"), F.col("version_end_excl")))
    return hit.select(P, "name", "version", "cve_id", "cvss_score", cvss_band(F.col("cvss_score")).alias("severity"), "seen_at", "added_at")


#: Parts of the table by the CVE's hash, and the folders of a part from which on it is rewritten.
BUCKETS, MOST_FOLDERS = 16, 8


def cve_upsert_stream(incoming: DataFrame, path: str, checkpoint: str, most: int = MOST_FOLDERS) -> StreamingQuery:
    """Add a stream of cve_entries to the table below ``path``: each micro-batch is a folder of its own, in BUCKETS parts.

    A batch that runs twice overwrites its own folder. Parts that ``most`` batches have
    touched are compacted after a batch. :func:`current_cves` reads the table.
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = df.dropDuplicates().withColumn("bucket", F.pmod(F.xxhash64("cve_id"), F.lit(BUCKETS)).cast("int"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/folder=added/batch={n}")
        compact_cves(df.sparkSession, path, most)

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table with their batch, bucket and folder (added or merged)."""
    return spark.read.parquet(path)


def _last(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("cve_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["cve_id", "batch"], "left_semi").drop("folder").dropDuplicates()


def compact_cves(spark: SparkSession, path: str, most: int = MOST_FOLDERS) -> list[int]:
    """Rewrite the parts that ``most`` folders or more hold, each to one file of its current rows; returns these parts.

    A part's file comes whole or not at all, stands for its newest batch, and holds all that
    older folders say of its CVEs; only then do these go. So a reader finds the same
    rows at any moment of a compaction that fails, and a batch may run again after it.
    """
    rows = _stored(spark, path)
    held = rows.select("bucket", "folder", "batch").distinct().collect()  # a row for each folder, fewer than BUCKETS x most
    by: dict[int, list] = {}
    for r in held:
        by.setdefault(r["bucket"], []).append(r)
    full = sorted(b for b, some in by.items() if len(some) >= most)
    if full:
        newest = max(r["batch"] for r in held)
        whole = _last(rows.filter(F.col("bucket").isin(full))).drop("batch")
        whole.repartition(len(full), "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/folder=merged/batch={newest}")
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for b in full:
            for r in by[b]:
                if (r["folder"], r["batch"]) != ("merged", newest):
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/folder={r['folder']}/batch={r['batch']}/bucket={b}"), True)
    return full


def current_cves(spark: SparkSession, path: str) -> DataFrame:
    """The entries as they stand: of each CVE all ranges of the last batch that brought any."""
    return _last(_stored(spark, path)).drop("batch", "bucket")
