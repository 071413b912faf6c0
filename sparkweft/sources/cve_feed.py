"""Vulnerability feeds: read, flatten, store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from ..constants import ECOSYSTEM_HINTS
from ..functions.names import guess_ecosystem, normalise_name
from ..session import cut

#: A configuration node; what it has below stays text until it is read, so there is no bound on the depth.
_NODES = (
    "array<struct<cpe_match:array<struct<vulnerable:boolean,cpe23Uri:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>,"
    "children:string>>"
)

ITEM = (
    "cve struct<CVE_data_meta:struct<ID:string>,description:struct<description_data:array<struct<lang:string,value:string>>>>, publishedDate string, "
    "impact struct<baseMetricV3:struct<cvssV3:struct<baseScore:double,vectorString:string>>,baseMetricV2:struct<cvssV2:struct<baseScore:double,vectorString:string>>>, "
    f"configurations struct<nodes:{_NODES}>"
)


_FILE = "CVE_Items array<struct<{}>>, broken string".format(",".join(p.strip().replace(" ", ":", 1) for p in ITEM.split(", ")))


def _files(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """(file, items, error): feed files (JSON, also gzipped), a row each; the items are null where there is an error."""
    rows = reader.schema(_FILE).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(path)
    error = F.when(F.col("broken").isNotNull(), F.concat(F.lit("malformed JSON: "), F.left("broken", F.lit(60)))).when(F.col("CVE_Items").isNull(), "no CVE_Items")
    return rows.select(F.input_file_name().alias("file"), F.when(error.isNull(), F.col("CVE_Items")).alias("items"), error.alias("error"))


def _items(files: DataFrame) -> DataFrame:
    return files.select(F.explode("items").alias("i")).select("i.*")


def read_cve_feed(spark: SparkSession, path: str) -> DataFrame:
    """The items of feed files (JSON, also gzipped), a row each; those of malformed files are left out."""
    return _items(_files(spark.read, path))


def with_matches(rows: DataFrame) -> DataFrame:
    """Each row of ``rows`` (with a column ``nodes``) once per CPE match ``m`` of its nodes, however deep, a level a round."""
    level = rows.withColumn("n", F.explode("nodes")).drop("nodes")
    out = None
    while True:
        own = level.withColumn("m", F.explode("n.cpe_match")).drop("n")
        out = own if out is None else out.unionByName(own)
        inner = level.filter("n.children IS NOT NULL").withColumn("n", F.explode(F.from_json("n.children", _NODES)))
        level = cut(inner)
        if level.isEmpty():
            return out


def flatten_cve_items(items: DataFrame) -> DataFrame:
    """cve_entries: a row per (cve, package, range) of vulnerable applications.

    A match without any range is open on both sides. The score is that of CVSS v3, else
    v2, else 0; the description the first English one, up to 2000 characters.
    """
    v3, v2 = F.col("impact.baseMetricV3.cvssV3"), F.col("impact.baseMetricV2.cvssV2")
    english = F.element_at(F.filter("cve.description.description_data", lambda d: d["lang"] == "en"), 1)["value"]
    base = items.filter("coalesce(cve.CVE_data_meta.ID, '') <> ''").select(
        F.col("cve.CVE_data_meta.ID").alias("cve_id"),
        F.coalesce(F.when(v3.isNotNull(), F.coalesce(v3["baseScore"], F.lit(0.0))), F.when(v2.isNotNull(), v2["baseScore"]), F.lit(0.0)).alias("cvss_score"),
        F.coalesce(F.when(v3.isNotNull(), F.coalesce(v3["vectorString"], F.lit(""))), v2["vectorString"], F.lit("")).alias("cvss_vector"),
        F.coalesce(F.left(english, F.lit(2000)), F.lit("")).alias("description"), F.coalesce("publishedDate", F.lit("")).alias("published_date"),
        F.col("configurations.nodes").alias("nodes"),
    )
    parts = with_matches(base).filter("m.vulnerable").withColumn("p", F.split("m.cpe23Uri", ":"))
    apps = parts.filter((F.size("p") >= 5) & (F.get("p", 2) == "a")).withColumn("vendor", F.get("p", 3)).withColumn("product", F.get("p", 4)).filter(~F.col("vendor").isin("*", "-") & ~F.col("product").isin("*", "-"))
    text = lambda c: F.nullif(F.col(f"m.{c}"), F.lit(""))
    return apps.select(
        "cve_id", normalise_name(F.col("product")).alias("package_name"), guess_ecosystem(F.col("vendor"), F.col("product"), ECOSYSTEM_HINTS).alias("ecosystem"),
        F.coalesce(text("versionStartIncluding"), text("versionStartExcluding"), F.lit("")).alias("version_start"),
        F.coalesce(text("versionEndExcluding"), text("versionEndIncluding"), F.lit("")).alias("version_end"),
        text("versionStartIncluding").isNotNull().alias("version_start_incl"), text("versionEndExcluding").isNotNull().alias("version_end_excl"),
        "cvss_score", "cvss_vector", "description", "published_date",
    ).dropDuplicates(["cve_id", "package_name", "version_start", "version_end"])


def upsert_cves(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All ranges of the incoming CVEs replace those stored under the same ids."""
    return existing.join(incoming.select("cve_id").distinct(), "cve_id", "left_anti").unionByName(incoming.distinct())


def refresh_plan(state: DataFrame, feeds: DataFrame, now: str, force: bool = False, max_age_hours: int = 24) -> DataFrame:
    """The feeds to read: all if forced or nothing was read yet, none while young, else ``modified`` alone.

    ``state``: feed, last_modified. ``feeds``: feed (``modified`` or a year), path.
    """
    last = state.agg(F.max("last_modified").alias("last"))
    age = F.timestamp_diff("HOUR", F.col("last"), F.lit(now).cast("timestamp"))
    full = F.col("last").isNull() | F.lit(force)
    wanted = F.when(full, F.col("feed") != "modified").otherwise((age >= max_age_hours) & (F.col("feed") == "modified"))
    return feeds.crossJoin(F.broadcast(last)).filter(wanted).select("feed", "path")


def ingest_feeds(spark: SparkSession, plan: DataFrame, store: Callable[[DataFrame], None], now: str) -> DataFrame:
    """Read the feeds of a plan (feed, path; a few dozen rows) one by one and store their entries.

    A feed that can't be read, is malformed or empty has an error; what could be read of it
    is stored, and the others go on. Returns feed, entries, error, last_modified: the
    state's new stamp, ``now`` for the feeds that brought entries and no error, null for
    all others, so that these are read again.
    """
    done = []
    for feed in plan.orderBy("feed").collect():
        n, error = 0, None
        try:
            files = cut(_files(spark.read, feed["path"]))
            some, bad, error = files.agg(F.count(F.lit(1)), F.count("error"), F.min(F.concat_ws(": ", "file", "error"))).first()
            error = "no content" if not some else error if bad else None
            entries = cut(flatten_cve_items(_items(files)))
            if n := entries.count():
                store(entries)
        except Exception as e:  # one broken year doesn't stop the others
            n, error = 0, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        done.append((feed["feed"], n, error, now if n and not error else None))
    rows = spark.createDataFrame(done, "feed string, entries long, error string, last_modified string")
    return rows.withColumn("last_modified", F.col("last_modified").cast("timestamp"))


def feed_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, files_at_once: int = 8) -> StreamingQuery:
    """Read the feed files of a folder as they come, each once; which ones were read is in the checkpoint.

    A micro-batch adds a partition of entries below ``out``/entries and one of (file,
    error) below ``out``/errors; a batch that runs again after a failure overwrites its own.
    """

    def batch(files: DataFrame, n: int) -> None:
        files = cut(files)
        flatten_cve_items(_items(files)).write.mode("overwrite").parquet(f"{out}/entries/batch={n}")
        files.filter("error IS NOT NULL").select("file", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={n}")

    files = _files(spark.readStream.option("maxFilesPerTrigger", files_at_once), folder)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
