"""Match packages with vulnerabilities; per-node rollups and snapshot differences."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise_name
from ..functions.scores import bloom_bits, bloom_hashes
from ..functions.versions import bound_key, parse_version, range_contains, sort_key
from ..session import cut
from .intervals import points_in_ranges

P = "project_id"


def match_cves(nodes: DataFrame, cves: DataFrame, ecosystem_aware: bool = False, match_artifact: bool = False) -> DataFrame:
    """(project_id, name, cve_id, cvss_score): versions of nodes within the CVEs' ranges.

    The different (name, version) of all nodes, far fewer than the nodes, meet the ranges;
    a version's key is made once, however many nodes have it. Versions and ranges of
    numbers alone have a total order and meet by :func:`points_in_ranges`, an equi-join
    that makes no pair but the matches. Where a version or an end has other parts, order
    isn't transitive: those alone meet on the normalised name with the range as the
    residual. What matches goes back to the nodes by name and version.
    ``ecosystem_aware`` also asks for the same ecosystem, or an unknown one, of the CVE;
    ``match_artifact`` matches the part of a name after ``:`` or ``/``.
    """
    name = F.element_at(F.split("name", "[:/]"), -1) if match_artifact else F.col("name").cast("string")
    what = ["name", "version", *(["ecosystem"] if ecosystem_aware else [])]
    known = cves.select(normalise_name(F.col("package_name").cast("string")).alias("key")).distinct()
    left = nodes.select(*what).distinct().withColumn("key", normalise_name(name)).join(known, "key", "left_semi").withColumn("v", parse_version(F.col("version")))
    left = cut(left.withColumn("v_sort", sort_key(F.col("v"))))
    right = cves.select(
        "cve_id", "cvss_score", F.col("ecosystem").alias("cve_ecosystem"), normalise_name(F.col("package_name").cast("string")).alias("key"),
        bound_key(F.col("version_start")).alias("lo"), bound_key(F.col("version_end")).alias("hi"), "version_start_incl", "version_end_excl",
    )
    right = right.withColumn("lo_sort", sort_key(F.col("lo"))).withColumn("hi_sort", sort_key(F.col("hi")))
    plain = (F.col("lo").isNull() | F.col("lo_sort").isNotNull()) & (F.col("hi").isNull() | F.col("hi_sort").isNotNull())
    right = cut(right.withColumn("plain", plain))
    sorted_, mixed = left.filter("v_sort IS NOT NULL"), left.filter("v_sort IS NULL")
    hits = points_in_ranges(
        sorted_, right.filter("plain"), ["key"], "v_sort", "lo_sort", "hi_sort",
        F.coalesce("version_start_incl", F.lit(False)), ~F.coalesce("version_end_excl", F.lit(False)),
    )
    within = range_contains(F.col("v"), F.col("lo"), F.col("hi"), F.col("version_start_incl"), F.col("version_end_excl"))
    for a, b in ((mixed, right), (sorted_, right.filter("NOT plain"))):
        hits = hits.unionByName(a.join(b, "key").filter(within))
    if ecosystem_aware:
        hits = hits.filter((F.col("cve_ecosystem") == F.col("ecosystem")) | (F.col("cve_ecosystem") == "unknown"))
    hits = hits.select(*(F.col(c).alias(f"__{c}") for c in what), "cve_id", "cvss_score").distinct()
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in what))
    return nodes.select(P, *what).join(hits, same).select(P, "name", "cve_id", "cvss_score").distinct()


def lookup_package_cves(packages: DataFrame, cves: DataFrame) -> DataFrame:
    """CVE rows of packages (name, optional ecosystem), in no order; a CVE of unknown ecosystem suits any."""
    p = packages.select(F.col("name"), normalise_name(F.col("name")).alias("key"), *([F.col("ecosystem").alias("wanted")] if "ecosystem" in packages.columns else [F.lit(None).cast("string").alias("wanted")]))
    c = cves.withColumn("key", normalise_name(F.col("package_name")))
    hit = p.join(c, "key").filter(F.col("wanted").isNull() | (F.col("ecosystem") == F.col("wanted")) | (F.col("ecosystem") == "unknown"))
    return hit.drop("key", "wanted")


def vulnerable_nodes(matches: DataFrame) -> DataFrame:
    """(project_id, name, cvss_score, cve_ids, primary_cve): a row per node, ids by score, then id."""
    ranked = matches.groupBy(P, "name").agg(F.max("cvss_score").alias("cvss_score"), F.sort_array(F.collect_set(F.struct((-F.col("cvss_score")).alias("s"), F.col("cve_id").alias("id")))).alias("c"))
    return ranked.select(P, "name", "cvss_score", F.array_distinct(F.col("c.id")).alias("cve_ids"), F.coalesce(F.element_at("c.id", 1), F.lit("UNKNOWN")).alias("primary_cve"))


def known_packages(nodes: DataFrame, cves: DataFrame) -> DataFrame:
    """The nodes whose normalised name is a vulnerable package: the prefilter before versions are compared.

    A plain semi-join; Spark places its own runtime filter in front of it.
    """
    names = cves.select(normalise_name(F.col("package_name").cast("string")).alias("__key")).distinct()
    return nodes.join(names, normalise_name(nodes["name"].cast("string")) == F.col("__key"), "left_semi")


def bloom_stats(cves: DataFrame, fp_rate: float = 0.01) -> DataFrame:
    """One row (n_items, n_bits, n_hashes, fill_ratio, fp_rate): what a filter over the distinct names would need."""
    names = cves.agg(F.count_distinct(normalise_name(F.col("package_name").cast("string"))).alias("n_items"))
    n = F.greatest(F.lit(1), "n_items")
    rows = names.withColumn("n_bits", bloom_bits(n, F.lit(fp_rate))).withColumn("n_hashes", bloom_hashes(n, F.col("n_bits")))
    fill = 1 - F.exp(-F.col("n_hashes") * F.col("n_items") / F.col("n_bits"))
    return rows.select("n_items", "n_bits", "n_hashes", F.bround(fill, 4).alias("fill_ratio"), F.bround(F.pow(fill, F.col("n_hashes")), 6).alias("fp_rate"))


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, change_type, name, old_version, new_version) between two snapshots (project_id, name, version).

    A changed version is also an added and a removed row, as the two sets of (name,
    version) pairs differ. Versions of a name are compared pair by pair.
    """
    a, b = old.select(P, "name", "version").distinct(), new.select(P, "name", "version").distinct()
    none = F.lit(None).cast("string")
    added = b.join(a, [P, "name", "version"], "left_anti").select(P, F.lit("added").alias("change_type"), "name", none.alias("old_version"), F.col("version").alias("new_version"))
    removed = a.join(b, [P, "name", "version"], "left_anti").select(P, F.lit("removed").alias("change_type"), "name", F.col("version").alias("old_version"), none.alias("new_version"))
    changed = a.withColumnRenamed("version", "old_version").join(b.withColumnRenamed("version", "new_version"), [P, "name"]).filter("old_version <> new_version")
    return added.unionByName(removed).unionByName(changed.select(P, F.lit("version_changed").alias("change_type"), "name", "old_version", "new_version"))
