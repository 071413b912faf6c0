"""Reports: counts, summaries, gates, recommendations, the attack subgraph and whole reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_PATHS, ROOT
from ..functions.scores import band_rank, confidence, cvss_band, risk_at_least, upgrade_command

P = "project_id"


def severity_counts(nodes: DataFrame, vuln: DataFrame) -> DataFrame:
    """Packages by band for each project: total, vulnerable, clean and one column per band."""
    rows = nodes.select(P, "name").distinct().join(vuln.select(P, "name", "cvss_score"), [P, "name"], "left")
    band = cvss_band(F.coalesce("cvss_score", F.lit(0.0)))
    return rows.groupBy(P).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("cvss_score") > 0).alias("vulnerable"), F.count_if(band == "CLEAN").alias("clean"),
        *[F.count_if(band == b).alias(b.lower()) for b in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )


def risk_summary(blast: DataFrame, clusters: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, risk): by the highest score, CRITICAL if a trust cluster is; CLEAN without findings."""
    top = blast.groupBy(P).agg(F.max("cvss_score").alias("top"))
    bad = clusters.groupBy(P).agg(F.bool_or(F.col("risk_level") == "CRITICAL").alias("bad"))
    rows = projects.select(P).distinct().join(top, P, "left").join(bad, P, "left")
    return rows.select(P, F.when(F.coalesce("bad", F.lit(False)), "CRITICAL").otherwise(cvss_band(F.coalesce("top", F.lit(0.0)))).alias("risk"))


def portfolio_rollup(vuln: DataFrame, nodes: DataFrame) -> DataFrame:
    """Packages by ecosystem and band, with subtotals (null: all)."""
    rows = nodes.select(P, "name", "ecosystem").join(vuln.select(P, "name", "cvss_score"), [P, "name"], "left")
    rows = rows.select("ecosystem", cvss_band(F.coalesce("cvss_score", F.lit(0.0))).alias("severity"), P)
    return rows.rollup("ecosystem", "severity").agg(F.count(F.lit(1)).alias("packages"), F.count_distinct(P).alias("projects"))


def ci_gate(summary: DataFrame, threshold: str = "HIGH") -> DataFrame:
    """The projects whose risk reaches the threshold."""
    return summary.filter(risk_at_least(F.col("risk"), threshold)).select(P, "risk", band_rank(F.col("risk")).alias("rank"))


def fallback_recommendations(blast: DataFrame, ecosystems: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Patch advice for each blast row, from its figures alone.

    ``recommended_version`` is always the newest one. The explanation says what was
    found, then how far it spreads; the summary is the best attack path, if there is one.
    """
    rows = blast.join(ecosystems.select(P, "ecosystem"), P, "left")
    best = F.lit(None).cast("array<string>") if paths is None else F.col("__best")
    if paths is not None:
        first = paths.filter("rank = 1").select(P, F.col("source").alias("source_node"), F.col("path").cast("array<string>").alias("__best"))
        rows = rows.join(first, [P, "source_node"], "left")
    name, n = F.col("source_node").cast("string"), F.col("reachable_count")
    found = F.format_string("%s has a score of %.1f in %s.", F.col("cve_id"), F.col("cvss_score"), name)
    spread = F.when(n == 0, F.lit("No other package can be reached from it.")).otherwise(F.format_string("From it %d packages can be reached.", n))
    kinds = F.when(F.size("sink_types") > 0, F.concat(F.lit(" Sensitive access: "), F.array_join(F.array_sort("sink_types"), ", "), F.lit("."))).otherwise("")
    return rows.select(
        P, F.col("source_node").alias("package_name"), F.array("cve_id").alias("cve_ids"), "cvss_score", F.lit("latest").alias("recommended_version"),
        F.concat(found, F.lit(" "), spread, kinds).alias("threat_explanation"),
        F.lit("Not known: a newest release can change its interface.").alias("breaking_changes"), upgrade_command(F.col("ecosystem"), name).alias("upgrade_command"),
        confidence(F.col("cvss_score")).alias("confidence"),
        F.coalesce(F.concat(F.lit("path: "), F.array_join(best, " > ")), F.lit("no path to a sensitive package")).alias("attack_path_summary"), "blast_radius_score",
    )


def merge_recommendations(curated: DataFrame, fallback: DataFrame, top: int = 10) -> DataFrame:
    """Curated rows win over fallback rows of a package; the ``top`` of each project by blast, confidence, score."""
    rest = fallback.join(curated.select(P, "package_name"), [P, "package_name"], "left_anti")
    best = Window.partitionBy(P).orderBy(F.desc("blast_radius_score"), F.desc(band_rank(F.col("confidence"))), F.desc("cvss_score"), "package_name")
    return curated.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def top_paths(paths: DataFrame, top: int = 8) -> DataFrame:
    """A project's best attack paths over all sources."""
    best = Window.partitionBy(P).orderBy(F.desc("exploit_score"), "path_length", "path")
    return paths.withColumn("overall_rank", F.row_number().over(best)).filter(F.col("overall_rank") <= top)


def attack_subgraph(blast: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (project_id, id, type) and links (project_id, source, target) behind the attack paths; ids are strings."""
    text = lambda c: F.col(c).cast("string")
    vuln = blast.select(P, text("source_node").alias("id"))
    steps = paths.select(P, F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).cast("string").alias("source"), F.get("path", i).cast("string").alias("target")))).alias("__link")).select(P, "__link.*")
    links = vuln.select(P, F.lit(ROOT).alias("source"), F.col("id").alias("target")).unionByName(steps).distinct()
    seen = paths.select(P, F.explode(F.transform("path", lambda x: x.cast("string"))).alias("id")).unionByName(vuln).distinct()
    typed = seen.join(vuln.distinct().withColumn("v", F.lit(True)), [P, "id"], "left").select(P, "id", F.when(F.col("v"), "vuln").otherwise("transitive").alias("type"))
    roots = blast.select(P, F.lit(ROOT).alias("id"), F.lit("root").alias("type")).distinct()
    return roots.unionByName(typed.filter(F.col("id") != ROOT)), links


def scan_report(counts: DataFrame, ecosystems: DataFrame, summary: DataFrame, blast: DataFrame, paths: DataFrame, clusters: DataFrame, patch: DataFrame, advice: DataFrame) -> DataFrame:
    """One nested row per project: counts, risk, ranked results with their paths, clusters, patch set, advice."""
    walks = paths.groupBy(P, F.col("source").alias("source_node")).agg(F.sort_array(F.collect_list(F.struct("rank", "path", "sink_node", "sink_type", "path_length", "exploit_score", "exploitability"))).alias("attack_paths"))
    results = blast.join(walks, [P, "source_node"], "left").groupBy(P).agg(
        F.sort_array(F.collect_list(F.struct("rank", "source_node", "cve_id", "cvss_score", "reachable_count", "sinks_reachable", "sink_types", "data_sensitivity", "blast_radius_score", "attack_paths"))).alias("blast_radius_results")
    )
    groups = clusters.groupBy(P).agg(F.sort_array(F.collect_list(F.struct("rank", "nodes", "size", "risk_level", "max_cvss_in_cluster", "combined_blast_radius"))).alias("circular_trust_clusters"))
    sets = patch.select(P, F.struct(*[c for c in patch.columns if c != P]).alias("minimum_patch_set"))
    tips = advice.filter(F.col("rank") <= MAX_PATHS).groupBy(P).agg(F.sort_array(F.collect_list(F.struct("rank", "package_name", "cve_ids", "cvss_score", "upgrade_command", "confidence", "attack_path_summary"))).alias("patch_recommendations"))
    rows = counts.join(ecosystems, P, "left").join(summary, P, "left")
    for part in (results, groups, sets, tips):
        rows = rows.join(part, P, "left")
    return rows


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Write reports as JSON lines or Parquet, a file per task."""
    report.write.mode("overwrite").format(fmt).save(path)


def scan_status(cves: DataFrame, bloom: DataFrame) -> DataFrame:
    """One row: vulnerabilities stored, distinct package names, the size and false-positive rate of a filter over them."""
    return cves.agg(F.count(F.lit(1)).alias("cve_rows"), F.count_distinct("cve_id").alias("cves")).crossJoin(bloom.select("n_items", "fp_rate"))
