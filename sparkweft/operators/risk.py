"""Blast radius, circular trust and topological risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLUSTER_HIGH, CLUSTER_LOW, CLUSTER_MEDIUM, CVSS_CRITICAL, CVSS_HIGH, LEVELS
from ..functions.scores import blast_score, sensitivity, sensitivity_multiplier, topo_risk
from ..session import if_small
from .reach import reachable

P = "project_id"


def blast_radius(edges: DataFrame, vuln: DataFrame, sinks: DataFrame, closure: DataFrame | None = None, direction: str = "down") -> DataFrame:
    """Reach and score of each vulnerable node with a score above 0.

    ``vuln``: project_id, name, cvss_score, primary_cve. ``sinks``: node, sink_type. The
    node's own sink type counts for the sensitivity but isn't listed among the sinks it
    reaches. Ranked within the project by score, then name. ``closure`` may bring a
    closure of these nodes that was made before.
    """
    v = vuln.filter("cvss_score > 0").select(P, F.col("name").alias("source_node"), "cvss_score", F.col("primary_cve").alias("cve_id"))
    reach = reachable(edges, v.select(P, F.col("source_node").alias("source")), direction) if closure is None else closure
    types = if_small(sinks.select("node", "sink_type"))
    met = reach.join(types, "node", "left").groupBy(P, F.col("source").alias("source_node")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("sink_type").isNotNull(), F.struct("node", "sink_type")))).alias("s")
    )
    own = types.withColumnRenamed("node", "source_node").withColumnRenamed("sink_type", "own")
    rows = v.join(met, [P, "source_node"], "left").join(own, "source_node", "left")
    listed = F.coalesce(F.array_distinct(F.col("s.sink_type")), F.array().cast("array<string>"))
    level = sensitivity(F.when(F.col("own").isNull(), listed).otherwise(F.array_union(listed, F.array("own"))))
    n = F.coalesce("n", F.lit(0))
    scored = rows.select(
        P, "source_node", "cve_id", "cvss_score", n.alias("reachable_count"), F.coalesce(F.col("s.node"), F.array().cast("array<bigint>") if dict(sinks.dtypes)["node"] == "bigint" else F.array().cast("array<string>")).alias("sinks_reachable"),
        listed.alias("sink_types"), level.alias("data_sensitivity"), sensitivity_multiplier(level).alias("multiplier"),
        blast_score(F.col("cvss_score"), n, sensitivity_multiplier(level)).alias("blast_radius_score"),
    )
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(P).orderBy(F.desc("blast_radius_score"), "source_node")))


def relative_blast(blast: DataFrame) -> DataFrame:
    """Adds ``relative``: the score over the project's largest (0 where that is 0)."""
    top = F.max("blast_radius_score").over(Window.partitionBy(P))
    return blast.withColumn("relative", F.when(top > 0, F.bround(F.col("blast_radius_score") / top, 4)).otherwise(F.lit(0.0)))


def topological_risk(edges: DataFrame, nodes: DataFrame, vuln: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(project_id, name, cvss_score, downstream, topological_risk_score) of the vulnerable nodes."""
    v = vuln.filter("cvss_score > 0").select(P, "name", "cvss_score")
    reach = reachable(edges, v.select(P, F.col("name").alias("source"))) if closure is None else closure
    n = reach.groupBy(P, F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("d"))
    total = nodes.groupBy(P).agg(F.count(F.lit(1)).alias("total"))
    d = F.coalesce("d", F.lit(0))
    return v.join(n, [P, "name"], "left").join(total, P).select(P, "name", "cvss_score", d.alias("downstream"), topo_risk(F.col("cvss_score"), d, F.col("total")).alias("topological_risk_score"))


def trust_clusters(components: DataFrame, vuln: DataFrame, edges: DataFrame) -> DataFrame:
    """Circular-trust clusters: components of two or more nodes, with their risk and what lies downstream."""
    big = components.groupBy(P, "scc_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    members = components.join(big, [P, "scc_id"])
    scored = members.join(vuln.select(P, F.col("name").alias("node"), "cvss_score"), [P, "node"], "left").groupBy(P, "scc_id", "size").agg(
        F.sort_array(F.collect_list("node")).alias("nodes"), F.coalesce(F.max("cvss_score"), F.lit(0.0)).alias("max_cvss_in_cluster")
    )
    # a component's members reach the same nodes, so one of them stands for all
    seeds = big.select(P, F.col("scc_id").alias("source"))
    circular = if_small(big.select(P).distinct())
    edges, components = edges.join(circular, P, "left_semi"), components.join(circular, P, "left_semi")
    outside = reachable(edges, seeds).join(components.select(P, "node", F.col("scc_id").alias("c")), [P, "node"], "left").filter("c IS NULL OR c <> source")
    down = outside.groupBy(P, F.col("source").alias("scc_id")).agg(F.count(F.lit(1)).alias("d"))
    by_size = F.when(F.col("size") <= CLUSTER_LOW, 0).when(F.col("size") <= CLUSTER_MEDIUM, 1).when(F.col("size") <= CLUSTER_HIGH, 2).otherwise(3)
    level = F.when(F.col("max_cvss_in_cluster") >= CVSS_CRITICAL, 3).when(F.col("max_cvss_in_cluster") >= CVSS_HIGH, F.least(F.lit(3), by_size + 1)).otherwise(by_size)
    rows = scored.join(down, [P, "scc_id"], "left").withColumn("level", level).withColumn("combined_blast_radius", F.coalesce("d", F.lit(0)))
    named = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("level") + 1).cast("int"))
    text = F.format_string(
        "%d packages trust each other in a circle: one compromise reaches all %d. Highest CVSS %.1f; %d packages further downstream.",
        F.col("size"), F.col("size"), F.col("max_cvss_in_cluster"), F.col("combined_blast_radius"),
    )
    return rows.select(
        P, "scc_id", "nodes", "size", named.alias("risk_level"), "max_cvss_in_cluster", "combined_blast_radius", text.alias("description"),
        F.row_number().over(Window.partitionBy(P).orderBy(F.desc("level"), F.desc("size"), "scc_id")).alias("rank"),
    )
