"""A whole scan over a portfolio, stage by stage, each stage made once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, match, patchset, reach, report, risk
from ..session import kept
from .bridge import bridge

P = "project_id"


class Portfolio:
    """All stages of the scan: graph, matches, clusters, blast radii, paths, patch sets, reports."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, cves: DataFrame, sinks: DataFrame, max_hops: int | None = None, curated: DataFrame | None = None) -> None:
        self.raw_nodes, self.raw_edges, self.cves, self.sinks, self.max_hops, self.curated = nodes, edges, cves, sinks, max_hops, curated

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, max_hops: int | None = None) -> Portfolio:
        """The scan over the given tables; the nodes come from the edges as they are kept, a project's together."""
        (edges,) = bridge(spark, sf_dir, "edges_p")
        edges = kept(edges.repartition(P))
        nodes, cves, sinks = bridge(spark, sf_dir, "nodes", "cves", "sinks", edges_p=edges)
        scan = cls(nodes, edges, cves, sinks, max_hops=max_hops)
        scan.edges = edges
        return scan

    @cached_property
    def edges(self) -> DataFrame:
        return kept(self.raw_edges)

    @cached_property
    def nodes(self) -> DataFrame:
        return kept(self.raw_nodes)

    @cached_property
    def matches(self) -> DataFrame:
        return match.match_cves(self.nodes, self.cves)

    @cached_property
    def vuln(self) -> DataFrame:
        return kept(match.vulnerable_nodes(self.matches))

    @cached_property
    def closure(self) -> DataFrame:
        return reach.reachable(self.edges, self.vuln.filter("cvss_score > 0").select(P, F.col("name").alias("source")))

    @cached_property
    def components(self) -> DataFrame:
        return kept(graph.scc(self.edges))

    @cached_property
    def clusters(self) -> DataFrame:
        return kept(risk.trust_clusters(self.components, self.vuln, self.edges))

    @cached_property
    def blast(self) -> DataFrame:
        return kept(risk.blast_radius(self.edges, self.vuln, self.sinks, self.closure))

    @cached_property
    def paths(self) -> DataFrame:
        return kept(reach.attack_paths(self.edges, self.blast.filter("size(sink_types) > 0"), self.sinks))

    @cached_property
    def path_rows(self) -> DataFrame:
        """The paths with an id of their own."""
        return self.paths.withColumn("path_id", F.struct("source", "rank"))

    @cached_property
    def patch(self) -> DataFrame:
        return kept(patchset.minimum_patch_set(self.edges, self.blast, self.path_rows, max_hops=self.max_hops))

    @cached_property
    def ecosystems(self) -> DataFrame:
        n = self.nodes.groupBy(P, "ecosystem").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(P).agg(F.max_by("ecosystem", F.struct("n", "ecosystem")).alias("ecosystem"))

    @cached_property
    def summary(self) -> DataFrame:
        return report.risk_summary(self.blast, self.clusters, self.nodes)

    @cached_property
    def advice(self) -> DataFrame:
        fallback = report.fallback_recommendations(self.blast, self.ecosystems, self.paths)
        return report.merge_recommendations(fallback.limit(0) if self.curated is None else self.curated, fallback)

    def report(self) -> DataFrame:
        counts = report.severity_counts(self.nodes, self.vuln)
        return report.scan_report(counts, self.ecosystems, self.summary, self.blast, self.paths, self.clusters, self.patch, self.advice)
