"""Registered queries over the given tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import MAX_PATHS
from .functions import names, scores
from .operators import graph, match, patchset, reach, report, risk
from .plans.bridge import bridge, with_tables
from .plans.portfolio import Portfolio
from .session import cut, kept, shared_folder, table
from .sources import cve_feed, manifests
from .streaming import changes

P = "project_id"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame] | None = None, *, sql: str | None = None):
    """Register a query by its function's name."""
    if f is None:
        return partial(query, sql=sql)
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Pieces of the SQL twins.
# Here a version is three numbers and perhaps a label, which is compared as text; its place is a 0 where there is none.
_KEY = "{{'n': list_transform(string_split(split_part({0}, '-', 1), '.'), lambda t: TRY_CAST(t AS BIGINT)), 'label': CASE WHEN contains({0}, '-') THEN split_part({0}, '-', 2) ELSE '0' END}}"
_LOW = f"(c.version_start = '' OR CASE WHEN c.version_start_incl THEN {_KEY.format('n.version')} >= {_KEY.format('c.version_start')} ELSE {_KEY.format('n.version')} > {_KEY.format('c.version_start')} END)"
_HIGH = f"(c.version_end = '' OR CASE WHEN c.version_end_excl THEN {_KEY.format('n.version')} < {_KEY.format('c.version_end')} ELSE {_KEY.format('n.version')} <= {_KEY.format('c.version_end')} END)"
_MATCH = f"m AS (SELECT n.project_id, n.name, c.cve_id, c.cvss_score FROM nodes n JOIN cves c ON c.package_name = n.name WHERE {_LOW} AND {_HIGH})"
_VULN = _MATCH + ", vuln AS (SELECT project_id, name, max(cvss_score) AS cvss_score, list(cve_id ORDER BY cvss_score DESC, cve_id) AS ids FROM m GROUP BY ALL)"
_REACH = ", reach AS (SELECT v.project_id, v.name AS source, e.dst AS node FROM vuln v JOIN edges_p e ON e.project_id = v.project_id AND e.src = v.name WHERE v.cvss_score > 0 UNION SELECT r.project_id, r.source, e.dst FROM reach r JOIN edges_p e ON e.project_id = r.project_id AND e.src = r.node), far AS (SELECT * FROM reach WHERE node <> source)"
_BLAST = _REACH + (
    ", hit AS (SELECT f.project_id, f.source, count(*) AS n, list(DISTINCT s.sink_type) FILTER (s.sink_type IS NOT NULL) AS types, count(s.node) AS n_sinks FROM far f LEFT JOIN sinks s ON s.node = f.node GROUP BY ALL)"
    ", typed AS (SELECT v.project_id, v.name, v.cvss_score, v.ids[1] AS cve_id, coalesce(h.n, 0) AS n, coalesce(h.n_sinks, 0) AS n_sinks, list_sort(coalesce(h.types, [])) AS types, list_concat(coalesce(h.types, []), CASE WHEN o.sink_type IS NULL THEN [] ELSE [o.sink_type] END) AS all_types "
    "FROM vuln v LEFT JOIN hit h ON h.project_id = v.project_id AND h.source = v.name LEFT JOIN sinks o ON o.node = v.name WHERE v.cvss_score > 0)"
    ", levelled AS (SELECT *, CASE WHEN list_has_any(all_types, ['credential', 'crypto']) THEN 'CRITICAL' WHEN list_has_any(all_types, ['database', 'file_write']) THEN 'HIGH' WHEN list_contains(all_types, 'network') THEN 'MEDIUM' ELSE 'LOW' END AS level FROM typed)"
    ", blast AS (SELECT *, CASE level WHEN 'CRITICAL' THEN 3.0 WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 1.5 ELSE 1.0 END::DOUBLE AS mult FROM levelled)"
    ", scored AS (SELECT *, round_even(cvss_score * log2(1 + n) * mult, 4) AS score FROM blast)"
)
_BAND = "CASE WHEN {0} >= 9 THEN 'CRITICAL' WHEN {0} >= 7 THEN 'HIGH' WHEN {0} >= 4 THEN 'MEDIUM' WHEN {0} > 0 THEN 'LOW' ELSE 'CLEAN' END"


@query(sql=with_tables("nodes", "cves") + f", {_MATCH} SELECT DISTINCT project_id, name, cve_id, cvss_score FROM m")
def version_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    return match.match_cves(cut(nodes), cves)


@query(sql=with_tables("nodes", "cves") + f", {_VULN} SELECT project_id, name, cvss_score, array_to_string(ids, ',') AS cve_ids, ids[1] AS primary_cve FROM vuln")
def vulnerable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    return match.vulnerable_nodes(match.match_cves(cut(nodes), cves)).withColumn("cve_ids", F.array_join("cve_ids", ","))


@query(sql=with_tables("nodes", "cves") + " SELECT project_id, name FROM nodes WHERE name IN (SELECT package_name FROM cves)")
def bloom_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that are a vulnerable package by name; Spark puts its own Bloom filter before the semi-join."""
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    return match.known_packages(nodes, cves).select(P, "name")


@query(sql="SELECT p_brand, n, m, CAST(greatest(1, round_even(m / n * ln(2), 0)) AS BIGINT) AS k FROM (SELECT p_brand, n, CAST(greatest(1, ceil(-n * ln(0.001) / 0.4804530139182014)) AS BIGINT) AS m FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand))")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("m", scores.bloom_bits(F.col("n"), F.lit(0.001))).withColumn("k", scores.bloom_hashes(F.col("n"), F.col("m")))


@query(
    sql=with_tables("cves")
    + ", n AS (SELECT count(*) AS cve_rows, count(DISTINCT cve_id) AS cves, count(DISTINCT package_name) AS n_items FROM cves), m AS (SELECT *, greatest(1, ceil(-greatest(1, n_items) * ln(0.01) / 0.4804530139182014)) AS m FROM n), k AS (SELECT *, greatest(1, round_even(m / greatest(1, n_items) * ln(2), 0)) AS k FROM m)"
    " SELECT cve_rows, cves, n_items, round_even(pow(1 - exp(-k * n_items / m), k), 6) AS fp_rate FROM k"
)
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cves,) = bridge(spark, sf_dir, "cves")
    return report.scan_status(cves, match.bloom_stats(cves))


@query(sql=with_tables("nodes", "cves") + " SELECT n.project_id, n.name, c.cve_id, c.cvss_score FROM nodes n JOIN cves c ON c.package_name = n.name AND (c.ecosystem = n.ecosystem OR c.ecosystem = 'unknown')")
def package_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    packages = nodes.select(P, F.col("name").cast("string").alias("name"), "ecosystem")
    hits = match.lookup_package_cves(packages.select("name", "ecosystem").distinct(), cves.withColumn("package_name", F.col("package_name").cast("string")))
    return packages.join(hits.select("name", "cve_id", "cvss_score"), "name").select(P, F.col("name").cast("bigint").alias("name"), "cve_id", "cvss_score")


# Manifests: texts made from the parts, read by the corpus readers.
def _files(spark: SparkSession, sf_dir: str, name: str, content: str, group: bool = False) -> DataFrame:
    part = table(spark, sf_dir, "part")
    if group:
        rows = part.withColumn("project_id", F.expr("p_partkey div 40")).groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.expr(content).alias("x")))).alias("l"))
        return rows.select(F.col("project_id").cast("string").alias("project_id"), F.lit(f"/x/{name}").alias("manifest_path"), F.array_join(F.col("l.x"), "\n").alias("content"))
    return part.select(F.col("p_partkey").cast("string").alias("project_id"), F.lit(f"/x/{name}").alias("manifest_path"), F.expr(content).alias("content"))


@query(
    sql="SELECT CAST(p_partkey // 40 AS VARCHAR) AS project_id, CASE p_partkey % 5 WHEN 2 THEN concat('pkg_', p_partkey, '_x') ELSE concat('pkg_', p_partkey) END AS name, CASE WHEN p_partkey % 5 = 2 THEN 'unknown' ELSE concat(p_size, '.', p_partkey % 7) END AS version, false AS is_dev FROM part WHERE p_partkey % 5 <> 3"
)
def requirements_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (
        "CASE p_partkey % 5 WHEN 0 THEN concat('Pkg-', p_partkey, '==', p_size, '.', p_partkey % 7) WHEN 1 THEN concat('pkg.', p_partkey, '>=', p_size, '.', p_partkey % 7, ' # why') "
        "WHEN 2 THEN concat('pkg_', p_partkey, '.x') WHEN 3 THEN concat('# pkg ', p_partkey) ELSE concat('PKG_', p_partkey, '[extra] ~= ', p_size, '.', p_partkey % 7) END"
    )
    return manifests.parse_requirements(_files(spark, sf_dir, "requirements.txt", line, True)).select(P, "name", "version", "is_dev")


@query(
    sql="SELECT CAST(p_partkey AS VARCHAR) AS project_id, unnest([concat('@s/lib-', p_partkey), 'repo', 'dev-tool', 'peer']) AS name, unnest([concat(p_size, '.1.0'), 'git', concat(p_size, '.0'), 'unknown']) AS version, unnest([false, false, true, false]) AS is_dev FROM part"
)
def package_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "concat('{\"name\":\"a\",\"dependencies\":{\"@s/lib-', p_partkey, '\":\"^', p_size, '.1.0\",\"near\":\"file:../near\",\"odd\":7,\"repo\":\"git+https://x\"},\"devDependencies\":{\"dev-tool\":\">=', p_size, '.0 <99\"},\"peerDependencies\":{\"peer\":\"^\"}}')"
    return manifests.parse_package_json(_files(spark, sf_dir, "package.json", content)).select(P, "name", "version", "is_dev")


@query(
    sql="SELECT CAST(p_partkey AS VARCHAR) AS project_id, unnest(['top', '@s/low', 'top', '@s/low']) AS name, unnest([concat(p_size, '.0.0'), '1.0.0', '1', '0.9']) AS version, unnest([true, false, false, false]) AS is_direct, unnest(['__root__', NULL, '__root__', 'top']) AS parent FROM part"
)
def package_lock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "concat('{\"lockfileVersion\":3,\"packages\":{\"\":{\"dependencies\":{\"top\":\"^1\"}},\"node_modules/top\":{\"version\":\"', p_size, '.0.0\",\"dependencies\":{\"@s/low\":\"~0.9\"}},\"node_modules/top/node_modules/@s/low\":{\"version\":\"1.0.0\",\"dev\":true}}}')"
    return manifests.parse_package_lock(_files(spark, sf_dir, "package-lock.json", content)).select(P, "name", "version", "is_direct", "parent")


@query(
    sql="SELECT CAST(p_partkey AS VARCHAR) AS project_id, unnest(['top', 'mid', 'low']) AS name, unnest([concat(p_size, '.0'), '2.0', 'unknown']) AS version, unnest([NULL, 'top', 'mid']) AS parent, unnest([false, true, false]) AS is_dev FROM part"
)
def package_lock_v1_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "concat('{\"dependencies\":{\"top\":{\"version\":\"', p_size, '.0\",\"dependencies\":{\"mid\":{\"version\":\"2.0\",\"dev\":true,\"dependencies\":{\"low\":{}}}}}}}')"
    return manifests.parse_package_lock_v1(_files(spark, sf_dir, "package-lock.json", content)).select(P, "name", "version", "parent", "is_dev")


@query(
    sql="SELECT CAST(p_partkey AS VARCHAR) AS project_id, unnest(['a_b', 'tool', 'web', 'extra_one', 'x_y', 'z', 'org.x:core', 'org.x:check']) AS name, unnest([concat(p_size, '.5'), 'unknown', concat(p_size, '.2'), 'unknown', concat(p_size), '3.1', concat(p_size, '.0'), 'unknown']) AS version, unnest([false, true, false, false, false, false, false, true]) AS is_dev FROM part"
)
def toml_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipfile = "concat('[packages]\\na-b = \"==', p_size, '.5\"\\n[dev-packages]\\ntool = \"*\"\\n')"
    project = "concat('[tool.poetry.dependencies]\\npython = \"^3\"\\nweb = {version = \"^', p_size, '.2\"}\\n[tool.poetry.extras]\\ne = [\"extra-one\"]\\n[project]\\ndependencies = [\"x.y>=', p_size, '\"]\\n[project.optional-dependencies]\\no = [\"z ~= 3.1\"]\\n')"
    pom = "concat('<project xmlns=\"http://maven.apache.org/POM/4.0.0\"><profiles><profile><dependencies><dependency><groupId>org.x</groupId><artifactId>core</artifactId><version>', p_size, '.0</version></dependency><dependency><groupId>org.x</groupId><artifactId>check</artifactId><scope>test</scope></dependency></dependencies></profile></profiles></project>')"
    files = [_files(spark, sf_dir, n, c) for n, c in (("Pipfile", pipfile), ("pyproject.toml", project), ("pom.xml", pom))]
    return manifests.load_manifests(files[0].unionByName(files[1]).unionByName(files[2])).select(P, "name", "version", "is_dev")


_FEED = (
    "concat('{\"cve\":{\"CVE_data_meta\":{\"ID\":\"CVE-', p_partkey, '\"},\"description\":{\"description_data\":[{\"lang\":\"fr\",\"value\":\"non\"},{\"lang\":\"en\",\"value\":\"text ', p_size, '\"}]}},\"publishedDate\":\"2024-01-02\",\"impact\":{', CASE WHEN p_partkey % 2 = 0 THEN concat('\"baseMetricV3\":{\"cvssV3\":{\"baseScore\":', p_partkey % 10, ',\"vectorString\":\"AV:L\"}},') ELSE '' END, '\"baseMetricV2\":{\"cvssV2\":{\"baseScore\":', CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE p_partkey % 10 END, ',\"vectorString\":\"AV:N\"}}},"
    "\"configurations\":{\"nodes\":[{\"cpe_match\":[{\"vulnerable\":true,\"cpe23Uri\":\"cpe:2.3:a:apache:lib-', p_partkey, ':*\",\"versionStartIncluding\":\"1.0\",\"versionEndExcluding\":\"', p_size, '.0\"},{\"vulnerable\":false,\"cpe23Uri\":\"cpe:2.3:a:v:no:*\"},{\"vulnerable\":true,\"cpe23Uri\":\"cpe:2.3:o:v:os:*\"}],"
    "\"children\":[{\"cpe_match\":[],\"children\":[{\"children\":[{\"cpe_match\":null,\"children\":[{\"children\":[{\"cpe_match\":[{\"vulnerable\":true,\"cpe23Uri\":\"cpe:2.3:a:nodejs:deep:*\",\"versionEndIncluding\":\"2.0\"},{\"vulnerable\":true,\"cpe23Uri\":\"cpe:2.3:a:nodejs:deep:*\",\"versionEndIncluding\":\"2.0\"}]}]}]}]}]}]}]}}')"
)


@query(
    sql="SELECT concat('CVE-', p_partkey) AS cve_id, unnest([concat('lib_', p_partkey), 'deep']) AS package_name, unnest(['maven', 'npm']) AS ecosystem, unnest(['1.0', '']) AS version_start, unnest([concat(p_size, '.0'), '2.0']) AS version_end, unnest([true, false]) AS version_start_incl, unnest([true, false]) AS version_end_excl, CAST(p_partkey % 10 AS DOUBLE) AS cvss_score, concat('text ', p_size) AS description FROM part"
)
def cve_feed_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.from_json(F.expr(_FEED), cve_feed.ITEM).alias("i")).select("i.*")
    return cve_feed.flatten_cve_items(items).drop("cvss_vector", "published_date")


@query(sql=with_tables("cves") + ", h AS (SELECT *, 0 AS day FROM cves UNION ALL SELECT cve_id, package_name, ecosystem, version_start, '9.9.9', version_start_incl, version_end_excl, cvss_score, 1 FROM cves WHERE package_name % 2 = 0) SELECT cve_id, package_name, version_end, cvss_score FROM (SELECT *, row_number() OVER (PARTITION BY cve_id, package_name ORDER BY day DESC) AS n FROM h) WHERE n = 1")
def cve_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cves,) = bridge(spark, sf_dir, "cves")
    newer = cves.filter("package_name % 2 = 0").withColumn("version_end", F.lit("9.9.9"))
    return cve_feed.upsert_cves(cves, newer).select("cve_id", "package_name", "version_end", "cvss_score")


# Graph building.
@query(sql=with_tables("deps") + " SELECT project_id, name, version FROM (SELECT project_id, name, version, row_number() OVER (PARTITION BY project_id, name ORDER BY list_transform(string_split(version, '.'), lambda t: CAST(t AS BIGINT)) DESC) AS n FROM deps) WHERE n = 1")
def resolve_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (deps,) = bridge(spark, sf_dir, "deps")
    return graph.resolve_nodes(deps).select(P, "name", "version")


@query(sql=with_tables("deps") + " SELECT project_id, ecosystem FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, first) AS k FROM (SELECT project_id, ecosystem, count(*) AS n, min(seq) AS first FROM deps GROUP BY ALL)) WHERE k = 1")
def ecosystem_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.project_ecosystem(*bridge(spark, sf_dir, "deps"))


@query(
    sql=with_tables("deps")
    + ", e AS (SELECT project_id, '__root__' AS src, CAST(name AS VARCHAR) AS dst FROM deps WHERE is_direct AND parent IS NULL UNION SELECT project_id, CAST(parent AS VARCHAR), CAST(name AS VARCHAR) FROM deps WHERE parent IS NOT NULL AND parent <> name), n AS (SELECT project_id, CAST(name AS VARCHAR) AS name FROM deps UNION SELECT project_id, src FROM e) SELECT a.project_id, a.n_nodes, coalesce(b.n_edges, 0) AS n_edges FROM (SELECT project_id, count(*) AS n_nodes FROM n GROUP BY ALL) a LEFT JOIN (SELECT project_id, count(*) AS n_edges FROM e GROUP BY ALL) b USING (project_id)"
)
def graph_nodes_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    (deps,) = bridge(spark, sf_dir, "deps")
    return graph.sizes(graph.build_graph(deps.withColumn("name", F.col("name").cast("string")).withColumn("parent", F.col("parent").cast("string"))))


@query(sql=with_tables("edges_p") + " SELECT project_id, name, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT project_id, dst AS name, 1 AS i, 0 AS o FROM edges_p UNION ALL SELECT project_id, src, 0, 1 FROM edges_p) GROUP BY ALL")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*bridge(spark, sf_dir, "edges_p"))


# Reachability.
_ALL = with_tables("edges_p", "nodes", "cves", "sinks")


@query(sql=_ALL + f", {_VULN}{_REACH} SELECT project_id, source, count(*) AS downstream FROM far GROUP BY ALL")
def descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Portfolio.of(spark, sf_dir).closure.groupBy(P, "source").agg(F.count(F.lit(1)).alias("downstream"))


@query(
    sql=with_tables("edges_p", "sinks")
    + ", up AS (SELECT DISTINCT e.project_id, s.node AS source, e.src AS node FROM edges_p e JOIN sinks s ON s.node = e.dst UNION SELECT u.project_id, u.source, e.src FROM up u JOIN edges_p e ON e.project_id = u.project_id AND e.dst = u.node) SELECT project_id, source, count(*) AS upstream FROM up WHERE node <> source GROUP BY ALL"
)
def ancestor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sinks = bridge(spark, sf_dir, "edges_p", "sinks")
    edges = cut(edges)
    seeds = edges.join(sinks.select(F.col("node").alias("dst")), "dst", "left_semi").select(P, F.col("dst").alias("source")).distinct()
    return reach.reachable(edges, seeds, "up").groupBy(P, "source").agg(F.count(F.lit(1)).alias("upstream"))


@query(sql=_ALL + f", {_VULN}{_BLAST}, t AS (SELECT project_id, count(*) AS total FROM nodes GROUP BY ALL) SELECT s.project_id, s.name, s.cvss_score, s.n AS downstream, round_even(s.cvss_score * (1 + CASE WHEN t.total <= 1 THEN 0 ELSE ln(1 + s.n) / ln(t.total) END), 4) AS topological_risk_score FROM scored s JOIN t USING (project_id)")
def topo_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio.of(spark, sf_dir)
    return risk.topological_risk(p.edges, p.nodes, p.vuln, p.closure)


@query(
    sql=_ALL + f", {_VULN}{_BLAST} SELECT project_id, name AS source_node, cve_id, cvss_score, n AS reachable_count, n_sinks, array_to_string(types, ',') AS sink_types, level AS data_sensitivity, score AS blast_radius_score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, name) AS rank, CASE WHEN max(score) OVER (PARTITION BY project_id) > 0 THEN round_even(score / max(score) OVER (PARTITION BY project_id), 4) ELSE 0 END AS relative FROM scored"
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.relative_blast(Portfolio.of(spark, sf_dir).blast)
    return rows.select(P, "source_node", "cve_id", "cvss_score", "reachable_count", F.size("sinks_reachable").alias("n_sinks"), F.array_join(F.sort_array("sink_types"), ",").alias("sink_types"), "data_sensitivity", "blast_radius_score", "rank", "relative")


_PATHS = (
    ", walk AS (SELECT b.project_id, b.name AS source, b.cvss_score, b.mult, b.name AS node, [b.name] AS path, NULL::VARCHAR AS sink_type FROM scored b WHERE len(b.types) > 0 "
    "UNION ALL SELECT w.project_id, w.source, w.cvss_score, w.mult, e.dst, list_append(w.path, e.dst), s.sink_type FROM walk w JOIN edges_p e ON e.project_id = w.project_id AND e.src = w.node LEFT JOIN sinks s ON s.node = e.dst WHERE w.sink_type IS NULL AND len(w.path) < 10)"
    ", ended AS (SELECT *, len(path) AS path_length, round_even(cvss_score / len(path) * mult, 4) AS exploit_score FROM walk WHERE sink_type IS NOT NULL)"
    f", ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, source ORDER BY exploit_score DESC, path_length, path) AS rank FROM ended), best AS (SELECT * FROM ranked WHERE rank <= {MAX_PATHS})"
)


@query(
    sql=_ALL + f", {_VULN}{_BLAST}{_PATHS}, o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY exploit_score DESC, path_length, path) AS overall FROM best) SELECT o.project_id, source, array_to_string(path, '>') AS path, sink_type, path_length, exploit_score, CASE WHEN EXISTS (SELECT 1 FROM edges_p e WHERE e.project_id = o.project_id AND e.dst = o.source) THEN 'LOCAL' ELSE 'NETWORK' END AS exploitability, rank, overall <= 8 AS in_top FROM o"
)
def attack_paths_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = Portfolio.of(spark, sf_dir).paths
    top = report.top_paths(paths).select(P, "source", "rank", F.lit(True).alias("in_top"))
    return paths.join(top, [P, "source", "rank"], "left").select(P, "source", F.array_join("path", ">").alias("path"), "sink_type", "path_length", "exploit_score", "exploitability", "rank", F.coalesce("in_top", F.lit(False)).alias("in_top"))


# Structure.
def _closure(edges: str) -> str:
    return f", cl AS (SELECT project_id, src, dst FROM {edges} UNION SELECT c.project_id, c.src, e.dst FROM cl c JOIN {edges} e ON e.project_id = c.project_id AND e.src = c.dst)"


def _scc(edges: str) -> str:
    return _closure(edges) + f", nd AS (SELECT project_id, src AS node FROM {edges} UNION SELECT project_id, dst FROM {edges}), comp AS (SELECT n.project_id, n.node, least(n.node, coalesce(min(a.dst), n.node)) AS scc_id FROM nd n LEFT JOIN (SELECT a.project_id, a.src, a.dst FROM cl a JOIN cl b ON a.project_id = b.project_id AND a.src = b.dst AND a.dst = b.src) a ON a.project_id = n.project_id AND a.src = n.node GROUP BY n.project_id, n.node)"


@query(sql=with_tables("edges_c") + _scc("edges_c") + " SELECT project_id, node, scc_id FROM comp")
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scc(cut(*bridge(spark, sf_dir, "edges_c")))


_CLUSTERS = (
    ", big AS (SELECT project_id, scc_id, count(*) AS size FROM comp GROUP BY ALL HAVING count(*) >= 2), mx AS (SELECT b.project_id, b.scc_id, b.size, coalesce(max(v.cvss_score), 0) AS max_cvss FROM big b JOIN comp c USING (project_id, scc_id) LEFT JOIN vuln v ON v.project_id = c.project_id AND v.name = c.node GROUP BY ALL)"
    ", dn AS (SELECT b.project_id, b.scc_id, count(*) AS d FROM big b JOIN cl ON cl.project_id = b.project_id AND cl.src = b.scc_id JOIN comp c ON c.project_id = cl.project_id AND c.node = cl.dst WHERE c.scc_id <> b.scc_id GROUP BY ALL)"
    ", lv AS (SELECT m.*, coalesce(d.d, 0) AS combined_blast_radius, CASE WHEN max_cvss >= 9 THEN 3 WHEN max_cvss >= 7 THEN least(3, 1 + CASE WHEN size <= 2 THEN 0 WHEN size <= 5 THEN 1 WHEN size <= 10 THEN 2 ELSE 3 END) WHEN size <= 2 THEN 0 WHEN size <= 5 THEN 1 WHEN size <= 10 THEN 2 ELSE 3 END AS level FROM mx m LEFT JOIN dn d USING (project_id, scc_id))"
)


@query(sql=_ALL + f", {_VULN}" + _scc("edges_p") + _CLUSTERS + " SELECT project_id, scc_id, size, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][level + 1] AS risk_level, max_cvss AS max_cvss_in_cluster, combined_blast_radius, row_number() OVER (PARTITION BY project_id ORDER BY level DESC, size DESC, scc_id) AS rank FROM lv")
def trust_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Portfolio.of(spark, sf_dir).clusters.select(P, "scc_id", "size", "risk_level", "max_cvss_in_cluster", "combined_blast_radius", "rank")


@query(sql=with_tables("edges_p") + _scc("edges_p") + ", dg AS (SELECT project_id, dst AS node, count(*) AS d FROM edges_p GROUP BY ALL) SELECT e.project_id, e.src, e.dst FROM edges_p e JOIN comp a ON a.project_id = e.project_id AND a.node = e.src JOIN comp b ON b.project_id = e.project_id AND b.node = e.dst LEFT JOIN dg x ON x.project_id = e.project_id AND x.node = e.src LEFT JOIN dg y ON y.project_id = e.project_id AND y.node = e.dst WHERE a.scc_id <> b.scc_id OR coalesce(x.d, 0) > coalesce(y.d, 0) OR (coalesce(x.d, 0) = coalesce(y.d, 0) AND e.src < e.dst)")
def break_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(*bridge(spark, sf_dir, "edges_p"))
    return graph.break_cycles(edges, graph.scc(edges))


# Patch sets.
_TERMS = ", hits AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, name) AS rank, count(*) FILTER (score > 5) OVER (PARTITION BY project_id) AS over FROM scored), terms AS (SELECT project_id, name AS node FROM hits WHERE score > 5 OR (over = 0 AND rank <= 5))"
_DIST = (
    ", und AS (SELECT project_id, src AS a, dst AS b FROM edges_p UNION SELECT project_id, dst, src FROM edges_p)"
    ", bfs(project_id, u, node, d) USING KEY (project_id, u, node) AS (SELECT project_id, node, node, 0 FROM terms UNION SELECT b.project_id, b.u, n.b, min(b.d) + 1 FROM bfs b JOIN und n ON n.project_id = b.project_id AND n.a = b.node LEFT JOIN recurring.bfs r ON r.project_id = b.project_id AND r.u = b.u AND r.node = n.b WHERE r.d IS NULL GROUP BY b.project_id, b.u, n.b)"
    ", dist AS (SELECT project_id, u, node, d FROM bfs)"
    ", clo AS (SELECT x.project_id, x.node AS u, y.node AS v, coalesce(d.d, 1000) AS weight FROM terms x JOIN terms y ON x.project_id = y.project_id AND x.node < y.node LEFT JOIN dist d ON d.project_id = x.project_id AND d.u = x.node AND d.node = y.node)"
)


@query(sql=_ALL + f", {_VULN}{_BLAST}{_TERMS} SELECT project_id, node FROM terms")
def patch_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patchset.terminals(Portfolio.of(spark, sf_dir).blast)


@query(sql=_ALL + f", {_VULN}{_BLAST}{_TERMS}{_DIST} SELECT project_id, u, v, weight FROM clo")
def metric_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio.of(spark, sf_dir)
    return reach.metric_closure(p.edges, patchset.terminals(p.blast)).select(P, "u", "v", "weight")


@query(
    sql=_ALL + f", {_VULN}{_BLAST}{_TERMS}{_DIST}, numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY weight, u, v) AS k FROM clo), both_ways AS (SELECT project_id, u AS a, v AS b, k FROM numbered UNION ALL SELECT project_id, v, u, k FROM numbered)"
    ", mm AS (SELECT project_id, u, v, weight, k FROM numbered) SELECT m.project_id, m.u, m.v, m.weight FROM mm m WHERE NOT EXISTS (WITH RECURSIVE r AS (SELECT m.u AS n UNION SELECT w.b FROM r JOIN both_ways w ON w.project_id = m.project_id AND w.a = r.n AND w.k < m.k) SELECT 1 FROM r WHERE r.n = m.v)"
)
def closure_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio.of(spark, sf_dir)
    return reach.terminal_tree(p.edges, patchset.terminals(p.blast)).select(P, "u", "v", "weight")


_CANDIDATES = (
    ", und AS (SELECT project_id, src AS a, dst AS b FROM edges_p UNION SELECT project_id, dst, src FROM edges_p)"
    ", bfs(project_id, u, node, d, path) USING KEY (project_id, u, node) AS (SELECT project_id, node, node, 0, [node] FROM terms UNION SELECT b.project_id, b.u, n.b, min(b.d) + 1, min(list_append(b.path, n.b)) FROM bfs b JOIN und n ON n.project_id = b.project_id AND n.a = b.node LEFT JOIN recurring.bfs r ON r.project_id = b.project_id AND r.u = b.u AND r.node = n.b WHERE r.d IS NULL GROUP BY b.project_id, b.u, n.b)"
    ", clo AS (SELECT x.project_id, x.node AS u, y.node AS v, coalesce(d.d, 1000) AS weight, d.path FROM terms x JOIN terms y ON x.project_id = y.project_id AND x.node < y.node LEFT JOIN bfs d ON d.project_id = x.project_id AND d.u = x.node AND d.node = y.node)"
    ", numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY weight, u, v) AS k FROM clo), both_ways AS (SELECT project_id, u AS a, v AS b, k FROM numbered UNION ALL SELECT project_id, v, u, k FROM numbered)"
    ", tree AS (SELECT m.project_id, m.path FROM numbered m WHERE NOT EXISTS (WITH RECURSIVE r AS (SELECT m.u AS n UNION SELECT w.b FROM r JOIN both_ways w ON w.project_id = m.project_id AND w.a = r.n AND w.k < m.k) SELECT 1 FROM r WHERE r.n = m.v))"
    ", cand AS (SELECT project_id, node FROM terms UNION SELECT project_id, unnest(path) FROM tree WHERE path IS NOT NULL)"
)


@query(
    sql=_ALL + f", {_VULN}{_BLAST}{_PATHS}{_TERMS}{_CANDIDATES}"
    ", nn AS (SELECT DISTINCT project_id, source, rank, unnest(path) AS package FROM best), onp AS (SELECT n.* FROM nn n JOIN cand t ON t.project_id = n.project_id AND t.node = n.package), cv AS (SELECT project_id, package, count(*) AS covered FROM onp GROUP BY ALL)"
    ", first AS (SELECT o.project_id, o.source, o.rank, arg_min(o.package, (-c.covered, o.package)) AS package FROM onp o JOIN cv c USING (project_id, package) GROUP BY ALL), full_ AS (SELECT project_id FROM (SELECT DISTINCT project_id, source, rank FROM nn) n LEFT JOIN first f USING (project_id, source, rank) GROUP BY project_id HAVING count(*) = count(f.package))"
    ", kept AS (SELECT DISTINCT project_id, package FROM first UNION SELECT project_id, node FROM terms WHERE project_id NOT IN (SELECT project_id FROM full_)) SELECT k.project_id, k.package, coalesce(c.covered, 0) AS covered FROM kept k LEFT JOIN cv c USING (project_id, package)"
)
def patch_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cover with the terminals and the packages between them as candidates."""
    p = Portfolio.of(spark, sf_dir)
    ends = cut(patchset.terminals(p.blast))
    return patchset.path_cover(kept(patchset.patch_candidates(reach.terminal_tree(p.edges, ends), ends)), p.path_rows, ends)


_ACYCLIC = (
    ", dg AS (SELECT project_id, dst AS node, count(*) AS d FROM edges_p GROUP BY ALL), ac AS (SELECT e.project_id, e.src, e.dst FROM edges_p e JOIN comp a ON a.project_id = e.project_id AND a.node = e.src JOIN comp b ON b.project_id = e.project_id AND b.node = e.dst LEFT JOIN dg x ON x.project_id = e.project_id AND x.node = e.src LEFT JOIN dg y ON y.project_id = e.project_id AND y.node = e.dst "
    "WHERE a.scc_id <> b.scc_id OR coalesce(x.d, 0) > coalesce(y.d, 0) OR (coalesce(x.d, 0) = coalesce(y.d, 0) AND e.src < e.dst))"
)


@query(
    sql=with_tables("edges_p") + _scc("edges_p") + _ACYCLIC
    + ", lv AS (SELECT project_id, src AS node, 0 AS level FROM ac UNION SELECT l.project_id, e.dst, l.level + 1 FROM lv l JOIN ac e ON e.project_id = l.project_id AND e.src = l.node), mx AS (SELECT project_id, node, max(level) AS level FROM lv GROUP BY ALL) SELECT project_id, node, level, row_number() OVER (PARTITION BY project_id ORDER BY level, node) - 1 AS rank FROM mx"
)
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of all projects' graphs, cycles broken."""
    edges = cut(*bridge(spark, sf_dir, "edges_p"))
    return graph.topological_levels(graph.break_cycles(edges, graph.scc(edges)))


@query(
    sql=with_tables("edges_p") + _scc("edges_p")
    + ", ins AS (SELECT e.project_id, a.scc_id, e.src, e.dst FROM edges_p e JOIN comp a ON a.project_id = e.project_id AND a.node = e.src JOIN comp b ON b.project_id = e.project_id AND b.node = e.dst WHERE a.scc_id = b.scc_id)"
    ", bfs(project_id, scc_id, node, path) USING KEY (project_id, scc_id, node) AS (SELECT project_id, scc_id, dst, [src, dst] FROM ins WHERE src = scc_id UNION SELECT b.project_id, b.scc_id, i.dst, min(list_append(b.path, i.dst)) FROM bfs b JOIN ins i ON i.project_id = b.project_id AND i.scc_id = b.scc_id AND i.src = b.node LEFT JOIN recurring.bfs r ON r.project_id = b.project_id AND r.scc_id = b.scc_id AND r.node = i.dst WHERE r.path IS NULL AND b.node <> b.scc_id GROUP BY b.project_id, b.scc_id, i.dst)"
    " SELECT project_id, scc_id, array_to_string(path, '>') AS cycle, len(path) - 1 AS length FROM bfs WHERE node = scc_id"
)
def cycle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest cycle through the smallest member of each circular component."""
    edges = cut(*bridge(spark, sf_dir, "edges_p"))
    return graph.witness_cycles(edges, graph.scc(edges)).select(P, "scc_id", F.array_join("cycle", ">").alias("cycle"), (F.size("cycle") - 1).cast("bigint").alias("length"))


@query(
    sql=with_tables("edges_p", "nodes") + _scc("edges_p") + _ACYCLIC
    + ", ways AS (SELECT project_id, src AS node, 0 AS level FROM ac UNION SELECT l.project_id, e.dst, l.level + 1 FROM ways l JOIN ac e ON e.project_id = l.project_id AND e.src = l.node), mx AS (SELECT project_id, node, max(level) AS level FROM ways GROUP BY ALL) SELECT n.project_id, n.name AS package, row_number() OVER (PARTITION BY n.project_id ORDER BY coalesce(m.level, 0), n.name) - 1 AS update_rank FROM nodes n LEFT JOIN mx m ON m.project_id = n.project_id AND m.node = n.name"
)
def update_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of all packages of each project, by all edges, cycles broken."""
    edges, nodes = bridge(spark, sf_dir, "edges_p", "nodes")
    return patchset.update_order(cut(edges), cut(nodes.select(P, F.col("name").alias("package"))))


@query
def minimum_patch_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Portfolio.of(spark, sf_dir).patch


# Reports.
@query(
    sql=with_tables("nodes", "cves") + f", {_VULN}, b AS (SELECT n.project_id, n.name, coalesce(v.cvss_score, 0) AS s FROM nodes n LEFT JOIN vuln v ON v.project_id = n.project_id AND v.name = n.name) SELECT project_id, count(*) AS total, count(*) FILTER (s > 0) AS vulnerable, count(*) FILTER (s <= 0) AS clean, count(*) FILTER (s >= 9) AS critical, count(*) FILTER (s >= 7 AND s < 9) AS high, count(*) FILTER (s >= 4 AND s < 7) AS medium, count(*) FILTER (s > 0 AND s < 4) AS low FROM b GROUP BY ALL"
)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    nodes = cut(nodes)
    return report.severity_counts(nodes, match.vulnerable_nodes(match.match_cves(nodes, cves)))


@query(sql=with_tables("nodes", "cves") + f", {_VULN}, b AS (SELECT n.project_id, n.ecosystem, {_BAND.format('coalesce(v.cvss_score, 0)')} AS severity FROM nodes n LEFT JOIN vuln v ON v.project_id = n.project_id AND v.name = n.name) SELECT ecosystem, severity, count(*) AS packages, count(DISTINCT project_id) AS projects FROM b GROUP BY ROLLUP (ecosystem, severity)")
def portfolio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    nodes = cut(nodes)
    return report.portfolio_rollup(match.vulnerable_nodes(match.match_cves(nodes, cves)), nodes)


_RISK = _CLUSTERS + f", rs AS (SELECT n.project_id, CASE WHEN coalesce(bool_or(l.level = 3), false) THEN 'CRITICAL' ELSE {_BAND.format('coalesce(max(v.cvss_score), 0)')} END AS risk FROM (SELECT DISTINCT project_id FROM nodes) n LEFT JOIN vuln v USING (project_id) LEFT JOIN lv l USING (project_id) GROUP BY n.project_id)"


@query(sql=_ALL + f", {_VULN}" + _scc("edges_p") + _RISK + " SELECT project_id, risk FROM rs")
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Portfolio.of(spark, sf_dir).summary


@query(sql=_ALL + f", {_VULN}" + _scc("edges_p") + _RISK + " SELECT project_id, risk, CASE risk WHEN 'CRITICAL' THEN 4 ELSE 3 END AS rank FROM rs WHERE risk IN ('HIGH', 'CRITICAL')")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ci_gate(Portfolio.of(spark, sf_dir).summary, "HIGH")


@query(
    sql=with_tables("snapshots")
    + ", a AS (SELECT DISTINCT project_id, name, version FROM snapshots WHERE side = 'old'), b AS (SELECT DISTINCT project_id, name, version FROM snapshots WHERE side = 'new') SELECT project_id, 'added' AS change_type, name, NULL AS old_version, version AS new_version FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT project_id, 'removed', name, version, NULL FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT a.project_id, 'version_changed', a.name, a.version, b.version FROM a JOIN b ON a.project_id = b.project_id AND a.name = b.name AND a.version <> b.version"
)
def dependency_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = bridge(spark, sf_dir, "snapshots")
    return match.dependency_diff(s.filter("side = 'old'"), s.filter("side = 'new'"))


@query(
    sql=_ALL + f", {_VULN}{_BLAST}, ec AS (SELECT project_id, arg_max(ecosystem, (n, ecosystem)) AS ecosystem FROM (SELECT project_id, ecosystem, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY ALL), r AS (SELECT s.*, ec.ecosystem, CASE WHEN name % 5 = 0 OR cvss_score >= 9 THEN 'HIGH' WHEN cvss_score >= 7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM scored s JOIN ec USING (project_id))"
    ", k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, cvss_score DESC, name) AS rank FROM r) SELECT project_id, name AS package_name, cvss_score, confidence, CASE WHEN name % 5 = 0 THEN 'as reviewed' WHEN ecosystem = 'npm' THEN concat('npm install ', name, '@latest') WHEN ecosystem = 'pip' THEN concat('pip install --upgrade ', name) ELSE concat('mvn versions:use-latest-releases -Dincludes=', name) END AS upgrade_command, score AS blast_radius_score, rank FROM k WHERE rank <= 10"
)
def fallback_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback advice for all vulnerable packages, merged with reviewed advice for every fifth."""
    p = Portfolio.of(spark, sf_dir)
    rows = report.fallback_recommendations(p.blast, p.ecosystems)
    reviewed = rows.filter("package_name % 5 = 0").withColumn("confidence", F.lit("HIGH")).withColumn("upgrade_command", F.lit("as reviewed"))
    return report.merge_recommendations(reviewed, rows).select(P, "package_name", "cvss_score", "confidence", "upgrade_command", "blast_radius_score", "rank")


@query(
    sql=_ALL + f", {_VULN}{_BLAST}{_PATHS}, st AS (SELECT DISTINCT project_id, CAST(path[i] AS VARCHAR) AS source, CAST(path[i + 1] AS VARCHAR) AS target FROM (SELECT project_id, path, unnest(range(1, len(path))) AS i FROM best)) SELECT project_id, 'link' AS kind, source AS a, target AS b FROM st UNION SELECT project_id, 'link', '__root__', CAST(name AS VARCHAR) FROM scored UNION SELECT project_id, 'node', '__root__', 'root' FROM scored UNION SELECT project_id, 'node', CAST(name AS VARCHAR), 'vuln' FROM scored UNION SELECT b.project_id, 'node', CAST(b.n AS VARCHAR), 'transitive' FROM (SELECT project_id, unnest(path) AS n FROM best) b WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.project_id = b.project_id AND s.name = b.n)"
)
def report_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio.of(spark, sf_dir)
    nodes, links = report.attack_subgraph(p.blast, p.paths)
    return links.select(P, F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")).unionByName(nodes.select(P, F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b")))


@query
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Portfolio.of(spark, sf_dir).report()


@query(sql="SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.3 WHEN 2 THEN least(1, p_size / 20) ELSE 0 END::DOUBLE AS confidence, CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat('a', p_size, '|b') END AS breaking, CASE WHEN p_partkey % 2 = 0 THEN concat('{\"k\": ', p_size, '}') END AS found FROM part")
def advice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, breaking changes and the JSON object of free-text advice."""
    said = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' high' WHEN 1 THEN 'LOW' WHEN 2 THEN cast(p_size / 20D AS string) ELSE 'sure' END")
    changes_ = F.expr("CASE p_partkey % 3 WHEN 0 THEN ' ; ' ELSE concat('a', p_size, ' ;, b') END")
    text = F.expr("CASE p_partkey % 2 WHEN 0 THEN concat('Here: ```json\\n{\"k\": ', p_size, '}\\n``` so') ELSE '{\"no\": 1}' END")
    return table(spark, sf_dir, "part").select("p_partkey", scores.normalise_confidence(said).alias("confidence"), F.array_join(scores.split_breaking_changes(changes_), "|").alias("breaking"), scores.extract_json_object(text, ("k",)).alias("found"))


@query(sql=with_tables("nodes", "cves") + f", {_MATCH} SELECT DISTINCT project_id, name, cve_id, cvss_score, {_BAND.format('cvss_score')} AS severity FROM m WHERE cvss_score >= 9")
def cve_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    return changes.cve_alerts(cves.withColumn("seen_at", F.current_timestamp()), nodes, "CRITICAL").drop("seen_at")


@query(
    sql="WITH s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS project_id, date_trunc('week', ts) AS taken_at, event_type AS name, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS version FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL), t AS (SELECT project_id, taken_at, lead(taken_at) OVER (PARTITION BY project_id ORDER BY taken_at) AS next_at FROM (SELECT DISTINCT project_id, taken_at FROM s)), o AS (SELECT s.project_id, t.next_at AS taken_at, s.name, s.version FROM s JOIN t USING (project_id, taken_at) WHERE t.next_at IS NOT NULL), n AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM t WHERE t.project_id = s.project_id AND t.next_at = s.taken_at))"
    " SELECT project_id, 'added' AS change_type, name, NULL AS old_version, version AS new_version FROM (SELECT project_id, taken_at, name, version FROM n EXCEPT SELECT project_id, taken_at, name, version FROM o) UNION ALL SELECT project_id, 'removed', name, version, NULL FROM (SELECT project_id, taken_at, name, version FROM o EXCEPT SELECT project_id, taken_at, name, version FROM n) UNION ALL SELECT o.project_id, 'version_changed', o.name, o.version, n.version FROM o JOIN n ON o.project_id = n.project_id AND o.taken_at = n.taken_at AND o.name = n.name AND o.version <> n.version"
)
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly snapshots from the events, in files by time that cut snapshots apart, read as a stream of a file a micro-batch; the changes it wrote."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(P), F.date_trunc("week", "ts").cast("timestamp").alias("taken_at"), F.col("event_type").alias("name"), F.floor(F.col("value") / 20).cast("bigint").cast("string").alias("version"), "ts")
    run = _folder(spark)
    cuts = rows.select(F.percentile_approx("ts", [0.2, 0.4, 0.6, 0.8]).alias("c")).first()["c"] or []
    for i in range(len(cuts) + 1):
        part = rows.filter((F.col("ts") >= F.lit(cuts[i - 1]) if i else F.lit(True)) & (F.col("ts") < F.lit(cuts[i]) if i < len(cuts) else F.lit(True)))
        part.drop("ts").coalesce(1).write.mode("append").parquet(f"{run}/in")
    # a row of no other project, a week later, closes the last snapshots
    rows.agg(F.lit("").alias(P), (F.max("taken_at") + F.expr("INTERVAL 7 DAYS")).alias("taken_at"), F.lit("end").alias("name"), F.lit("").alias("version")).coalesce(1).write.mode("append").parquet(f"{run}/in")
    stream = spark.readStream.schema(changes.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")
    changes.dependency_change_stream(stream, f"{run}/out", f"{run}/log", "0 seconds").awaitTermination()
    return spark.read.schema(changes.CHANGE).parquet(f"{run}/out").select(P, "change_type", "name", "old_version", "new_version")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/run-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def _entries(spark: SparkSession, sf_dir: str, run: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the vulnerabilities as a stream of files."""
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    rows = cves.withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(f"{run}/in")
    return nodes, spark.readStream.schema(rows.schema).parquet(f"{run}/in")


@query(sql=with_tables("nodes", "cves") + f", {_MATCH} SELECT DISTINCT project_id, name, cve_id, cvss_score, {_BAND.format('cvss_score')} AS severity FROM m WHERE cvss_score >= 7")
def cve_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of a stream of vulnerabilities, run to its end; what it wrote."""
    run = _folder(spark)
    nodes, stream = _entries(spark, sf_dir, run)
    alerts = changes.cve_alerts(stream, nodes, "HIGH").drop("seen_at")
    alerts.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).parquet(f"{run}/out")


@query(sql=with_tables("nodes", "cves") + f", {_MATCH} SELECT DISTINCT project_id, name, cve_id, cvss_score, {_BAND.format('cvss_score')} AS severity FROM m WHERE cvss_score >= 7")
def cve_alerts_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of two streams, of vulnerabilities and of packages, that come in turns; every pair is met, whichever came first."""
    run = _folder(spark)
    nodes, cves = bridge(spark, sf_dir, "nodes", "cves")
    nodes, cves = nodes.withColumn("added_at", F.lit("2024-01-01").cast("timestamp")), cves.withColumn("seen_at", F.lit("2024-01-02").cast("timestamp"))
    for k in (0, 1):
        nodes.filter((F.col(P) + F.col("name")) % 2 == k).coalesce(1).write.mode("append").parquet(f"{run}/nodes")
        cves.filter(F.col("package_name") % 2 == k).coalesce(1).write.mode("append").parquet(f"{run}/cves")
    read = lambda df, what: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/{what}")
    alerts = changes.alerts_both_ways(read(cves, "cves"), read(nodes, "nodes")).select(P, "name", "cve_id", "cvss_score", "severity")
    alerts.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).parquet(f"{run}/out")


@query(
    sql=with_tables("cves")
    + ", h AS (SELECT c.*, k FROM cves c CROSS JOIN (VALUES (0), (1), (2)) AS t(k) WHERE k = 0 OR c.package_name % (k + 1) = 0) SELECT cve_id, package_name, version_start, CASE k WHEN 0 THEN version_end ELSE concat(k, '.9.9') END AS version_end, cvss_score FROM h QUALIFY k = max(k) OVER (PARTITION BY cve_id)"
)
def cve_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a stream of vulnerabilities keeps up to date: three batches, the later ones replace what came before; compacted on the way."""
    run = _folder(spark)
    (cves,) = bridge(spark, sf_dir, "cves")
    rows = cves.withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{run}/in")
    for k in (1, 2):
        rows.filter(F.col("package_name") % (k + 1) == 0).withColumn("version_end", F.lit(f"{k}.9.9")).coalesce(1).write.mode("append").parquet(f"{run}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")
    changes.cve_upsert_stream(stream, f"{run}/cves", f"{run}/log", 2).awaitTermination()
    return changes.current_cves(spark, f"{run}/cves").select("cve_id", "package_name", "version_start", "version_end", "cvss_score")


@query(sql="SELECT concat('CVE-', p_partkey) AS cve_id, concat('lib_', p_partkey) AS package_name, concat(p_size, '.0') AS version_end, CAST(p_partkey % 10 AS DOUBLE) AS cvss_score FROM part UNION ALL SELECT concat('CVE-', p_partkey), 'deep', '2.0', CAST(p_partkey % 10 AS DOUBLE) FROM part")
def cve_feed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files made from the parts, planned, read and stored feed by feed."""
    run = _folder(spark)
    items = table(spark, sf_dir, "part").select(F.expr(_FEED).alias("item"), (F.col("p_partkey") % 3 + 2021).cast("string").alias("year"))
    for year in ("2021", "2022", "2023"):
        files = items.filter(F.col("year") == year).groupBy(F.spark_partition_id()).agg(F.concat(F.lit('{"CVE_Items":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value"))
        files.select("value").write.option("maxRecordsPerFile", 1).text(f"{run}/feeds/{year}")  # a feed is one JSON document a file
    feeds = spark.createDataFrame([(y, f"{run}/feeds/{y}") for y in ("2021", "2022", "2023", "modified")], "feed string, path string")
    state = spark.createDataFrame([], "feed string, last_modified timestamp")
    plan = cve_feed.refresh_plan(state, feeds, "2024-06-02 00:00:00")
    cve_feed.ingest_feeds(spark, plan, lambda entries: entries.write.mode("append").parquet(f"{run}/cves"), "2024-06-02 00:00:00")
    return spark.read.parquet(f"{run}/cves").select("cve_id", "package_name", "version_end", "cvss_score")


_FED = "SELECT concat('CVE-', p_partkey) AS cve_id, concat('lib_', p_partkey) AS package_name, concat(p_size, '.0') AS version_end, CAST(p_partkey % 10 AS DOUBLE) AS cvss_score, NULL AS error FROM part UNION ALL SELECT concat('CVE-', p_partkey), 'deep', '2.0', CAST(p_partkey % 10 AS DOUBLE), NULL FROM part"


@query(sql=_FED + " UNION ALL SELECT NULL, NULL, NULL, NULL, 'malformed JSON' FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def cve_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files made from the parts, one of them broken off, read as a stream of two files a micro-batch; entries and errors.

    A file holds one JSON document of at most 20,000 items, however many parts there are.
    """
    run = _folder(spark)
    items = table(spark, sf_dir, "part").select(F.expr(_FEED).alias("item"), F.expr("p_partkey div 100000").alias("range"), (F.col("p_partkey") % 5).alias("k"))
    whole = items.groupBy("range", "k").agg(F.concat(F.lit('{"CVE_Items":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value")).select("value")
    broken = table(spark, sf_dir, "part").orderBy("p_partkey").limit(1).select(F.concat(F.lit('{"CVE_Items":['), F.expr(_FEED)).alias("value"))
    whole.write.option("maxRecordsPerFile", 1).text(f"{run}/feeds")
    broken.write.mode("append").text(f"{run}/feeds")
    cve_feed.feed_stream(spark, f"{run}/feeds", f"{run}/out", f"{run}/log", 2).awaitTermination()
    entries = spark.read.parquet(f"{run}/out/entries").select("cve_id", "package_name", "version_end", "cvss_score", F.lit(None).cast("string").alias("error"))
    errors = spark.read.parquet(f"{run}/out/errors").select(*(F.lit(None).cast(t).alias(c) for c, t in (("cve_id", "string"), ("package_name", "string"), ("version_end", "string"), ("cvss_score", "double"))), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))
    return entries.unionByName(errors)
