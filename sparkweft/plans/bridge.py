"""Domain tables derived from the given star-schema tables, in SQL that Spark and DuckDB both run.

A customer is a project, parts are packages, consecutive lines of an order are
dependency edges.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from ..session import table

_ORDER = "l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice"


def _edges(node: str) -> str:
    return (
        f"SELECT DISTINCT project_id, src, dst FROM (SELECT o.o_custkey AS project_id, {node} AS src, lead({node}) OVER (PARTITION BY l.l_orderkey ORDER BY {_ORDER}) AS dst "
        "FROM {lineitem} AS l JOIN {orders} AS o ON o.o_orderkey = l.l_orderkey) AS x WHERE dst IS NOT NULL AND src <> dst"
    )


_VERSION = "concat(CAST(floor(p_size / 10) AS BIGINT), '.', p_size % 10, '.', p_partkey % 10, CASE WHEN p_partkey % 5 = 2 THEN concat('-rc.', p_partkey % 4) ELSE '' END)"
_ECOSYSTEM = "CASE WHEN p_partkey % 3 = 0 THEN 'npm' WHEN p_partkey % 3 = 1 THEN 'pip' ELSE 'maven' END"

#: Name -> SQL with the tables it reads in braces; a definition may use those before it.
TABLES = {
    "edges_p": _edges("l.l_partkey"),
    "edges_c": _edges("l.l_partkey % 25"),
    "edges_dag": "SELECT project_id, src, dst FROM {edges_p} WHERE src < dst",
    "nodes": f"SELECT e.project_id, e.name, {_VERSION} AS version, {_ECOSYSTEM} AS ecosystem FROM (SELECT project_id, src AS name FROM {{edges_p}} UNION SELECT project_id, dst AS name FROM {{edges_p}}) AS e JOIN {{part}} ON p_partkey = e.name",
    "cves": (
        "SELECT concat('CVE-', p_partkey, '-', k) AS cve_id, p_partkey AS package_name, "
        f"{_ECOSYSTEM} AS ecosystem, "
        "CASE WHEN k = 0 THEN '' ELSE concat(CAST(floor(p_size / 10) AS BIGINT), '.', (p_size % 10) - (p_size % 10) % 4, '.0') END AS version_start, "
        "CASE WHEN (p_partkey + k) % 3 = 0 THEN '' ELSE concat(CAST(floor(p_size / 10) AS BIGINT), '.', p_size % 10, '.4', CASE WHEN p_partkey % 11 = 0 THEN '-rc.2' ELSE '' END) END AS version_end, "
        "(p_partkey + k) % 2 = 0 AS version_start_incl, (p_partkey + k) % 4 < 2 AS version_end_excl, "
        "CAST((p_partkey * 37 + k * 11) % 101 AS DOUBLE) / 10 AS cvss_score FROM {part} CROSS JOIN (VALUES (0), (1)) AS t(k) WHERE p_partkey % 7 IN (0, 3)"
    ),
    "sinks": (
        "SELECT p_partkey AS node, CASE p_brand WHEN 'Brand#1' THEN 'file_write' WHEN 'Brand#6' THEN 'network' WHEN 'Brand#11' THEN 'credential' WHEN 'Brand#16' THEN 'crypto' ELSE 'database' END AS sink_type "
        "FROM {part} WHERE p_brand IN ('Brand#1', 'Brand#6', 'Brand#11', 'Brand#16', 'Brand#21')"
    ),
    "deps": (
        "SELECT o.o_custkey AS project_id, l.l_partkey % 50 AS name, concat(l.l_linenumber, '.', CAST(l.l_quantity AS BIGINT) % 13) AS version, "
        "CASE WHEN l.l_suppkey % 3 = 0 THEN 'npm' WHEN l.l_suppkey % 3 = 1 THEN 'pip' ELSE 'maven' END AS ecosystem, l.l_linenumber % 2 = 0 AS is_dev, l.l_linenumber = 1 AS is_direct, "
        "CASE WHEN l.l_linenumber > 1 THEN l.l_suppkey % 50 END AS parent, "
        "row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS seq "
        "FROM {lineitem} AS l JOIN {orders} AS o ON o.o_orderkey = l.l_orderkey"
    ),
    "snapshots": (
        "SELECT CAST(user_id AS VARCHAR(20)) AS project_id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, event_type AS name, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR(20)) AS version FROM {events}"
    ),
}

GIVEN = ("orders", "lineitem", "part", "events")


def uses(name: str) -> list[str]:
    """The tables that a definition reads, given or derived."""
    return list(dict.fromkeys(field for _, field, _, _ in Formatter().parse(TABLES[name]) if field))


def bridge(spark: SparkSession, sf_dir: str, *names: str, **made_before: DataFrame) -> list[DataFrame]:
    """The derived tables of these names, by way of those ``made_before``; nothing is left in the caller's catalog."""
    out: dict[str, DataFrame] = {**made_before}

    def made(name: str) -> DataFrame:
        if name not in out:
            out[name] = table(spark, sf_dir, name) if name in GIVEN else spark.sql(TABLES[name], **{t: made(t) for t in uses(name)})
        return out[name]

    return [made(n) for n in names]


def with_tables(*names: str) -> str:
    """The same tables as the head of a DuckDB statement."""
    need = [n for n in TABLES if n in names or (n == "edges_p" and {"edges_dag", "nodes"} & set(names))]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({TABLES[n].format_map({t: t for t in uses(n)})})" for n in need)
