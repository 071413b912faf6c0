"""Feeds that the queries make from many parts."""

import pytest
from pyspark.sql import functions as F

from sparkweft import queries as library


@pytest.mark.parametrize("name", ["cve_feed_ingest", "cve_feed_stream"])
def test_feeds_of_many_tasks_are_whole(spark, tmp_path, name):
    """Where the texts come from many tasks, each is still a file of its own: what stood behind a file's first document was lost."""
    spark.range(300).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size", "'Brand#1' AS p_brand").repartition(6).write.parquet(f"{tmp_path}/part.parquet")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("false", "128m", "3"), strict=True):
            spark.conf.set(k, v)
        rows = library.queries()[name](spark, str(tmp_path)).groupBy(F.col("cve_id").isNotNull().alias("entry")).count().collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert {r["entry"]: r["count"] for r in rows} == {True: 600} | ({False: 1} if name == "cve_feed_stream" else {})
