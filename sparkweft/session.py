"""Helpers around the session: reliable checkpoints and table reading."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast (tens of bytes each).
SMALL = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a session of one process (``local[...]``, as in tests) gets a temporary folder
    where none is set; on a cluster that is an error, as the folder would be one machine's.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Iterations call this once a round, so that plans stay small and a lost executor
    costs one round.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """:func:`cut` for a stage of a scan, after which the files behind it go.

    Spark removes shuffle files and old checkpoints once the driver's heap is collected and
    nothing refers to them; a driver with little to do may leave them for hours. It takes
    two collections: some files are held by what the first one lets go. Rounds don't use
    this, as it takes some tenths of a second.
    """
    out = cut(df.select("*"))  # what ran is this plan, which nobody holds
    gc.collect()
    for pause in (0.3, 0):
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(pause)
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut` and the number of rows, both in one job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The table, broadcast in joins if it has at most ``most`` rows; a larger one is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
