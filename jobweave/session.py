"""Session helpers: table access, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of ``sf_dir``; only ``columns`` when they are given.

    TIMESTAMP_NTZ columns stay as they are: the engine does its own
    arithmetic on them and never depends on the session time zone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, one is
    made on a single machine (local master); on a cluster, where executors would
    not see it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="jobweave-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, limit_rows: int) -> DataFrame:
    """Broadcast ``df`` when a bounded count proves at most ``limit_rows`` rows.

    The count stops after ``limit_rows + 1`` rows, so the check itself is
    bounded; a larger side is returned as it is and joins by shuffle.
    """
    if df.limit(limit_rows + 1).count() <= limit_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by the hash of ``keys``, in more parts than a shuffle has: small rows that are then multiplied."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def epoch_seconds(col):
    """Seconds since 1970 of a timestamp that is UTC without zone (or an instant)."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")
