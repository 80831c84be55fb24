"""Writing: upsert logs, snapshots and append stores as folders of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.operators.market import latest


def upsert(df: DataFrame, path: str, at: str = "updated_at") -> None:
    """Appends rows stamped with the time; ``current`` reads the last one of each key."""
    df.withColumn(at, F.current_timestamp()).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str, key: str, at: str = "updated_at") -> DataFrame:
    return latest(spark.read.parquet(path), key, at)


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A store's rows; none where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def snapshot(df: DataFrame, keys: list[str], path: str) -> None:
    """The distinct keys of a table, for a later ``snapshot_diff``."""
    df.select(*keys).distinct().write.mode("overwrite").parquet(path)


def append_valid(df: DataFrame, required: list[str], path: str) -> DataFrame:
    """Appends rows whose required texts aren't blank; returns the others."""
    filled = F.lit(True)
    for c in required:
        filled = filled & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    df.where(filled).write.mode("append").parquet(path)
    return df.where(~filled)


#: What is kept with a record of a person.
PERSONAL, YEARS_KEPT = True, 3


def store_people(df: DataFrame, path: str) -> None:
    """Appends records of people, marked as personal data with the years they may be kept; repeats stay."""
    df.withColumns({"pii": F.lit(PERSONAL), "retention_max_years": F.lit(YEARS_KEPT)}).write.mode("append").parquet(path)


def queue(df: DataFrame, path: str, key: str = "job_id", status: str = "prepared") -> None:
    """Appends items with their status; ``current`` by ``key`` gives each item's last state."""
    upsert(df.withColumn("status", F.lit(status)) if "status" not in df.columns else df, path)


def within(root: str, path: str) -> str:
    """``path`` under ``root``; one that leads out of it is an error. Absolute paths and addresses stay."""
    import posixpath

    if path.startswith("/") or "://" in path:
        return path
    full = posixpath.normpath(posixpath.join(root, path))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} leads out of {root}")
    return full
