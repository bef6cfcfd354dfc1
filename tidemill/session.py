"""Session-level helpers: settings, cutting lineage, table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one group that a single task may sort in a plain window.
MAX_GROUP_ROWS = 4_000_000
# The same where the whole table is one group.
MAX_TABLE_ROWS = 100_000
# Rows that one task sorts or groups in memory where a frame is dealt by its count.
MAX_TASK_ROWS = 1_000_000
# Rows up to which a lookup side may be hinted for broadcast.
MAX_BROADCAST_ROWS = 200_000


def setting(spark: SparkSession, name: str, default):
    """A numeric setting read from the session under ``spark.tidemill.<name>``."""
    value = spark.conf.get(f"spark.tidemill.{name}", None)
    return type(default)(value) if value is not None else default


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tidemill-")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so that later reads agree and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def file_status(spark: SparkSession, path: str):
    """The status of a path by Spark's own file systems; None where there is none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(found) if system.exists(found) else None


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under a path; none where there is no such path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(found) if s.isDirectory()) if system.exists(found) else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Row counts of the biggest group and of all: one map-side combined count over the key columns."""
    if not keys:
        return (df.count(),) * 2
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    return row[0] or 0, row[1] or 0


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return group_sizes(df, keys)[0]


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Deal ``rows`` rows (or fewer) by their keys to as many tasks as it takes to have about ``spark.tidemill.maxTaskRows`` in each. Adaptive execution joins
    partitions up to a size on disk, which in memory may be many times as much. Rows that all cores can hold at once are left to it."""
    spark = df.sparkSession
    limit = setting(spark, "maxTaskRows", MAX_TASK_ROWS)
    if rows <= limit * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(shuffle_partitions(spark), -(-rows // limit)), *keys)
