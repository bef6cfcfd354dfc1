"""Writers and table maintenance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.merge import Clause, check_unique, merge
from tidemill.operators.ordered import same_keys
from tidemill.session import MAX_BROADCAST_ROWS, file_status, materialise, setting
from tidemill.sources import redo

TARGET_FILE_BYTES = 128 * 1024 * 1024


def write(df: DataFrame, kind: str, path: str | None = None, mode: str = "errorifexists",
          partition_by: list[str] | None = None, repartition: int | None = None,
          repartition_by: list[str] | None = None, coalesce: int | None = None, **options) -> None:
    """Write parquet, csv, json, orc, xml, text or jdbc, optionally repartitioned and partitioned."""
    by = [F.col(c) for c in repartition_by or []]
    if repartition and by:
        df = df.repartition(repartition, *by)
    elif repartition:
        df = df.repartition(repartition)
    elif by:
        df = df.repartition(*by)
    if coalesce:
        df = df.coalesce(coalesce)
    writer = df.write.format(kind).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path) if path else writer.save()


def spread_for_partitions(df: DataFrame, keys: list[str], files_per_key: int = 1) -> DataFrame:
    """Repartition by the partition columns; a big partition is salted over several tasks and files."""
    if files_per_key <= 1:
        return df.repartition(*keys)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
    return df.withColumn("_salt", salt).repartition(*keys, "_salt").drop("_salt")


def spread_by_bytes(df: DataFrame, keys: list[str], total_bytes: int, file_bytes: int) -> DataFrame:
    """Repartition so that each partition is written as at most ``ceil(its bytes / file_bytes)`` files. A partition's bytes
    are its share of the rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    counts = counts.select(*[F.col(k).alias("_p_" + k) for k in keys], F.ceil(F.col("_n") * (total_bytes / total / file_bytes)).alias("_files"))
    salt = F.pmod(F.xxhash64(*df.columns), F.greatest("_files", F.lit(1)))
    salted = df.join(counts, same_keys(keys, "_p_"), "left").withColumn("_salt", salt)
    return salted.repartition(*keys, "_salt").drop("_salt", "_files", *["_p_" + k for k in keys])


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that occur in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))


def files_of(rows: DataFrame) -> DataFrame:
    """The files that rows read from a stored table lie in."""
    return rows.select(F.col("_metadata.file_path").alias("file")).distinct()


def replace_matching(spark: SparkSession, path: str, predicate: Column, new: DataFrame, partition_by: list[str], name: str | None = None) -> None:
    """Replace whole partitions holding rows that match the predicate by the new rows, which must match it too.

    Matching partitions that get no new row are deleted. The change goes through a redo record: cut off at any point, it is made in whole or not at all, and a
    change that has a ``name`` is made once however often it is run."""
    name = redo.begin(spark, path, name)
    if name is None:
        return
    new = materialise(new)  # it may be read from the partitions it replaces
    if not new.where(~F.coalesce(predicate, F.lit(False))).isEmpty():
        raise ValueError("some new rows do not match the predicate")
    stored = spark.read.parquet(path)
    hit = stored.where(predicate).select(*[F.col(c).alias("_t_" + c) for c in partition_by]).distinct()
    filled = new.select(*[F.col(c).alias("_t_" + c) for c in partition_by]).distinct()
    old = stored.select(*partition_by, "_metadata").join(hit.union(filled).distinct(), same_keys(partition_by, "_t_"), "left_semi")
    redo.change(spark, path, name, new, files_of(old), partition_by)


def merge_into_path(spark: SparkSession, path: str, source: DataFrame, keys: list[str], partition_by: list[str],
                    matched: list[Clause] = (), not_matched: list[Clause] = (), name: str | None = None) -> None:
    """Merge into a stored, partitioned table, rewriting only partitions that hold a matched key.

    Stored keys and partition columns are scanned once to find those partitions, then these alone are read. Rows that are
    new in any other partition, or move to it, are added there as files of their own. The change goes through a redo record: cut off before the record,
    nothing has changed; after it, the next ``redo.read_table`` or writer finishes it. A merge that has a ``name`` is made once however often it is run; without
    one, a second run merges into what the first left."""
    check_unique(source, keys)
    name = redo.begin(spark, path, name)
    if name is None:
        return
    source = materialise(source)
    stored = spark.read.parquet(path)
    hit = stored.join(source.select(*keys), keys, "left_semi").select(*partition_by).distinct()
    touched = materialise(hit.select(*[F.col(c).alias("_t_" + c) for c in partition_by]))
    in_touched = same_keys(partition_by, "_t_")
    side = F.broadcast(touched) if touched.count() <= setting(spark, "maxBroadcastRows", MAX_BROADCAST_ROWS) else touched
    old = stored.join(side, in_touched, "left_semi")
    dropped = files_of(stored.select(*partition_by, "_metadata").join(side, in_touched, "left_semi"))
    redo.change(spark, path, name, merge(old, source, keys, matched, not_matched, check=False), dropped, partition_by)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None,
               bucket_by: list[str] | None = None, buckets: int = 10, repartition: int | None = None) -> None:
    """Save as a catalog table, partitioned and bucketed for co-located joins."""
    if repartition:
        df = df.repartition(repartition)
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def insert_into(df: DataFrame, name: str, repartition: int | None = None) -> None:
    """Append to a table, matching its columns by name."""
    table = df.sparkSession.table(name)
    df = df.repartition(repartition) if repartition else df
    df.select(*table.columns).write.insertInto(name)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the data files under a path, summed on the cluster from file metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = TARGET_FILE_BYTES,
            partition_by: list[str] | None = None) -> int:
    """Rewrite small files: as many files as the stored bytes need, at least one. Returns that number."""
    files = max(1, math.ceil(stored_bytes(spark, source) / file_bytes))
    df = spark.read.parquet(source)
    if partition_by:  # the rows of a partition meet in its own tasks; dealt round robin each task would write a file for each partition
        df = spread_by_bytes(df, partition_by, stored_bytes(spark, source), file_bytes)
    else:
        df = df.repartition(files)
    write(df, "parquet", target, mode="overwrite", partition_by=partition_by)
    return files


def refresh_partitions(spark: SparkSession, name: str) -> None:
    """Make partitions written outside Spark visible."""
    spark.catalog.recoverPartitions(name)


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the greatest ``version=`` partition; 1 when the path does not exist. A table that cannot be read raises."""
    if file_status(spark, path) is None:
        return 1
    last = spark.read.parquet(path).agg(F.max("version")).first()[0]
    return 1 if last is None else int(last) + 1


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write a table state into its own version partition; repeating the write changes nothing."""
    replace_partitions(df.withColumn("version", F.lit(version)), path, ["version"])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """State of a version, the newest by default."""
    df = spark.read.parquet(path)
    version = df.agg(F.max("version")).first()[0] if version is None else version
    return df.where(F.col("version") == version).drop("version")
