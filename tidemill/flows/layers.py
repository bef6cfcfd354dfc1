"""Bronze, silver and gold layers of sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.ordered import latest
from tidemill.operators.quality import layer_counts
from tidemill.sources.messages import positional
from tidemill.sources.writers import replace_partitions, spread_by_bytes, stored_bytes

FIELDS = [("reading", "double"), ("year", "int"), ("circuit", "string"), ("session", "string"), ("process_date", "date")]


def bronze(messages: DataFrame, batch_id: int) -> DataFrame:
    """Typed readings with their lineage; text that does not parse stays as null."""
    return positional(messages, "value", FIELDS).withColumn("batch_id", F.lit(batch_id)).drop("value")


def silver(rows: DataFrame) -> DataFrame:
    """Complete rows, in the day they were processed."""
    return rows.dropna(subset=[n for n, _ in FIELDS])


def gold_counts(rows: DataFrame) -> DataFrame:
    """Distinct readings per year, circuit and session."""
    return rows.groupBy("year", "circuit", "session").agg(F.count_distinct("reading").alias("readings"))


def gold_latest(rows: DataFrame) -> DataFrame:
    """Latest row of every reading."""
    return latest(rows, ["reading", "year", "circuit", "session"], ["process_date", "key"])


def ingest(path: str):
    """Batch function: messages to the bronze table, one partition per batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(bronze(batch, batch_id), path, ["batch_id"])
    return write


def to_silver(spark: SparkSession, source: str, target: str, file_bytes: int = 128 * 1024 * 1024) -> None:
    """Bronze rows by processing day, rewritten to as many files as their size asks for."""
    rows = silver(spark.read.parquet(source))
    replace_partitions(spread_by_bytes(rows, ["process_date"], stored_bytes(spark, source), file_bytes), target, ["process_date"])


def to_gold(spark: SparkSession, source: str, target: str) -> None:
    """Both gold tables; only the years present are replaced."""
    rows = spark.read.parquet(source)
    replace_partitions(gold_counts(rows), f"{target}/counts", ["year"])
    replace_partitions(gold_latest(rows), f"{target}/latest", ["year"])


def reconcile(spark: SparkSession, upper: str, lower: str) -> DataFrame:
    """Row counts per day of two layers."""
    return layer_counts(spark.read.parquet(upper), spark.read.parquet(lower), "process_date")
