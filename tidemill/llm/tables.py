"""Tables between the steps of an operator, and dropping rows by id without moving the documents when the ids are few."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import MAX_BROADCAST_ROWS, materialise, shared_folder


def without(docs: DataFrame, decided: DataFrame, doc_id: str, sign: Column) -> DataFrame:
    """The rows of ``docs`` not decided against; all columns. ``decided`` has one row (doc_id, sign, kept) per row of ``docs``.

    Rows of an id (null like any other) that is never kept go by the id alone: up to ``MAX_BROADCAST_ROWS`` ids, one number each, are broadcast;
    more are joined by a shuffle. Where an id has rows of both kinds, ``sign``, an expression over ``docs``, tells which of its rows go.
    """
    ids = materialise(decided.groupBy(F.col("doc_id").alias("_dropped_id")).agg(F.bool_or("kept").alias("_some"), F.bool_and("kept").alias("_all")).filter("not _all"))
    gone = ids.filter("not _some").select("_dropped_id")
    side = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone
    rows = docs.join(side, docs[doc_id].eqNullSafe(F.col("_dropped_id")), "left_anti")
    mixed = ids.filter("_some").select("_dropped_id")
    if not mixed.limit(1).count():
        return rows
    pairs = decided.filter("not kept").select("doc_id", F.col("sign").alias("_dropped_sign")).distinct()
    pairs = pairs.join(mixed, F.col("doc_id").eqNullSafe(F.col("_dropped_id")), "left_semi").withColumnRenamed("doc_id", "_dropped_id")
    return rows.join(pairs, rows[doc_id].eqNullSafe(F.col("_dropped_id")) & sign.eqNullSafe(F.col("_dropped_sign")), "left_anti")


class Scratch:
    """Compressed tables in the shared folder that cut lineage like a checkpoint and are deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.kept = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.kept)}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.kept[path] = found
        return found

    def free(self, *frames: DataFrame) -> None:
        """Delete tables that ``keep`` returned. What was made from them must have been kept before."""
        for path, found in self.kept.items():
            if any(found is f for f in frames):
                gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand documents to Python at most ``rows`` at a time: ten thousand long texts, copied on both sides, are hundreds of megabytes a core."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def with_small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """``small_batches`` for what is planned and run inside; the setting of before comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
