"""Stream writers whose replayed batches change nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.session import shared_folder
from tidemill.sources.writers import replace_partitions


def new_folder(spark: SparkSession, name: str = "run") -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def start(df: DataFrame, checkpoint: str, each_batch: Callable | None = None, mode: str = "append", kind: str = "parquet",
          path: str | None = None, partition_by: list[str] | None = None, every: str | None = None, **options) -> StreamingQuery:
    """Start a query: a batch function or a file sink, on a processing-time trigger or over what is available now."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if each_batch:
        return writer.foreachBatch(each_batch).start()
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.format(kind).start(path)


def into_batch_partition(path: str, lineage: str = "batch_id") -> Callable:
    """Batch function writing each batch to its own partition, which a replay overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn(lineage, F.lit(batch_id)), path, [lineage])
    return write


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``into_batch_partition`` wrote under a path; without rows, where no batch had any."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(path)


def route_by_type(paths: dict[str, str], column: str, errors: str) -> Callable:
    """Batch function writing each message type to its own table; unknown types go to ``errors``. A type may have no
    rows; ``read_batches`` reads its table all the same."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for kind, path in paths.items():
            into_batch_partition(path)(batch.where(F.col(column) == kind), batch_id)
        unknown = F.col(column).isNull() | ~F.col(column).isin(*paths)
        into_batch_partition(errors)(batch.where(unknown), batch_id)
        batch.unpersist()
    return write


def then(*steps: Callable) -> Callable:
    """Run several batch functions on the same batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for step in steps:
            step(batch, batch_id)
        batch.unpersist()
    return write


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """One state partition per core unless ``n`` is given. A stateful query keeps the number it started
    with, and every partition costs a state store per operator, batch after batch."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, n or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(df: DataFrame, mode: str = "append", each_batch: Callable | None = None) -> DataFrame:
    """Run a stream over what is available and return what it wrote."""
    spark = df.sparkSession
    folder = new_folder(spark)
    out = f"{folder}/data"
    to_files = each_batch is None and mode == "append"
    with state_partitions(spark):
        if to_files:
            query = start(df, f"{folder}/checkpoint", path=out)
        else:
            query = start(df, f"{folder}/checkpoint", each_batch or into_batch_partition(out), mode)
        query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out) if to_files else read_batches(spark, out, df.schema)


class RowWriter:
    """Base of a row-by-row sink: override ``process``; ``open`` and ``close`` frame each partition and epoch."""

    def open(self, partition_id: int, epoch_id: int) -> bool:
        return True

    def process(self, row) -> None:
        raise NotImplementedError

    def close(self, error) -> None:
        if error:
            raise error


def start_row_writer(df: DataFrame, sink: RowWriter, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreach(sink).start())


def await_all(queries: list[StreamingQuery]) -> None:
    """Wait for several queries; the first failure is raised."""
    for q in queries:
        q.awaitTermination()
