"""Stream readers and their options."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import file_status


def read_stream(spark: SparkSession, kind: str, path: str | None = None, schema=None, **options) -> DataFrame:
    """Stream from files (parquet, json, csv, text, orc), ``rate``, ``rate-micro-batch``, ``socket`` or ``kafka``."""
    reader = spark.readStream.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 200) -> DataFrame:
    """A Parquet table, one file or a directory of part files, as a stream of its appended files; a missing table raises."""
    path = f"{folder}/{name}.parquet"
    status = file_status(spark, path)
    if status is None:
        raise FileNotFoundError(path)
    if status.isDirectory():
        return read_stream(spark, "parquet", path, spark.read.parquet(path).schema, maxFilesPerTrigger=str(files_per_trigger))
    return read_stream(spark, "parquet", folder, spark.read.parquet(path).schema, pathGlobFilter=f"{name}.parquet",
                       maxFilesPerTrigger=str(files_per_trigger))


def kafka_options(servers: str, topics: str | None = None, pattern: str | None = None,
                  assign: dict[str, list[int]] | None = None, starting: str | dict[str, dict[int, int]] = "latest",
                  headers: bool = False, max_offsets: int | None = None, tls: dict | None = None) -> dict[str, str]:
    """Options of the Kafka source: one way to choose topics, starting offsets per partition, headers, rate and TLS."""
    chosen = [("subscribe", topics), ("subscribePattern", pattern), ("assign", json.dumps(assign) if assign else None)]
    chosen = [(k, v) for k, v in chosen if v]
    if len(chosen) != 1:
        raise ValueError("give exactly one of topics, pattern and assign")
    offsets = starting if isinstance(starting, str) else json.dumps(
        {t: {str(p): o for p, o in parts.items()} for t, parts in starting.items()})
    options = {"kafka.bootstrap.servers": servers, "startingOffsets": offsets, chosen[0][0]: chosen[0][1]}
    if headers:
        options["includeHeaders"] = "true"
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    if tls:
        options["kafka.security.protocol"] = "SSL"
        options |= {f"kafka.ssl.{k}": v for k, v in tls.items()}
    return options
