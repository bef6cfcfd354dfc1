"""A versioned table as a stream of its changes.

Every version is a whole state of the table, in ``version=<n>/bucket=<b>`` folders: a row lies in the bucket of the hash of all its values, so equal rows of two
versions lie in the same bucket and a task finds what changed in a bucket by itself. Files are sorted by that hash, which they hold as a column, so a task reads the two
versions side by side, some batches at a time, however large a bucket is; a bucket written without it is read as a whole. A mark ``_versions/<n>``, written last, makes a version visible.

The stream's offsets are version numbers. Between two versions a row is inserted as often as it occurs more, and deleted as often as it occurs less; a rewritten row is a
delete of the old and an insert of the new one. ``mode`` says what to do with deletes: ``fail`` raises, ``ignore`` passes over them, ``rows`` hands them on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.sources.paths import open_path

FORMAT = "table_versions"
MODES = ("fail", "ignore", "rows")
CHANGE, VERSION = "_change", "_version"
HASH, COUNT = "_row_hash", "_n"
# Rows of a file that are read at once, and rows that are handed on together.
BLOCK = 32_768
ADDED = [T.StructField(CHANGE, T.StringType()), T.StructField(VERSION, T.LongType())]


def versions(path: str) -> dict[int, dict]:
    """The visible versions of a table, with their numbers of ``buckets`` and ``schema``."""
    system, base = open_path(path)
    found = system.get_file_info(fs.FileSelector(f"{base}/_versions", allow_not_found=True))
    out = {}
    for info in found:
        if info.base_name.isdigit():
            with system.open_input_stream(info.path) as file:
                out[int(info.base_name)] = json.loads(file.read())
    return dict(sorted(out.items()))


def write_version(df: DataFrame, path: str, version: int, buckets: int = 16) -> None:
    """Write a table state as a version and make it visible; repeating it changes nothing. All versions have as many buckets as the first."""
    buckets = next(iter(versions(path).values()), {"buckets": buckets})["buckets"]
    rows = df.withColumn(HASH, F.xxhash64(*df.columns)).withColumn("bucket", F.pmod(HASH, F.lit(buckets)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", HASH).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}")
    system, base = open_path(path)
    system.create_dir(f"{base}/_versions")
    with system.open_output_stream(f"{base}/_versions/.{version}") as out:
        out.write(json.dumps({"buckets": buckets, "schema": df.schema.jsonValue()}).encode())
    system.move(f"{base}/_versions/.{version}", f"{base}/_versions/{version}")


@dataclass
class Bucket(InputPartition):
    """One bucket of a version and of the version before it."""

    before: int | None
    version: int
    bucket: int


class _Reader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.mode, self.first = options["path"], options.get("mode", "fail"), int(options.get("first", "0"))
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.schema = to_arrow_schema(T.StructType([f for f in schema.fields if f.name not in (CHANGE, VERSION)]))

    def initialOffset(self) -> dict:
        return {"version": self.first - 1}

    def latestOffset(self) -> dict:
        return {"version": max(versions(self.path), default=self.first - 1)}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        found, before, out = versions(self.path), None, []
        for version, about in found.items():
            if start["version"] < version <= end["version"]:
                out += [Bucket(before, version, b) for b in range(about["buckets"])]
            before = version if version >= self.first else None
        return out

    def _files(self, version: int | None, bucket: int) -> list[str]:
        system, base = open_path(self.path)
        folder = fs.FileSelector(f"{base}/version={version}/bucket={bucket}", allow_not_found=True)
        return [] if version is None else sorted(i.path for i in system.get_file_info(folder) if i.path.endswith(".parquet"))

    def _blocks(self, file: pq.ParquetFile, count: int, hashed: bool) -> Iterator[pa.Table]:
        """A file with the columns of the stream; columns it lacks are null. Without hashes all rows get the same one."""
        for part in file.iter_batches(BLOCK, use_threads=False):
            names = part.schema.names
            columns = [part[f.name].cast(f.type) if f.name in names else pa.nulls(len(part), f.type) for f in self.schema]
            columns += [part[HASH] if hashed else np.zeros(len(part), np.int64), np.full(len(part), count)]
            yield self._net([pa.table(columns, names=[*self.schema.names, HASH, COUNT])])

    def _net(self, parts: list[pa.Table]) -> pa.Table:
        """Each different row once with its counts added, in the order of the hash."""
        keys = [*self.schema.names, HASH]
        net = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([(COUNT, "sum")])
        return net.select([*keys, f"{COUNT}_sum"]).rename_columns([*keys, COUNT]).sort_by(HASH)

    def _changes(self, partition: Bucket) -> Iterator[pa.Table]:
        """Rows of the bucket with how many more of them the version has than the one before. The files go forward together: what lies below the least
        hash that one of them has come to is complete."""
        system, _ = open_path(self.path)
        with ExitStack() as stack:
            files = [(pq.ParquetFile(stack.enter_context(system.open_input_file(name)), coerce_int96_timestamp_unit="us", buffer_size=1 << 20, pre_buffer=False), count)
                     for version, count in ((partition.version, 1), (partition.before, -1)) for name in self._files(version, partition.bucket)]
            hashed = all(HASH in file.schema_arrow.names for file, _ in files)
            blocks = [self._blocks(file, count, hashed) for file, count in files]
            waiting: list[list[pa.Table]] = [[] for _ in files]
            reading, behind = set(range(len(files))), set(range(len(files)))
            while reading:
                for i in sorted(behind & reading):
                    block = next(blocks[i], None)
                    if block is None:
                        reading.discard(i)
                    else:
                        waiting[i] = [self._net([*waiting[i], block])]
                ends = {i: waiting[i][0][HASH][-1].as_py() for i in reading}
                bound = min(ends.values(), default=None)
                behind = {i for i, end in ends.items() if end == bound}
                complete = []
                for i, tables in enumerate(waiting):
                    for table in tables:
                        n = len(table) if bound is None else int(np.searchsorted(table[HASH].to_numpy(), bound))
                        complete.append(table.slice(0, n))
                        waiting[i] = [table.slice(n)]
                if complete:
                    yield self._net(complete).filter(pc.field(COUNT) != 0)

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        for net in self._changes(partition):
            if self.mode == "fail" and pc.any(pc.less(net[COUNT], 0)).as_py():
                raise ValueError(f"version {partition.version} of {self.path} deletes or rewrites rows; read it with mode ignore or rows")
            for change, rows in (("delete", net.filter(pc.field(COUNT) < 0)), ("insert", net.filter(pc.field(COUNT) > 0))):
                if change == "insert" or self.mode == "rows":
                    yield from self._copies(rows, change, partition.version)

    def _copies(self, rows: pa.Table, change: str, version: int) -> Iterator[pa.RecordBatch]:
        """Every row as often as it is counted, in batches of bounded size."""
        upto = np.cumsum(np.abs(rows[COUNT].to_numpy()))
        rows = rows.select(self.schema.names)
        for low in range(0, int(upto[-1]) if len(upto) else 0, BLOCK):
            out = rows.take(pa.array(np.searchsorted(upto, np.arange(low, min(low + BLOCK, upto[-1])), side="right")))
            out = out.append_column(CHANGE, pa.array([change] * len(out))).append_column(VERSION, pa.array([version] * len(out), pa.int64()))
            yield from out.combine_chunks().to_batches()


class VersionsSource(DataSource):
    """The stream reader as a source; options path, mode and first (the first version to read; its rows all count as inserted)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: T.StructType) -> _Reader:
        return _Reader(schema, self.options)


def version_stream(spark: SparkSession, path: str, mode: str = "fail", first: int = 0) -> DataFrame:
    """The rows of the table with ``_change`` (insert or delete) and ``_version``, version by version from ``first`` on."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    found = versions(path)
    if not found:
        raise FileNotFoundError(f"no version of {path}")
    columns = T.StructType.fromJson(found[max(found)]["schema"])
    spark.dataSource.register(VersionsSource)
    return (spark.readStream.format(FORMAT).schema(T.StructType([*columns.fields, *ADDED]))
            .options(path=path, mode=mode, first=str(first)).load())
