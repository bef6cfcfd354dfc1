"""Changes of a stored table that survive being cut off.

A change replaces some files of a partitioned Parquet table by new rows. It goes through a folder of its own, ``<table>/_redo/<name>``, which readers of the table do
not see (Spark skips names that begin with an underscore):

1. the new rows are written to ``stage``;
2. one record, a small Parquet table ``record``, names every staged file to add and every stored file to drop; its ``_SUCCESS`` mark, written last, makes the change final;
3. staged files are moved to their places, then dropped files are deleted;
4. the mark ``<table>/_done/<name>`` is written and the folder deleted.

Cut off before the mark of step 2, the table is as it was and the next change removes what was staged. Cut off after it, the next reader that calls ``read_table``
or the next change finishes the record: files already moved or deleted are passed over, so applying it twice changes nothing. A change with the name of one
that is done, or was final when cut off, is not made again. One writer works on a table at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import file_status, subfolders

REDO, DONE = "_redo", "_done"
RECORD = "action string, file string, place string"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _qualified(spark: SparkSession, path: str) -> str:
    found = _path(spark, path)
    return _system(spark, found).makeQualified(found).toString()


def delete_folder(spark: SparkSession, path: str) -> None:
    found = _path(spark, path)
    _system(spark, found).delete(found, True)


def _move(spark: SparkSession, file, place) -> None:
    """Move a file unless that is done already."""
    system = _system(spark, place)
    if system.exists(file):
        system.mkdirs(place.getParent())
        if not system.rename(file, place):
            raise OSError(f"cannot move {file} to {place}")
    elif not system.exists(place):
        raise FileNotFoundError(f"neither {file} nor {place} is there")


def _drop(spark: SparkSession, file, top) -> None:
    """Delete a file, and folders of the table that this leaves empty."""
    system = _system(spark, file)
    system.delete(file, False)
    folder = file.getParent()
    while folder.toString() != top and system.exists(folder) and not len(system.listStatus(folder)):
        system.delete(folder, False)
        folder = folder.getParent()


def _stage(new: DataFrame, folder: str, partition_by: list[str]) -> None:
    new.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/stage")


def _commit(spark: SparkSession, folder: str, dropped: DataFrame) -> None:
    """Write the record; from its ``_SUCCESS`` mark on the change is final."""
    stage = _qualified(spark, f"{folder}/stage")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(stage)
    add = files.select(F.lit("add").alias("action"), F.col("path").alias("file"), F.expr(f"substring(path, {len(stage) + 2})").alias("place"))
    drop = dropped.select(F.lit("drop").alias("action"), F.col("file"), F.lit(None).cast("string").alias("place"))
    add.unionByName(drop.distinct()).write.mode("overwrite").parquet(f"{folder}/record")


def _apply(spark: SparkSession, table: str, folder: str) -> None:
    """Move and delete what the record names. Names alone pass through the driver, a partition of the record at a time; moves come first."""
    top = _qualified(spark, table)
    record = spark.read.schema(RECORD).parquet(f"{folder}/record")
    for row in record.where("action = 'add'").toLocalIterator():
        _move(spark, _path(spark, row["file"]), _path(spark, f"{top}/{row['place']}"))
    for row in record.where("action = 'drop'").toLocalIterator():
        _drop(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row["file"])), top)


def _close(spark: SparkSession, table: str, name: str) -> None:
    mark = _path(spark, f"{table}/{DONE}/{name}")
    _system(spark, mark).create(mark, True).close()
    delete_folder(spark, f"{table}/{REDO}/{name}")


def is_done(spark: SparkSession, table: str, name: str) -> bool:
    return file_status(spark, f"{table}/{DONE}/{name}") is not None


def _final(spark: SparkSession, table: str, name: str) -> bool:
    return file_status(spark, f"{table}/{REDO}/{name}/record/_SUCCESS") is not None


def recover(spark: SparkSession, table: str) -> list[str]:
    """Finish the open records of a table; returns their names. What was staged without a record is left to the next change."""
    found = [name for name in subfolders(spark, f"{table}/{REDO}") if _final(spark, table, name)]
    for name in found:
        if not is_done(spark, table, name):
            _apply(spark, table, f"{table}/{REDO}/{name}")
        _close(spark, table, name)
    if found:
        spark.catalog.refreshByPath(table)
    return found


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The stored table, after finishing what a cut-off change left open."""
    recover(spark, table)
    return spark.read.parquet(table)


def begin(spark: SparkSession, table: str, name: str | None) -> str | None:
    """Finish open records, remove what was staged without one, and give the change its name; None if the named change is done."""
    recover(spark, table)
    delete_folder(spark, f"{table}/{REDO}")
    if name is not None and is_done(spark, table, name):
        return None
    return name or uuid.uuid4().hex


def change(spark: SparkSession, table: str, name: str, new: DataFrame, dropped: DataFrame, partition_by: list[str]) -> None:
    """Add the rows ``new`` and drop the files named in ``dropped`` (``file``, as ``_metadata.file_path`` names them), all or nothing.

    ``name`` comes from ``begin``. The rows may be read from the files that are dropped."""
    folder = f"{table}/{REDO}/{name}"
    _stage(new, folder, partition_by)
    _commit(spark, folder, dropped)
    _apply(spark, table, folder)
    _close(spark, table, name)
    spark.catalog.refreshByPath(table)
