"""A versioned table as a stream: inserts and deletes, modes, restarts, columns that come later."""

import datetime
import shutil
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemill.streaming import sinks, versions


def drain(spark, folder, mode="rows", first=0, name="data"):
    stream = versions.version_stream(spark, f"{folder}/t", mode, first)
    sinks.start(stream, f"{folder}/{name}-checkpoint", path=f"{folder}/{name}").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def write(spark, folder, version, rows, schema="k int, v string"):
    versions.write_version(spark.createDataFrame(rows, schema), f"{folder}/t", version, buckets=3)


def test_changes_over_versions_and_a_restart(spark, folder, rows):
    write(spark, folder, 1, [(1, "a"), (2, "b"), (3, None), (3, None), (None, "n")])
    write(spark, folder, 2, [(1, "a"), (2, "B"), (3, None), (None, "n"), (4, "d"), (4, "d")])  # rewritten, one of two equal rows gone, two added
    first = [("insert", 1, 1, "a"), ("insert", 1, 2, "b"), ("insert", 1, 3, None), ("insert", 1, 3, None), ("insert", 1, None, "n"), ("delete", 2, 2, "b"), ("insert", 2, 2, "B"),
             ("delete", 2, 3, None), ("insert", 2, 4, "d"), ("insert", 2, 4, "d")]
    columns = ["_change", "_version", "k", "v"]
    assert rows(drain(spark, folder).select(columns)) == sorted(first, key=repr)
    assert drain(spark, folder).count() == len(first)  # nothing new: nothing read again
    write(spark, folder, 5, [(4, "d")])
    write(spark, folder, 7, [], "k int, v string")
    later = [("delete", 5, 1, "a"), ("delete", 5, 2, "B"), ("delete", 5, 3, None), ("delete", 5, None, "n"), ("delete", 5, 4, "d"), ("delete", 7, 4, "d")]
    assert rows(drain(spark, folder).select(columns)) == sorted(first + later, key=repr)


def test_modes(spark, folder, rows):
    write(spark, folder, 1, [(1, "a"), (2, "b")])
    write(spark, folder, 2, [(1, "a"), (2, "b"), (3, "c")])
    assert rows(drain(spark, folder, "fail", name="f").select("k")) == [(1,), (2,), (3,)]
    write(spark, folder, 3, [(1, "A"), (3, "c")])
    with pytest.raises(StreamingQueryException, match="deletes or rewrites"):
        drain(spark, folder, "fail", name="f")
    assert rows(drain(spark, folder, "ignore", name="i").select("_change", "_version", "k", "v")) == [
        ("insert", 1, 1, "a"), ("insert", 1, 2, "b"), ("insert", 2, 3, "c"), ("insert", 3, 1, "A")]
    assert rows(drain(spark, folder, "rows", first=2, name="r").select("_change", "_version", "k")) == [
        ("delete", 3, 1), ("delete", 3, 2), ("insert", 2, 1), ("insert", 2, 2), ("insert", 2, 3), ("insert", 3, 1)]
    with pytest.raises(ValueError):
        versions.version_stream(spark, f"{folder}/t", "other")
    with pytest.raises(FileNotFoundError):
        versions.version_stream(spark, f"{folder}/none")


def test_a_version_without_its_mark_is_not_seen(spark, folder):
    write(spark, folder, 1, [(1, "a")])
    spark.createDataFrame([(9, "x", 2, 0)], "k int, v string, version int, bucket int").write.mode("append").partitionBy("version", "bucket").parquet(f"{folder}/t")
    assert drain(spark, folder).count() == 1
    write(spark, folder, 2, [(1, "a"), (2, "b")])  # written again as a whole
    assert sorted(r["k"] for r in drain(spark, folder).collect()) == [1, 2]


def test_types_and_columns_that_come_later(spark, folder):
    write(spark, folder, 1, [(1, Decimal("1.50"), datetime.datetime(2024, 1, 1, 5), datetime.date(2024, 1, 1), 0.5)], "k int, d decimal(6,2), ts timestamp, day date, x double")
    write(spark, folder, 2, [(1, Decimal("1.50"), datetime.datetime(2024, 1, 1, 5), datetime.date(2024, 1, 1), 0.5, "new"), (2, None, None, None, None, None)],
          "k int, d decimal(6,2), ts timestamp, day date, x double, more string")
    out = drain(spark, folder).orderBy("_version", "_change", "k").collect()
    assert [(r["_change"], r["_version"], r["k"], r["d"], r["x"], r["more"]) for r in out] == [
        ("insert", 1, 1, Decimal("1.50"), 0.5, None), ("delete", 2, 1, Decimal("1.50"), 0.5, None), ("insert", 2, 1, Decimal("1.50"), 0.5, "new"), ("insert", 2, 2, None, None, None)]
    assert out[0]["ts"] == datetime.datetime(2024, 1, 1, 5) and out[0]["day"] == datetime.date(2024, 1, 1)


def test_aggregates_follow_the_changes(spark, folder):
    """Signs of the changes add up to the newest state."""
    write(spark, folder, 1, [(i % 3, "x") for i in range(30)])
    write(spark, folder, 2, [(i % 5, "x") for i in range(20)])
    sign = F.when(F.col("_change") == "insert", 1).otherwise(-1)
    totals = drain(spark, folder).groupBy("k").agg(F.sum(sign).alias("n")).where("n <> 0").orderBy("k").collect()
    assert [(r["k"], r["n"]) for r in totals] == [(k, 4) for k in range(5)]


def test_buckets_are_read_in_blocks(spark, folder, rows, monkeypatch):
    """The two versions of a bucket go forward together; never more than a few blocks of rows are held, and a row that occurs very often counts as one."""
    monkeypatch.setattr(versions, "BLOCK", 50)
    first = spark.range(3000).select((F.col("id") % 2500).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v")).unionByName(
        spark.range(1000).select(F.lit(-1).cast("long").alias("k"), F.lit("same").alias("v")))
    second = first.where("k % 3 <> 0 and k >= 0").unionByName(spark.range(200).select((F.col("id") + 9000).alias("k"), F.lit("x").alias("v")))
    for version, df in ((1, first), (2, second)):
        versions.write_version(df, f"{folder}/t", version, buckets=2)
    stream = versions.version_stream(spark, f"{folder}/t", "rows")
    reader = versions.VersionsSource({"path": f"{folder}/t", "mode": "rows"}).streamReader(stream.schema)
    widest, concat = [], versions.pa.concat_tables
    monkeypatch.setattr(versions.pa, "concat_tables", lambda tables: widest.append(sum(map(len, tables))) or concat(tables))
    found = []
    for part in reader.partitions({"version": -1}, {"version": 2}):
        for batch in reader.read(part):
            assert len(batch) <= 50
            found += [tuple(r.values()) for r in batch.to_pylist()]
    assert max(widest) <= 4 * 50
    columns = [F.lit(c) for c in ("insert", "delete")]
    expected = first.select("k", "v", columns[0], F.lit(1)).unionAll(second.exceptAll(first).select("k", "v", columns[0], F.lit(2))).unionAll(
        first.exceptAll(second).select("k", "v", columns[1], F.lit(2)))
    assert sorted(found, key=repr) == rows(expected)


def test_a_version_written_without_hashes(spark, folder, rows):
    """Versions of tables that are older than the hash column are read as before."""
    write(spark, folder, 1, [(i % 40, "a") for i in range(60)])
    for bucket in range(3):
        old = spark.read.parquet(f"{folder}/t/version=1/bucket={bucket}").drop(versions.HASH)
        old.write.parquet(f"{folder}/old/version=1/bucket={bucket}")
    shutil.copytree(f"{folder}/t/_versions", f"{folder}/old/_versions")
    versions.write_version(spark.createDataFrame([(i % 50, "a") for i in range(60)], "k int, v string"), f"{folder}/old", 2)
    stream = versions.version_stream(spark, f"{folder}/old", "rows")
    sinks.start(stream, f"{folder}/ck", path=f"{folder}/data").awaitTermination()
    sign = F.when(F.col("_change") == "insert", 1).otherwise(-1)
    totals = spark.read.schema(stream.schema).parquet(f"{folder}/data").groupBy("k").agg(F.sum(sign).alias("n")).orderBy("k").collect()
    assert [(r["k"], r["n"]) for r in totals] == [(k, 2 if k < 10 else 1) for k in range(50)]
