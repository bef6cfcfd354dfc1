"""Rows that an operator must keep, reject or raise on."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tidemill.operators import intervals, merge, relational
from tidemill.operators.merge import delete, insert, update
from tidemill.sources import readers, writers
from tidemill.streaming import sources


def test_stream_of_a_directory_table(spark, folder):
    spark.range(100).repartition(3).write.parquet(f"{folder}/t.parquet")
    query = sources.table_stream(spark, folder, "t").writeStream.format("memory").queryName("directory_rows").option(
        "checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("directory_rows").count() == 100
    with pytest.raises(FileNotFoundError):
        sources.table_stream(spark, folder, "none")


def test_value_range_keeps_small_values(spark):
    df = spark.createDataFrame([(1, 0.004), (1, 0.003), (1, 10.001), (1, None)], "k int, v double")
    found = {r["v"]: r["s"] for r in relational.value_range_sum(df, ["k"], "v", 10, "s").collect()}
    assert found[10.001] == pytest.approx(10.008) and found[0.004] == pytest.approx(10.008) and found[None] is None


def test_replace_raises_on_rows_outside(spark, folder):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "x int, y int")
    with pytest.raises(ValueError):
        merge.replace_where(df, F.col("y") >= 2, spark.createDataFrame([(9, 1)], "x int, y int"))
    df.write.partitionBy("y").parquet(f"{folder}/p")
    writers.replace_matching(spark, f"{folder}/p", F.col("y") >= 2, spark.createDataFrame([(7, 2)], "x int, y int"), ["y"])
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/p").select("x", "y").collect())) == [(1, 1), (7, 2)]


def test_lines_of_no_shape_are_rejected(spark):
    lines = spark.createDataFrame([("a~b",), ("a~b~c",), ("a",), (None,)], "value string")
    parts = readers.by_field_count(lines, {"two": ["x", "y"], "three": ["x", "y", "z"]})
    assert parts["two"].count() == 1 and parts["three"].count() == 1
    assert sorted((r[0] for r in parts["_reject"].collect()), key=str) == [None, "a"]


def test_version_of_an_unreadable_table(spark, folder):
    assert writers.next_version(spark, f"{folder}/none") == 1
    spark.range(3).withColumn("version", F.lit(7)).write.partitionBy("version").parquet(f"{folder}/v")
    with open(f"{folder}/v/version=7/part-broken.parquet", "wb") as file:
        file.write(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017  whichever way it cannot be read, it is not version 1
        if writers.next_version(spark, f"{folder}/v") == 8:
            raise ValueError("read from the folder's name alone")


def test_compaction_by_partition_does_not_multiply_files(spark, folder):
    spark.range(20_000).withColumn("day", F.col("id") % 10).repartition(7).write.parquet(f"{folder}/in")
    files = writers.compact(spark, f"{folder}/in", f"{folder}/out", file_bytes=20_000, partition_by=["day"])
    per_day = spark.read.parquet(f"{folder}/out").groupBy("day", F.col("_metadata.file_path")).count().groupBy("day").count()
    assert files > 1 and spark.read.parquet(f"{folder}/out").count() == 20_000
    assert per_day.agg(F.max("count")).first()[0] <= -(-files // 10)


def test_merge_rewrites_only_touched_partitions(spark, folder, rows):
    path = f"{folder}/t"
    spark.createDataFrame([(i, i % 4, "old") for i in range(20)], "k int, p int, v string").write.partitionBy("p").parquet(path)
    files = lambda p: sorted(os.listdir(f"{path}/p={p}"))
    before = {p: files(p) for p in range(4)}
    # 1 changes, 5 moves to partition 2, 21 is new in partition 1 and 30 in a new one; 3, 7, 11, 15, 19 empty partition 3
    new = [(1, 1, "new"), (5, 2, "moved"), (21, 1, "new"), (30, 9, "new"), *((k, 3, "gone") for k in (3, 7, 11, 15, 19))]
    source = spark.createDataFrame(new, "k int, p int, v string")
    writers.merge_into_path(spark, path, source, ["k"], ["p"], [delete(F.col("s.v") == "gone"), update()], [insert()])
    expected = [(i, i % 4, "old") for i in range(20) if i % 4 != 3 and i not in (1, 5)] + new[:4]
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == sorted(expected, key=repr)
    assert files(0) == before[0] and set(before[2]) < set(files(2)) and not os.path.exists(f"{path}/p=3")


def test_replace_matching_deletes_partitions_without_rows(spark, folder, rows):
    path = f"{folder}/t"
    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, y int").write.partitionBy("y").parquet(path)
    writers.replace_matching(spark, path, F.col("y") >= 2, spark.createDataFrame([(9, 2)], "k int, y int"), ["y"])
    assert rows(spark.read.parquet(path).select("k", "y")) == [(1, 1), (9, 2)]


def test_open_ended_ranges_are_cut_to_the_points(spark, rows):
    day = datetime.date
    ranges = spark.createDataFrame([(1, "a", day(1, 1, 1), day(9999, 12, 31)), (2, "a", day(2024, 1, 1), None)], "r int, k string, s date, e date")
    points = spark.createDataFrame([("a", day(2024, 5, 1)), ("a", day(2024, 9, 1)), ("b", day(2024, 9, 1))], "k string, d date")
    out = intervals.range_join(ranges, points, ["k"], "s", "e", "d").select("r", F.date_format("d", "MM"))
    assert rows(out) == [(1, "05"), (1, "09")]


def test_minutes_before_1970(spark):
    trips = spark.createDataFrame([(1, datetime.datetime(1969, 12, 31, 23, 50), datetime.datetime(1969, 12, 31, 23, 55))], "k int, a timestamp, b timestamp")
    assert [r["minutes"] for r in intervals.minute_slots(trips, ["k"], "a", "b").collect()] == [5]
