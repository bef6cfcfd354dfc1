"""Changes of stored tables cut off after every step, and run again."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill.operators.merge import delete, insert, update
from tidemill.sources import redo, writers
from tidemill.streaming import batches


class Cut(Exception):
    pass


def cut_off(monkeypatch, name, calls, after):
    """Raise in call number ``calls`` of a step of the change, before or after its work."""
    real, count = getattr(redo, name), [0]

    def step(*args):
        count[0] += 1
        if count[0] == calls and not after:
            raise Cut(name)
        real(*args)
        if count[0] == calls and after:
            raise Cut(name)
    monkeypatch.setattr(redo, name, step)


STEPS = [("_stage", 1, False), ("_stage", 1, True), ("_commit", 1, True), *(("_move", k, after) for k in (1, 2, 3) for after in (False, True)),
         *(("_drop", k, after) for k in (1, 2) for after in (False, True)), ("_apply", 1, True), ("_close", 1, False), ("_close", 1, True), ("delete_folder", 2, False)]


def stored(spark, path):
    spark.createDataFrame([(i, i % 4, i) for i in range(20)], "k int, p int, v int").write.partitionBy("p").parquet(path)


def change(spark, path, name):
    # 1 moves to partition 9, 5 is counted up in place, 21 is new, the rows of partition 3 are deleted; 2 changes only the columns the source has
    source = spark.createDataFrame([(1, 9), (5, 1), (21, 1), *((k, 3) for k in (3, 7, 11, 15, 19)), (2, 2)], "k int, p int")
    matched = [delete(F.col("t.p") == 3), update({"p": F.col("s.p"), "v": F.col("t.v") + 100})]
    writers.merge_into_path(spark, path, source, ["k"], ["p"], matched, [insert({"k": F.col("s.k"), "p": F.col("s.p"), "v": F.lit(-1)})], name=name)


EXPECTED = sorted([(i, i % 4, i) for i in range(20) if i % 4 != 3 and i not in (1, 2, 5)] + [(1, 9, 101), (5, 1, 105), (2, 2, 102), (21, 1, -1)])


@pytest.mark.parametrize("step", STEPS, ids=str)
def test_merge_cut_off_and_run_again(spark, folder, rows, monkeypatch, step):
    path = f"{folder}/t"
    stored(spark, path)
    untouched = sorted(os.listdir(f"{path}/p=0"))
    with monkeypatch.context() as patch:
        cut_off(patch, *step)
        with pytest.raises(Cut):
            change(spark, path, "first")
    change(spark, path, "first")
    for _ in range(2):
        assert sorted(rows(redo.read_table(spark, path).select("k", "p", "v"))) == EXPECTED
    assert sorted(os.listdir(f"{path}/p=0")) == untouched and not os.path.exists(f"{path}/p=3") and not os.path.exists(f"{path}/_redo/first")


@pytest.mark.parametrize("step", STEPS, ids=str)
def test_a_reader_sees_all_or_nothing(spark, folder, rows, monkeypatch, step):
    path = f"{folder}/t"
    stored(spark, path)
    with monkeypatch.context() as patch:
        cut_off(patch, *step)
        with pytest.raises(Cut):
            change(spark, path, None)
    found = sorted(rows(redo.read_table(spark, path).select("k", "p", "v")))
    assert found == (sorted((i, i % 4, i) for i in range(20)) if step[0] == "_stage" else EXPECTED)
    assert redo.recover(spark, path) == []


def test_replace_reads_what_it_replaces(spark, folder, rows, monkeypatch):
    path = f"{folder}/t"
    stored(spark, path)
    for cut in (True, False):
        new = redo.read_table(spark, path).where("p >= 2 and v > 9").withColumn("v", F.col("v") * 10)
        with monkeypatch.context() as patch:
            if cut:
                cut_off(patch, "_drop", 1, True)
                with pytest.raises(Cut):
                    writers.replace_matching(spark, path, F.col("p") >= 2, new, ["p"], "tens")
            else:
                writers.replace_matching(spark, path, F.col("p") >= 2, new, ["p"], "tens")
    expected = [(i, i % 4, i) for i in range(20) if i % 4 < 2] + [(i, i % 4, i * 10) for i in range(10, 20) if i % 4 >= 2]
    assert sorted(rows(redo.read_table(spark, path).select("k", "p", "v"))) == sorted(expected)


def test_partition_values_with_signs(spark, folder, rows):
    path = f"{folder}/a table"
    spark.createDataFrame([(1, "a b/c:%"), (2, "é=1"), (3, "x")], "k int, p string").write.partitionBy("p").parquet(path)
    source = spark.createDataFrame([(1, "new %25"), (2, "é=1")], "k int, p string")
    writers.merge_into_path(spark, path, source, ["k"], ["p"], [update()], [])
    assert rows(redo.read_table(spark, path).select("k", "p")) == [(1, "new %25"), (2, "é=1"), (3, "x")]


def test_recomputing_cut_off(spark, folder, rows, monkeypatch):
    points, out = f"{folder}/points", f"{folder}/out"
    spark.createDataFrame([(s, i) for s in range(3) for i in range(4)], "season int, p int").write.parquet(points)
    fn = batches.recompute_affected(lambda s: s.read.parquet(points), ["season"], lambda df: df.groupBy("season").agg(F.sum("p").alias("p")), out)
    fn(spark.createDataFrame([(0,), (1,), (2,)], "season int"), 0)
    spark.createDataFrame([(1, 100)], "season int, p int").write.mode("append").parquet(points)
    with monkeypatch.context() as patch:
        cut_off(patch, "_move", 1, True)
        with pytest.raises(Cut):
            fn(spark.createDataFrame([(1,), (7,)], "season int"), 1)
    fn(spark.createDataFrame([(1,), (7,)], "season int"), 1)
    assert rows(redo.read_table(spark, out).select("season", "p")) == [(0, 6), (1, 106), (2, 6)]
