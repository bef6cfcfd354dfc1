"""Groups too big for one task take another way; both ways must agree."""

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemill.operators.ordered import OrderedGroups, ranks, top_n
from tidemill.operators.relational import allocate, missing_rows

FOLDER = "/root/testdata/sf0.001"
ORDERED = ["win_01_ranks", "win_02_global_ranks", "win_05_lead_lag", "win_06_cume_dist", "win_08_running_total",
           "win_09_sliding_rows", "win_13_standings", "int_02_gap_sessions", "int_02_capped_sessions",
           "int_05_merge_overlapping", "int_13_consecutive_runs", "join_10_effective_dated_lookup", "ups_04_by_lead",
           "str_13_session_windows", "agg_20_greedy_allocation"]


@pytest.fixture
def tiny_groups(spark):
    spark.conf.set("spark.tidemill.maxGroupRows", "4")
    spark.conf.set("spark.tidemill.maxFoldRows", "3")
    yield
    spark.conf.unset("spark.tidemill.maxGroupRows")
    spark.conf.unset("spark.tidemill.maxFoldRows")


@pytest.mark.parametrize("name", ORDERED)
def test_queries_with_split_groups(spark, tiny_groups, name):
    oracle.same(entry.queries()[name](spark, FOLDER), oracle.connect(FOLDER), entry.oracle_sql()[name])


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one key, null keys, and null values."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 11).alias("k"),
        (F.col("id") * 37 % 900).alias("at"), F.when(F.col("id") % 6 != 0, F.col("id") % 17).alias("v")).persist()


def ordered(df, limit):
    g = OrderedGroups(df, ["k"], ["at"], max_group_rows=limit, chunks=7)
    assert g.split == (limit < 100)
    return (g.row_number("rn").running_sum("s", "v").running_sum("before", "v", exclusive=True).running_max("hi", "v")
            .running_max("hi_before", "v", exclusive=True).running_min("lo", "v").fill_forward("ff", "v")
            .lag("l1", "v", 1, -1).lag("l5", "at", 5, -5).lead("n1", "v").lead("n40", "at", 40, -40)
            ).frame


def test_sliding_frames_agree(skewed, rows):
    def run(limit):
        g = OrderedGroups(skewed, ["k"], ["at"], max_group_rows=limit, chunks=7)
        return g.sliding({"w": F.sum("at"), "n": F.count("v")}, 3, 2).sliding({"big": F.max("at")}, 60).frame
    assert rows(run(20)) == rows(run(10_000))


def test_all_running_values_agree(skewed, rows):
    assert rows(ordered(skewed, 20)) == rows(ordered(skewed, 10_000))


def test_descending_order_agrees(skewed, rows):
    def run(limit):
        g = OrderedGroups(skewed, ["k"], ["-at"], max_group_rows=limit, chunks=5)
        return g.row_number("rn").lag("p", "at", 2).running_sum("s", "v").frame
    assert rows(run(20)) == rows(run(10_000))


def test_whole_table_as_one_group(skewed, rows):
    def run(limit):
        return OrderedGroups(skewed, [], ["at"], max_group_rows=limit).row_number("rn").lead("n", "at", 3).frame
    assert rows(run(20)) == rows(run(10_000))


def test_ranks_agree(skewed, rows):
    def run(limit):
        return ranks(skewed, ["k"], ["-v"], "r", "d", "p", "c", max_group_rows=limit)
    assert rows(run(20)) == rows(run(10_000))


@pytest.mark.parametrize("limit", [1, 7, 100, 1000, 100000])
def test_allocation_in_rounds_equals_walk(spark, rows, limit):
    data = [(k, i, (i * 7919 + k * 31) % 97, limit) for k in range(3) for i in range(120)]
    df = spark.createDataFrame(data, "k int, i int, q int, room int")
    expected, total = [], {}
    for k, i, q, room in data:
        tried = total.get(k, 0) + q
        total[k] = tried if tried <= room else total.get(k, 0)
        expected.append((k, i, q, room, float(tried), "ok" if tried <= room else "ko"))
    assert rows(allocate(df, ["k"], "i", "q", "room", max_fold_rows=10)) == sorted(expected, key=repr)
    assert rows(allocate(df, ["k"], "i", "q", "room")) == sorted(expected, key=repr)


def test_fractional_allocation_agrees(spark, rows):
    """Quantities that doubles cannot hold give the same flags by folding and by rounds."""
    data = [(k, i, [0.1, 0.2, 0.3, 0.7][(i * 13 + k) % 4], 3.0) for k in range(40) for i in range(60)]
    df = spark.createDataFrame(data, "k int, i int, q double, room double")
    folded = rows(allocate(df, ["k"], "i", "q", "room"))
    assert folded == rows(allocate(df, ["k"], "i", "q", "room", max_fold_rows=1))
    total, flags = {}, []
    for k, i, q, room in data:
        tried = total.get(k, 0) + round(q * 10)
        total[k] = tried if tried <= 30 else total.get(k, 0)
        flags.append((k, i, "ok" if tried <= 30 else "ko"))
    assert sorted((r[0], r[1], r[5]) for r in folded) == sorted(flags)


def test_top_n_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    out = top_n(df, ["k"], ["-id"], 1500)
    assert out.count() == 3000 and out.agg(F.min("id"), F.max("rn")).first()[:] == (2000, 1500)


def test_worked_allocation(spark):
    qty = [20, 40, 10, 50, 40, 10, 20, 10]
    df = spark.createDataFrame([("f1", i + 1, q, 100) for i, q in enumerate(qty)], "f string, p int, q int, room int")
    out = [r.control for r in allocate(df, ["f"], "p", "q", "room").orderBy("p").collect()]
    assert out == ["ok", "ok", "ok", "ko", "ko", "ok", "ok", "ko"]


def test_missing_rows_keeps_copies(spark, rows):
    left = spark.range(25_000).select(F.lit("a").alias("x"), F.lit(None).cast("int").alias("y")).union(
        spark.createDataFrame([("b", 1)], "x string, y int"))
    out = missing_rows(left, left.limit(0).union(spark.createDataFrame([("a", None), ("b", 1)], "x string, y int")))
    assert out.count() == 24_999 and out.distinct().count() == 1


def test_pieces_stay_small(spark):
    """A third of the rows in one key, and all of them with the same order value."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"),
                                    F.lit(1).alias("at"), "id")
    g = OrderedGroups(df, ["k"], ["at"], max_group_rows=1000, chunks=12)
    sizes = [r[0] for r in g.df.groupBy("_chunk").count().select("count").collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 60_000 / 12
    numbered = g.row_number("rn").frame.where("k = 0")
    assert numbered.agg(F.count_distinct("rn"), F.max("rn")).first()[:] == (20_040, 20_040)


@pytest.fixture
def small_tasks(spark):
    spark.conf.set("spark.tidemill.maxTaskRows", "300")
    yield 300
    spark.conf.unset("spark.tidemill.maxTaskRows")


def test_tasks_get_a_bounded_number_of_rows(spark, small_tasks):
    """Many groups that one task each may hold are dealt by their count, whatever the number of shuffle partitions."""
    df = spark.range(20_000).select((F.col("id") % 1999).alias("k"), "id")
    out = OrderedGroups(df, ["k"], ["id"]).row_number("rn").frame
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 60 and max(sizes) < 3 * small_tasks
    assert out.where(F.col("rn") != F.floor(F.col("id") / 1999) + 1).count() == 0
    few = OrderedGroups(df.where("id < 1000"), ["k"], ["id"]).row_number("rn").frame
    assert few.groupBy(F.spark_partition_id()).count().count() <= 4


@pytest.mark.parametrize("name", ["int_13_consecutive_runs", "e2e_10_store_report"])
def test_queries_over_many_tasks(spark, small_tasks, name):
    found = entry.queries()[name](spark, FOLDER)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    oracle.same(found, oracle.connect(FOLDER), entry.oracle_sql()[name])
