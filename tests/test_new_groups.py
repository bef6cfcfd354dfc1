"""Operators for crowded values, hot bins, sibling arrays, file ends and skewed database keys."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.flows import marks
from tidemill.operators import intervals, nested, relational
from tidemill.sources import readers, writers


@pytest.mark.parametrize("limit", [None, 90])
def test_range_sums_of_crowded_values(spark, rows, limit):
    """One key holds all rows, all within one block of the range; sums equal the window's."""
    pick = random.Random(1)
    data = [("k", pick.choice([pick.randrange(2000) / 128, pick.randrange(40) / 2])) for _ in range(3000)] + [("other", 1.0), ("k", None), (None, 3.0), (None, 9.0)]
    df = spark.createDataFrame(data, "k string, v double")
    out = relational.value_range_sum(df, ["k"], "v", 10, "s", max_group_rows=limit)
    w = Window.partitionBy("k").orderBy("v").rangeBetween(-10, 10)
    expected = df.withColumn("s", F.when(F.col("v").isNotNull(), F.sum("v").over(w)))
    assert rows(out) == rows(expected)


def test_range_sums_keep_their_digits(spark):
    """A small window beyond a large prefix: differences of doubles would lose it."""
    df = spark.createDataFrame([(1, -1e13 - i) for i in range(50)] + [(1, 0.001), (1, 0.002)], "k int, v double")
    found = {r["v"]: r["s"] for r in relational.value_range_sum(df, ["k"], "v", 1, "s").collect()}
    assert found[0.001] == 0.003 and found[0.002] == 0.003


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.mark.parametrize("limit", [1_000_000, 60, 7])
def test_range_join_of_hot_bins(spark, rows, limit):
    """Both sides crowd into one day of one key, and into one bin; the pairs are those of the plain join."""
    pick = random.Random(2)
    ranges = [(i, "hot", day(0), day(2)) for i in range(150)] + [(1000 + i, pick.choice(["hot", "b"]), day(pick.randrange(60)), day(pick.randrange(60, 90))) for i in range(200)]
    ranges += [(2000, "hot", day(-9000), day(9000)), (2001, "hot", None, day(3)), (2002, None, day(0), day(9)), (2003, "hot", day(5), day(1))]
    points = [(i, "hot", day(1)) for i in range(40)] + [(500 + i, pick.choice(["hot", "b"]), day(pick.randrange(80))) for i in range(150)] + [(900, "hot", None)]
    a = spark.createDataFrame(ranges, "r int, k string, s date, e date")
    b = spark.createDataFrame(points, "p int, k string, d date")
    out = intervals.range_join(a, b, ["k"], "s", "e", "d", max_bin_rows=limit).select("r", "p")
    plain = a.alias("a").join(b.alias("b"), F.expr("a.k = b.k and b.d > a.s and b.d < a.e")).select("r", "p")
    assert rows(out) == rows(plain)


def test_range_join_shares_out_one_day(spark):
    a = spark.range(100_000).select(F.col("id").alias("r"), F.lit("k").alias("k"), F.lit(day(0)).alias("s"), F.lit(day(2)).alias("e"))
    b = spark.range(10).select(F.col("id").alias("p"), F.lit("k").alias("k"), F.lit(day(1)).alias("d"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = intervals.range_join(a, b.hint("merge"), ["k"], "s", "e", "d", max_bin_rows=5000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1_000_000 and max(sizes) <= 0.5 * sum(sizes)


DOCS = "k int, a array<struct<x:int,deep:array<struct<y:string>>>>, b array<struct<z:double,s:struct<t:int>>>, plain array<int>, one struct<u:int,c:array<struct<v:int>>>"


def test_sibling_arrays_do_not_multiply(spark):
    docs = [(k, [(i, [(str(i),)] * (i % 3)) for i in range(100)], [(float(i), (i,)) for i in range(100)], [1, 2], (k, [(1,), None, (3,)])) for k in range(3)]
    df = spark.createDataFrame([*docs, (7, None, [], None, None), docs[0]], DOCS)
    frames = nested.split_documents(df)
    assert {n: f.count() for n, f in frames.items()} == {"": 5, "a": 400, "a_deep": 396, "b": 400, "one_c": 12}
    assert frames["b"].columns == ["_id", "_parent", "_pos", "_null", "z", "s_t"] and frames[""].columns == ["k", "plain", "one_u", "_id"]
    back = nested.join_documents(frames).orderBy("k").collect()
    assert [r["k"] for r in back] == [0, 0, 1, 2, 7]
    assert [(x["x"], [y["y"] for y in x["deep"]]) for x in back[2]["a"]] == [(i, [str(i)] * (i % 3)) for i in range(100)]
    assert [(x["z"], x["s_t"]) for x in back[2]["b"]] == [(float(i), i) for i in range(100)]
    assert [x and x["v"] for x in back[3]["one_c"]] == [1, None, 3] and back[4]["a"] == [] and back[4]["one_c"] == []
    assert nested.join_documents(nested.split_documents(df.limit(0))).collect() == []


@pytest.mark.parametrize("text", [b"one", b"one\n", b"\n", b"\n\n", b"a\r\nb\r\nc\r\n", b"a\rb", b"x" * 9000 + b"\n" + b"y" * 20000, b"a\n" * 5000 + b"end\n", b"a\n\n", "é\nü".encode()])
def test_line_ends(text):
    read = []

    def read_at(n, at):
        read.append(n)
        return text[at:at + n]
    lines = text.decode().replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
    assert readers.line_ends(read_at, len(text), 16) == (lines[0].encode(), lines[-1].encode())


def test_line_ends_read_little(spark, folder):
    with open(f"{folder}/big.txt", "wb") as f:
        f.write(b"first\n" + b"middle\n" * 1_000_000 + b"last")
    read = []
    with open(f"{folder}/big.txt", "rb") as f:
        def read_at(n, at):
            read.append(n)
            f.seek(at)
            return f.read(n)
        assert readers.line_ends(read_at, 7_000_010) == (b"first", b"last") and sum(read) <= 8192
    open(f"{folder}/empty.txt", "w").close()
    assert [tuple(r)[1:] for r in readers.first_and_last_line(spark, folder).collect()] == [("first", "last")]


def test_jdbc_slices_of_a_skewed_key(spark, rows):
    url, driver = "jdbc:derby:memory:slices;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    keys = [int(1.02 ** i) for i in range(900)] + [None] * 5
    df = spark.createDataFrame([(k, f"it's {i}") for i, k in enumerate(keys)], "k long, t string")
    writers.write(df, "jdbc", mode="overwrite", url=url, dbtable="skewed", driver=driver, createTableColumnTypes="t VARCHAR(40)")
    out = readers.read_jdbc(spark, url, 'SELECT "k", "t" FROM skewed', driver=driver, partition='"k"', partitions=8)
    assert rows(out) == rows(df)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert 8 <= len(sizes) <= 10 and max(sizes) <= 2 * len(keys) / 8
    texts = readers.read_jdbc(spark, url, 'SELECT "k", "t" FROM skewed', driver=driver, partition='"t"', partitions=4)
    assert rows(texts) == rows(df)
    none = readers.read_jdbc(spark, url, 'SELECT "k" FROM skewed WHERE "k" < 0', driver=driver, partition='"k"', partitions=4)
    assert none.collect() == []


def test_marks_are_decimals(spark):
    given = spark.createDataFrame([(1, 1, "CA", 1, Decimal("30.0625")), (1, 1, "CA", 2, Decimal("27.0005")), (1, 2, "SA", 1, Decimal("49.9995")), (1, 2, "SA", 2, Decimal("49.9994"))],
                                  "exam int, student int, kind string, subject int, marks decimal(7,4)")
    out = marks.exam_results(given)
    assert {f.name: f.dataType.simpleString() for f in out.schema if f.name in ("marks", "max_marks", "pass_mark")} == dict.fromkeys(("marks", "max_marks", "pass_mark"), "decimal(16,3)")
    found = {(r["student"], r["subject"]): (str(r["marks"]), r["result"]) for r in out.collect()}
    assert found == {(1, "1"): ("30.063", "PASS"), (1, "2"): ("27.001", "PASS"), (1, "subTotal"): ("57.064", "PASS"),
                     (2, "1"): ("50.000", "PASS"), (2, "2"): ("49.999", "FAIL"), (2, "subTotal"): ("99.999", "FAIL")}


def test_weighted_marks_round_half_up(spark):
    # 1 of 64 is 1.5625 %: 1.563; a quarter of 60 % of that is 0.23445: 0.234; 2 of 64 is 3.125 %, of which 15 % are 0.46875: 0.469.
    planned = spark.createDataFrame([(1, "x", "SA", e) for e in range(4)], "student int, subject string, kind string, exam int")
    given = spark.createDataFrame([(1, "x", "SA", 0, 1.0, 64.0), (1, "x", "SA", 1, 2.0, 64.0)], "student int, subject string, kind string, exam int, marks double, max_marks double")
    found = {r["subject"]: (str(r["sa_marks"]), str(r["total"]), r["attendance"]) for r in marks.semester_results(planned, given).collect()}
    assert found == {"x": ("0.703", "0.703", "Did not attend 2,3"), "subTotal": ("0.703", "0.703", "")}
