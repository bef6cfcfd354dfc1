"""Worked examples and rules of the batch operators."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, rules, text
from tidemill.operators import intervals, merge as m, nested, relational, scd
from tidemill.operators.ordered import latest, nth_distinct


def dates_frame(spark, data, schema, *columns):
    df = spark.createDataFrame(data, schema)
    return df.withColumns({c: F.to_date(c) for c in columns})


def test_minute_slots_count_overlap_once(spark):
    trips = spark.createDataFrame([("v", "2024-01-01 10:20:00", "2024-01-01 10:36:00"), ("v", "2024-01-01 10:35:00", "2024-01-01 10:45:00")],
                                  "v string, a string, b string").withColumns({c: F.to_timestamp(c) for c in "ab"})
    out = intervals.minute_slots(trips, ["v"], "a", "b").orderBy("slot_start").collect()
    assert [(r.slot_start.minute, r.minutes, r.M1, r.M6, r.M15) for r in out] == [(15, 10, 0, 1, 1), (30, 15, 1, 1, 1)]


def test_capped_sessions_golden(spark, rows):
    times = ["23:55", "00:10", "00:20", "00:40", "00:50", "01:10", "01:30", "01:50", "02:10", "02:25"]
    data = [("u", f"2021-12-31 {t}:00" if t == "23:55" else f"2022-01-01 {t}:00") for t in times] + [("w", "2022-01-01 09:00:00")]
    df = spark.createDataFrame(data, "u string, t string").withColumn("t", F.to_timestamp("t"))
    out = intervals.capped_sessions(df, "u", "t")
    assert rows(out.select("u", F.date_format("session_start", "HH:mm"), F.date_format("session_end", "HH:mm"), "status")) == [
        ("u", "01:56", "02:25", "Valid"), ("u", "23:55", "01:55", "Valid"), ("w", "09:00", None, "Broken")]


def test_capped_sessions_equal_the_walk(spark, rows):
    def walk(minutes, gap=45, cap=120):
        out, start, last = [], minutes[0], minutes[0]
        for t in minutes[1:]:
            if t - last > gap:
                out.append((start, None if last == start else last))
                start = t
            elif t - start > cap:
                out.append((start, start + cap))
                start += cap + 1
            last = t
        return out + [(start, None if last == start else last)]

    data, expected = [], []
    for u in range(6):
        at, minutes = 1000, []
        for i in range(60):
            at += (i * i * 7 + u * 13) % 61
            minutes.append(at)
        minutes = sorted(set(minutes))
        data += [(u, x * 60) for x in minutes]
        expected += [(u, a * 60, None if b is None else b * 60) for a, b in walk(minutes)]
    df = spark.createDataFrame(data, "u int, s long").withColumn("t", F.timestamp_seconds("s"))
    out = intervals.capped_sessions(df, "u", "t").select("u", F.unix_timestamp("session_start"), F.unix_timestamp("session_end"))
    assert rows(out) == sorted(expected, key=repr)


def test_business_days(spark):
    df = dates_frame(spark, [("2021-12-24", "2022-01-04"), ("2022-01-04", "2022-01-04")], "a string, b string", "a", "b")
    off = F.array(*[F.lit(d).cast("date") for d in ("2021-12-25", "2022-01-03", "2022-01-03")])
    out = df.select(intervals.day_counts(F.col("a"), F.col("b"), off).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in out] == [(6, 4, 1), (0, 0, 0)]


def test_ranges_across_years(spark, rows):
    data = [(1, "2019-12-20", "2020-01-10"), (1, "2020-01-05", "2020-01-20"), (1, "2020-01-21", "2020-02-01"), (1, "2020-03-01", "2020-03-05"),
            (1, "2019-12-25", "2019-12-26")]
    df = dates_frame(spark, data, "id int, s string, e string", "s", "e")
    out = intervals.merge_overlapping(df, ["id"], "s", "e").select(F.col("s").cast("string"), F.col("e").cast("string"), "ranges")
    assert rows(out) == [("2019-12-20", "2020-02-01", 4), ("2020-03-01", "2020-03-05", 1)]
    periods = intervals.months_between_dates(df.where("s = '2019-12-20'"), "s", "e").select("period")
    assert rows(periods) == [("201912",), ("202001",)]
    marked = intervals.mark_continuous(dates_frame(spark, [(1, "2022-01-03", "2022-01-07"), (1, "2022-01-10", "2022-01-11"), (1, "2022-01-12", "2022-01-13")],
                                                   "id int, s string, e string", "s", "e"), ["id"], "s", "e", over_weekend=True)
    assert [r.continuous for r in marked.orderBy("s").collect()] == [True, True, False]


BASE = [("suzuki", "Baleno", "2016-10-05"), ("honda", "Jazz", "2013-10-05"), ("ford", "figo", "2012-10-01")]


def test_scd2_batches(spark, rows):
    schema = "make string, model string, s string, e string"
    def frame(data):
        return dates_frame(spark, data, schema, "s", "e")
    hist = frame([(a, b, c, None) for a, b, c in BASE])
    for batch in ([("honda", "Jazz", "2016-10-05", None)], [("honda", "Jazz", None, "2022-01-21"), ("ford", "figo", "2014-10-01", None)],
                  [("honda", "Jazz", "2023-01-01", None)]):
        hist = scd.scd2_close_open(hist, frame(batch), ["make", "model"], "s", "e")
    out = hist.where("make <> 'suzuki'").select("make", F.col("s").cast("string"), F.col("e").cast("string"))
    assert rows(out) == [("ford", "2012-10-01", "2014-09-30"), ("ford", "2014-10-01", None), ("honda", "2013-10-05", "2016-10-04"),
                         ("honda", "2016-10-05", "2022-01-21"), ("honda", "2023-01-01", None)]


def test_load_dated_cases(spark, rows):
    schema = "k int, s string, e string"
    stored = dates_frame(spark, [(1, "2020-01-01", None), (2, "2020-01-01", "2020-02-01"), (3, "2020-01-01", "2020-03-01"),
                                 (4, "2020-01-01", "2020-06-01"), (6, "2020-05-01", None), (7, "2020-01-01", "2021-01-01")], schema, "s", "e")
    batch = dates_frame(spark, [(k, "2020-03-01", "2020-12-31") for k in (1, 2, 3, 4, 5, 6, 7)], schema, "s", "e")
    out = scd.load_dated(stored, batch, ["k"], "s", "e").select("k", F.col("s").cast("string"), F.col("e").cast("string"))
    assert [r for r in rows(out) if r[0] in (1, 3, 4, 5)] == [
        (1, "2020-01-01", "2020-02-29"), (1, "2020-03-01", "2020-12-31"), (3, "2020-01-01", "2020-03-01"), (3, "2020-03-02", "2020-12-31"),
        (4, "2020-01-01", "2020-06-01"), (4, "2020-06-02", "2020-12-31"), (5, "2020-03-01", "2020-12-31")]
    assert [r[0] for r in rows(out)].count(6) == 1 and [r[0] for r in rows(out)].count(7) == 1


def test_merge_rules(spark, rows):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (3, "z"), (9, "n")], "k int, v string")
    out = m.merge(t, s, ["k"], [m.delete(F.col("t.v").isNull()), m.update()], [m.insert()])
    assert rows(out) == [(1, "x"), (2, "b"), (9, "n")]
    with pytest.raises(ValueError):
        m.merge(t, s.union(s), ["k"], [m.update()])
    assert rows(m.update_where(t, F.col("v") == "a", {"v": F.lit("A")})) == [(1, "A"), (2, "b"), (3, None)]
    assert rows(m.delete_where(t, F.col("v") == "a")) == [(2, "b"), (3, None)]


def test_staged_merge_counts(spark):
    base = spark.range(8).select(F.col("id").alias("k"), F.lit("v").alias("v"), F.lit("2020-01-01").cast("date").alias("s"),
                                 F.lit(None).cast("date").alias("e"), F.lit(True).alias("on"))
    batch = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "x")], "k long, v string")
    out = scd.scd2_staged_merge(base, batch, "k", "s", "e", "on", F.lit("2021-01-01").cast("date"))
    assert out.count() == 12 and out.where("on").count() == 8


@pytest.fixture
def deep(spark):
    schema = "k int, a array<struct<id:int,b:array<struct<n:int,tags:array<string>>>>>, s struct<X:int,t:array<array<int>>>"
    return spark.createDataFrame([(1, [(1, [(5, ["p", "q"]), (6, [])]), (2, None)], (7, [[1, 2], [3]])), (2, None, None)], schema)


def test_nested_edits(deep):
    out = nested.add_nested(deep, "a.b.m", lambda get: get("a.b.n") * 10 + get("a.id") + get("k"))
    assert [b.m for b in out.where("k = 1").first().a[0].b] == [52, 62]
    with pytest.raises(ValueError):
        nested.add_nested(deep, "a.b.n", F.lit(1))
    assert nested.map_nested(deep, "a.b.tags", "tags", F.upper).first().a[0].b[0].tags == ["P", "Q"]
    assert nested.map_nested(deep, "S.t", "t", lambda x: x + 1).first().s.t == [[2, 3], [4]]
    assert "n:int" not in nested.drop_nested(deep, "A.B.N").schema["a"].simpleString()
    assert nested.drop_nested(deep, "k").columns == ["a", "s"]
    assert nested.add_nested(deep, "z", F.lit(1)).columns[-1] == "z"
    assert out.where("k = 2").first().a is None
    pair = nested.map_nested_struct(deep, "s.*", "twice", lambda st: st["X"] * 2)
    assert pair.first().s.twice == 14


def test_nested_errors(deep):
    out = nested.map_with_errors(deep, "a.b.n", "ok", lambda x: x, lambda x: F.when(x > 5, F.concat(F.lit("big "), x.cast("string"))))
    first = out.orderBy("k").collect()
    assert first[0].errors == ["big 6"] and first[1].errors == []
    again = nested.map_with_errors(out, "a.id", "id2", lambda x: x, lambda x: F.when(x > 1, F.lit("big 6")), errors="errors")
    assert again.orderBy("k").first().errors == ["big 6"]
    assert "_errors" not in again.schema.simpleString()


def test_flatten(deep):
    assert nested.flatten_structs(deep).columns == ["k", "a", "s_X", "s_t"]
    flat = nested.deep_flatten(deep.drop("s"))
    assert flat.columns == ["k", "a_id", "a_b_n", "a_b_tags"] and flat.count() == 4


def test_text_and_date_rules(spark):
    row = spark.createDataFrame([("a#one b#two", "my_first name", "2020-12-31")], "t string, c string, d string").select(
        text.tags("t").alias("tags"), text.camel_case("c").alias("camel"), text.occurrences("t", "o").alias("n"), text.nth_index("t", "o", 2).alias("i"),
        text.nth_index("t", "o", 9).alias("none"), dates.next_julian_day(F.lit("2020366")).alias("j"), dates.is_leap_year(F.lit(1900)).alias("leap"),
        dates.parse_either(F.lit("31-12-2020"), "yyyy-MM-dd", "dd-MM-yyyy").cast("string").alias("p"),
        dates.expires_at(F.col("d").cast("timestamp"), "2 months").cast("string").alias("x")).first()
    assert row.tags == ["one", "two"] and row.camel == "myFirstName" and (row.n, row.i, row.none) == (2, 11, 0)
    assert (row.j, row.leap, row.p, row.x) == ("2021001", False, "2020-12-31 00:00:00", "2021-02-28 00:00:00")
    grams = spark.createDataFrame([(["a", "b", "c"],), (["x"],)], "w array<string>").select(text.ngrams(F.col("w"), 2).alias("g")).collect()
    assert [r.g for r in grams] == [["a b", "b c"], []]


def test_grades(spark):
    values = [100, 95, 90, 70.5, 60, 50.5, 50, 45, 44, 0]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    def letters(kind):
        return [r[0] for r in df.select(rules.grade(F.col("v"), F.lit(100.0), kind)).collect()]
    assert letters("CA") == ["A+", "A", "B+", "C", "E+", "E+", "E", "E", "F", "F"]
    assert letters("SA") == ["A+", "A", "B+", "C", "E", "E", "E", "F", "F", "F"]
    assert letters("final") == ["A+", "A", "B+", "D", "E", "F", "F", "F", "F", "F-"]


def test_small_helpers(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert rows(latest(df, ["k"], ["v"])) == [("a", 3), ("b", 2)]
    assert rows(nth_distinct(df, ["k"], "v", 2)) == [("a", 1), ("a", 1)]
    assert rows(relational.top_values(df, ["k"], "v")) == [("a", 2, 1), ("b", 1, 2)]
    dup = relational.duplicate_key_join_counts(spark.createDataFrame([(1,), (1,), (0,), (0,), (0,)], "c int"),
                                               spark.createDataFrame([(1,), (1,), (1,), (0,), (0,), (0,), (0,)], "c int"), "c")
    assert rows(dup) == [(0, 3, 4, 12), (1, 2, 3, 6)]
    assert relational.small_enough(df, 4) and not relational.small_enough(df, 3)
