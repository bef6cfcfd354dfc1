"""Slot, session, range and calendar queries."""

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.operators import intervals
from tidemill.plans.registry import query

# Example holidays.
HOLIDAYS = ["1996-01-01", "1996-12-25", "1997-01-01", "1997-07-04", "1997-12-25", "1998-01-01", "1998-12-25",
            "1999-01-01", "1999-12-25", "2000-01-01", "2000-12-25"]
_HOLIDAY_SQL = "(VALUES " + ", ".join(f"(DATE '{h}')" for h in HOLIDAYS) + ") h(d)"


def holidays():
    return F.array(*[F.lit(h).cast("date") for h in HOLIDAYS])


def order_ranges(t, days="o_orderkey % 40 + 5"):
    """Per customer ranges starting on the order date, their length derived from the key."""
    start = F.to_date("o_orderdate")
    return t.orders.select("o_custkey", "o_orderkey", start.alias("s"), F.date_add(start, F.expr(f"cast({days} as int)")).alias("e"))


@query("int_01_minute_slots", """
WITH trips AS (SELECT user_id, date_trunc('minute', ts) AS a, date_trunc('minute', ts) + (event_id % 50 + 1) * INTERVAL 1 MINUTE AS b FROM events),
m AS (SELECT DISTINCT user_id, unnest(generate_series(a, b - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS mi FROM trips),
f AS (SELECT user_id, mi - (minute(mi) % 15) * INTERVAL 1 MINUTE AS slot, minute(mi) % 15 + 1 AS k FROM m)
SELECT user_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS "M1", max(CASE WHEN k = 8 THEN 1 ELSE 0 END) AS "M8",
  max(CASE WHEN k = 15 THEN 1 ELSE 0 END) AS "M15", CAST(count(*) AS INTEGER) AS minutes FROM f GROUP BY user_id, slot""")
def minute_slots(t):
    trips = t.events.select("user_id", F.col("ts").alias("a"),
                            (F.date_trunc("minute", "ts") + F.make_dt_interval(mins=(F.col("event_id") % 50 + 1).cast("int"))).alias("b"))
    slots = intervals.minute_slots(trips, ["user_id"], "a", "b")
    return slots.select("user_id", dates.second_text("slot_start").alias("slot"), "M1", "M8", "M15", "minutes")


@query("int_02_gap_sessions", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 45::BIGINT * 60000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(sid AS BIGINT) AS session_no, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM s GROUP BY 1, 2""")
def gap_sessions(t):
    rows = intervals.gap_sessions(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 45)
    return rows.groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("events"), dates.second_text(F.min("ts")).alias("started"), dates.second_text(F.max("ts")).alias("ended"))


@query("int_02_capped_sessions", """
WITH RECURSIVE m AS (SELECT DISTINCT event_type AS k, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM events),
o AS (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY m) AS rn FROM m),
walk AS (SELECT k, rn, m AS last, m AS start, CAST(NULL AS BIGINT) AS out_start, CAST(NULL AS BIGINT) AS out_end FROM o WHERE rn = 1
 UNION ALL SELECT o.k, o.rn, o.m,
   CASE WHEN o.m - w.last > 45 THEN o.m WHEN o.m - w.start > 120 THEN w.start + 121 ELSE w.start END,
   CASE WHEN o.m - w.last > 45 OR o.m - w.start > 120 THEN w.start END,
   CASE WHEN o.m - w.last > 45 THEN CASE WHEN w.last = w.start THEN NULL ELSE w.last END WHEN o.m - w.start > 120 THEN w.start + 120 END
 FROM walk w JOIN o ON o.k = w.k AND o.rn = w.rn + 1),
fin AS (SELECT k, out_start AS a, out_end AS b FROM walk WHERE out_start IS NOT NULL
 UNION ALL SELECT k, start, CASE WHEN last = start THEN NULL ELSE last END FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY rn DESC) = 1)
SELECT k, strftime(make_timestamp(a * 60000000), '%Y-%m-%d %H:%M:%S') AS session_start,
  coalesce(strftime(make_timestamp(b * 60000000), '%Y-%m-%d %H:%M:%S'), '-') AS session_end, CASE WHEN b IS NULL THEN 'Broken' ELSE 'Valid' END AS status FROM fin""")
def capped_sessions(t):
    rows = intervals.capped_sessions(t.events.select(F.col("event_type").alias("k"), "ts"), "k", "ts", 45, 120)
    return rows.select("k", dates.second_text("session_start").alias("session_start"),
                       F.coalesce(dates.second_text("session_end"), F.lit("-")).alias("session_end"), "status")


@query("int_03_session_minutes", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 720::BIGINT * 60000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
a AS (SELECT user_id, sid, floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60) AS mins FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, CAST(sum(mins) AS BIGINT) AS total_minutes, CAST(max(mins) AS BIGINT) AS longest FROM a GROUP BY 1""")
def session_minutes(t):
    rows = intervals.gap_sessions(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 720)
    spans = rows.groupBy("user_id", "session_no").agg(dates.minutes_between(F.min("ts"), F.max("ts")).alias("mins"))
    return spans.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("mins").alias("total_minutes"), F.max("mins").alias("longest"))


@query("int_04_merge_adjacent", """
WITH r AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, CAST(ts AS DATE) AS s, CAST(ts AS DATE) AS e FROM events),
f AS (SELECT *, CASE WHEN lag(e) OVER w + 1 = s THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, strftime(min(s), '%Y-%m-%d') AS s, strftime(max(e), '%Y-%m-%d') AS e FROM i GROUP BY user_id, island""")
def merge_adjacent(t):
    days = t.events.select("user_id", F.to_date("ts").alias("s"), F.to_date("ts").alias("e"))
    merged = intervals.merge_adjacent(days, ["user_id"], "s", "e")
    return merged.select("user_id", dates.day_text("s").alias("s"), dates.day_text("e").alias("e"))


_ISLANDS = """
f AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL {step} >= s THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
"""


@query("int_05_merge_overlapping", """
WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 + 5 AS INTEGER) AS e FROM orders),"""
       + _ISLANDS.format(k="o_custkey", step="1 DAY") +
       "SELECT o_custkey, strftime(min(s), '%Y-%m-%d') AS s, strftime(max(e), '%Y-%m-%d') AS e, count(*) AS ranges FROM i GROUP BY o_custkey, island")
def merge_overlapping(t):
    merged = intervals.merge_overlapping(order_ranges(t), ["o_custkey"], "s", "e")
    return merged.select("o_custkey", dates.day_text("s").alias("s"), dates.day_text("e").alias("e"), "ranges")


@query("int_06_mark_continuous", """
WITH r AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS s FROM events)
SELECT user_id, strftime(s, '%Y-%m-%d') AS s, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s) = s + 1, false) AS continuous FROM r""")
def mark_continuous(t):
    days = t.events.select("user_id", F.to_date("ts").alias("s")).distinct().withColumn("e", F.col("s"))
    marked = intervals.mark_continuous(days, ["user_id"], "s", "e")
    return marked.select("user_id", dates.day_text("s").alias("s"), "continuous")


@query("int_07_continuous_over_weekend", """
WITH r AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS s FROM events WHERE isodow(ts) < 6)
SELECT user_id, strftime(s, '%Y-%m-%d') AS s, coalesce(lead(s) OVER w = s + 1 OR (isodow(s) = 5 AND lead(s) OVER w = s + 3), false) AS continuous
FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s)""")
def continuous_over_weekend(t):
    days = t.events.where(F.weekday("ts") < 5).select("user_id", F.to_date("ts").alias("s")).distinct().withColumn("e", F.col("s"))
    marked = intervals.mark_continuous(days, ["user_id"], "s", "e", over_weekend=True)
    return marked.select("user_id", dates.day_text("s").alias("s"), "continuous")


_DAY_COUNTS = f"""
SELECT o_orderkey, CAST(count_if(isodow(d) < 6 AND h.d IS NULL) AS INTEGER) AS valid_days, CAST(count_if(isodow(x.d) >= 6) AS INTEGER) AS weekend_days,
  CAST(count_if(isodow(x.d) < 6 AND h.d IS NOT NULL) AS INTEGER) AS holiday_days
FROM (SELECT o_orderkey, CAST(unnest(generate_series(o_orderdate, o_orderdate + (o_orderkey % 40 + 4) * INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM orders) x
LEFT JOIN {_HOLIDAY_SQL} ON x.d = h.d GROUP BY o_orderkey""".replace("isodow(d)", "isodow(x.d)")


@query("int_08_business_days", _DAY_COUNTS)
def business_days(t):
    counts = intervals.day_counts(F.col("s"), F.col("e"), holidays())
    return order_ranges(t).select("o_orderkey", counts.alias("c")).select("o_orderkey", "c.*")


@query("int_09_bonus", f"""
WITH d AS ({_DAY_COUNTS}),
r AS (SELECT o.o_custkey, o.o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o.o_orderkey % 40 + 5 AS INTEGER) AS e, valid_days FROM orders o JOIN d USING (o_orderkey)),
x AS (SELECT a.o_orderkey, a.s, b.e AS e2 FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.s > a.s AND b.s < a.e AND b.e > a.e WHERE a.valid_days > 5),
m AS (SELECT o_orderkey, min(s) AS s, max(e2) AS e FROM x GROUP BY 1),
c AS (SELECT o_orderkey, count_if(isodow(y.d) < 6 AND h.d IS NULL) AS valid FROM (SELECT o_orderkey, CAST(unnest(generate_series(s::TIMESTAMP, e - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM m) y LEFT JOIN {_HOLIDAY_SQL} ON y.d = h.d GROUP BY 1)
SELECT o_orderkey, CAST(valid AS INTEGER) AS valid_days, CASE WHEN valid > 30 THEN 'gold' WHEN valid > 20 THEN 'silver' ELSE 'bronze' END AS bonus FROM c""")
def bonus(t):
    """Ranges with more than five valid days, extended to the furthest end of an overlapping later range."""
    ranges = order_ranges(t)
    counted = ranges.withColumn("valid", intervals.day_counts(F.col("s"), F.col("e"), holidays())["valid_days"])
    refs = ranges.select("o_custkey", F.col("s").alias("rs"), F.col("e").alias("re"))
    hits = intervals.range_join(counted.where("valid > 5"), refs, ["o_custkey"], "s", "e", "rs").where("re > e")
    longest = hits.groupBy("o_orderkey").agg(F.min("s").alias("s"), F.max("re").alias("e"))
    valid = intervals.day_counts(F.col("s"), F.col("e"), holidays())["valid_days"]
    longest = longest.withColumn("valid_days", valid)
    band = F.when(F.col("valid_days") > 30, "gold").when(F.col("valid_days") > 20, "silver").otherwise("bronze")
    return longest.select("o_orderkey", "valid_days", band.alias("bonus"))


@query("int_10_months", """
WITH r AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + (o_orderkey % 200 + 5) * INTERVAL 1 DAY AS e FROM orders)
SELECT o_orderkey, strftime(unnest(generate_series(date_trunc('month', s)::TIMESTAMP, date_trunc('month', e)::TIMESTAMP, INTERVAL 1 MONTH)), '%Y%m') AS period FROM r""")
def months(t):
    return intervals.months_between_dates(order_ranges(t, "o_orderkey % 200 + 5"), "s", "e").select("o_orderkey", "period")


@query("int_11_durations", """
SELECT l_suppkey, CAST(max(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS longest, round(avg(date_diff('day', o_orderdate, l_shipdate)), 6) AS mean
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def durations(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    return joined.groupBy("l_suppkey").agg(F.max(days).alias("longest"), F.round(F.avg(days), 6).alias("mean"))


@query("int_12_viewing_intervals", """
WITH r AS (SELECT user_id, event_type, event_id % 3 AS show_id, ts AS s, ts + (event_id % 90 + 30) * INTERVAL 1 MINUTE AS e FROM events),"""
       + _ISLANDS.format(k="user_id, event_type, show_id", step="0 SECOND") +
       """SELECT user_id, event_type, show_id, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS s, strftime(max(e), '%Y-%m-%d %H:%M:%S') AS e, count(*) AS ranges
FROM i GROUP BY user_id, event_type, show_id, island""")
def viewing_intervals(t):
    views = t.events.select("user_id", "event_type", (F.col("event_id") % 3).alias("show_id"), F.col("ts").alias("s"),
                            (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90 + 30).cast("int"))).alias("e"))
    merged = intervals.merge_overlapping(views, ["user_id", "event_type", "show_id"], "s", "e", F.expr("interval 0 seconds"))
    return merged.select("user_id", "event_type", "show_id", dates.second_text("s").alias("s"), dates.second_text("e").alias("e"), "ranges")


@query("int_13_consecutive_runs", """
WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM d)
SELECT l_suppkey, min(l_partkey) AS run_start, max(l_partkey) AS run_end, count(*) AS run_length FROM n GROUP BY l_suppkey, g""")
def consecutive_runs(t):
    return intervals.consecutive_runs(t.lineitem, ["l_suppkey"], "l_partkey")


@query("int_14_inactive", """
SELECT c_custkey, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), 'never') AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey HAVING max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY""")
def inactive(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    joined = t.customer.select("c_custkey").join(last, "c_custkey", "left")
    limit = F.expr("timestamp_ntz '2001-08-01' - interval 90 days")
    idle = joined.where(F.col("last").isNull() | (F.col("last") < limit))
    return idle.select("c_custkey", F.coalesce(dates.day_text("last"), F.lit("never")).alias("last_order"))
