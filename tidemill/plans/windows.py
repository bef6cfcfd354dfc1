"""Window, sort and set queries."""

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.operators import relational
from tidemill.operators.ordered import OrderedGroups, beside, latest, nth_distinct, ranks, top_n
from tidemill.plans.registry import query
from tidemill.session import materialise


@query("win_01_ranks", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(rank() OVER w AS INTEGER) AS rnk, CAST(dense_rank() OVER w AS INTEGER) AS dense,
  round(percent_rank() OVER w, 9) AS pct FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)""")
def group_ranks(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    out = ranks(lines, ["l_returnflag"], ["-l_quantity"], rank="rnk", dense_rank="dense", percent_rank="pct")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rnk", "dense", F.round("pct", 9).alias("pct"))


@query("win_02_global_ranks", """
SELECT p_partkey, CAST(rank() OVER w AS INTEGER) AS rnk, CAST(dense_rank() OVER w AS INTEGER) AS dense, round(percent_rank() OVER w, 9) AS pct
FROM part WINDOW w AS (ORDER BY p_size, p_brand)""")
def global_ranks(t):
    parts = t.part.select("p_partkey", "p_size", "p_brand")
    out = ranks(parts, [], ["p_size", "p_brand"], rank="rnk", dense_rank="dense", percent_rank="pct")
    return out.select("p_partkey", "rnk", "dense", F.round("pct", 9).alias("pct"))


@query("win_03_latest_per_key", """
SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(t):
    last = latest(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", "event_id", "event_type", dates.second_text("ts").alias("at"))


@query("win_04_nth_highest", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 3""")
def nth_highest(t):
    return nth_distinct(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3)


@query("win_04_second_or_only", """
WITH d AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC) AS r FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)),
m AS (SELECT p_brand, p_type, max(r) AS ranks FROM d GROUP BY 1, 2)
SELECT d.p_brand, d.p_type, d.p_size, ranks = 1 AS only_one FROM d JOIN m USING (p_brand, p_type) WHERE r = least(ranks, 2)""")
def second_or_only(t):
    """Second highest distinct value per group; a group with one value gives that value and a flag."""
    top = top_n(t.part.select("p_brand", "p_type", "p_size").distinct(), ["p_brand", "p_type"], ["-p_size"], 2, "r")
    best = top.groupBy("p_brand", "p_type").agg(F.max_by("p_size", "r").alias("p_size"), (F.max("r") == 1).alias("only_one"))
    return best


@query("win_05_lead_lag", """
SELECT event_id, coalesce(lag(event_id, 1) OVER w, 0) AS before, coalesce(lead(event_id, 1) OVER w, 0) AS after, coalesce(lead(event_id, 3) OVER w, -1) AS third
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def lead_lag(t):
    rows = OrderedGroups(t.events.select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"])
    out = (rows.lag("before", "event_id", 1, 0).lead("after", "event_id", 1, 0).lead("third", "event_id", 3, -1)).frame
    return out.select("event_id", "before", "after", "third")


@query("win_06_cume_dist", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(cume_dist() OVER (PARTITION BY l_linestatus ORDER BY l_quantity), 9) AS cd FROM lineitem""")
def cume_dist(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    out = ranks(lines, ["l_linestatus"], ["l_quantity"], cume_dist="cd")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("cd", 9).alias("cd"))


@query("win_07_aggregate_beside_row", """
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS n, max(o_totalprice) OVER w AS biggest
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def aggregate_beside_row(t):
    out = beside(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"],
                 total=F.round(F.sum("o_totalprice"), 2), n=F.count(F.lit(1)), biggest=F.max("o_totalprice"))
    return out.select("o_orderkey", "total", "n", "biggest")


@query("win_08_running_total", """
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS upto,
 round(sum(value) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING), 4) AS onwards FROM events""")
def running_total(t):
    rows = OrderedGroups(t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"])
    rows = rows.running_sum("upto", "value").running_sum("before", "value", exclusive=True)
    out = beside(rows.frame, ["event_type"], all=F.sum("value"))
    return out.select("event_id", F.round("upto", 4).alias("upto"), F.round(F.col("all") - F.col("before"), 4).alias("onwards"))


@query("win_09_sliding_rows", """
SELECT event_id, round(avg(value) OVER (w ROWS 1 PRECEDING), 6) AS avg2, round(avg(value) OVER (w ROWS 6 PRECEDING), 6) AS avg7,
 round(avg(value) OVER (w ROWS 20 PRECEDING), 6) AS avg21 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def sliding_rows(t):
    rows = OrderedGroups(t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"])
    for n in (2, 7, 21):
        rows = rows.sliding({f"avg{n}": F.avg("value")}, n - 1)
    return rows.frame.select("event_id", *[F.round(f"avg{n}", 6).alias(f"avg{n}") for n in (2, 7, 21)])


@query("win_10_value_range", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING), 2) AS near_total
FROM lineitem""")
def value_range(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = relational.value_range_sum(lines, ["l_suppkey"], "l_quantity", 10, "near_total")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("near_total", 2).alias("near_total"))


@query("win_11_top_per_hour", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, event_id) = 1""")
def top_per_hour(t):
    rows = t.events.select(F.date_trunc("hour", "ts").alias("h"), "event_id", "value")
    return top_n(rows, ["h"], ["-value", "event_id"], 1).select(dates.second_text("h").alias("hour"), "event_id", "value")


@query("win_12_first_to_reach", """
WITH p AS (SELECT user_id, count_if(event_type = 'purchase') AS points, max(CASE WHEN event_type = 'purchase' THEN ts END) AS reached FROM events GROUP BY 1)
SELECT user_id, points, CAST(rank() OVER (ORDER BY points DESC, reached) AS INTEGER) AS place FROM p""")
def first_to_reach(t):
    bought = F.col("event_type") == "purchase"
    scores = t.events.groupBy("user_id").agg(F.count_if(bought).alias("points"), F.max(F.when(bought, F.col("ts"))).alias("reached"))
    scores = scores.withColumn("reached", F.coalesce("reached", F.lit("9999-12-31").cast("timestamp_ntz")))
    return ranks(materialise(scores), [], ["-points", "reached"], rank="place").select("user_id", "points", "place")


@query("win_13_standings", """
WITH s AS (SELECT o_custkey AS driver, sum(CASE WHEN o_totalprice > 400000 THEN 25 WHEN o_totalprice > 350000 THEN 18 ELSE 0 END)::BIGINT AS points,
                  sum(o_orderkey % 20 + 1) / count(*) AS avg_pos FROM orders GROUP BY 1)
SELECT driver, points, round(avg_pos, 6) AS avg_pos, row_number() OVER (ORDER BY CASE WHEN points = 0 THEN 1 ELSE 0 END, points DESC, avg_pos, driver) AS standing FROM s""")
def standings(t):
    """Scorers by points then mean position; zero scorers after all of them, by mean position."""
    points = F.when(F.col("o_totalprice") > 400000, 25).when(F.col("o_totalprice") > 350000, 18).otherwise(0)
    totals = t.orders.groupBy(F.col("o_custkey").alias("driver")).agg(
        F.sum(points).alias("points"), (F.sum(F.col("o_orderkey") % 20 + 1) / F.count(F.lit(1))).alias("avg_pos"))
    totals = totals.withColumn("zero", F.when(F.col("points") == 0, 1).otherwise(0))
    placed = OrderedGroups(materialise(totals), [], ["zero", "-points", "avg_pos", "driver"]).row_number("standing").frame
    return placed.select("driver", "points", F.round("avg_pos", 6).alias("avg_pos"), F.col("standing").cast("bigint").alias("standing"))


@query("win_14_windowed_speed", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_extendedprice) OVER w / (sum(l_quantity) OVER w / 3600), 4) AS speed
FROM lineitem WINDOW w AS (PARTITION BY l_partkey)""")
def windowed_speed(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    out = beside(lines, ["l_partkey"], speed=F.sum("l_extendedprice") / (F.sum("l_quantity") / 3600))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("speed", 4).alias("speed"))


@query("win_15_latest_run", """
SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_run(t):
    events = t.events.withColumn("run_date", F.to_date("ts"))
    last = events.agg(F.max("run_date").alias("run_date"))
    return events.join(F.broadcast(last), "run_date", "left_semi").select("event_id", "event_type")


# -- sorting and sets -----------------------------------------------------------------------

@query("set_01_mixed_sort", """
SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey""")
def mixed_sort(t):
    return t.part.select("p_partkey", "p_brand", "p_size").orderBy("p_brand", F.desc("p_size"), "p_partkey")


@query("set_02_computed_sort", """
SELECT p_partkey, p_name FROM part ORDER BY length(p_name), p_partkey""")
def computed_sort(t):
    return t.part.select("p_partkey", "p_name").orderBy(F.length("p_name"), "p_partkey")


@query("set_03_null_placement", """
SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY labels.quality NULLS FIRST, doc_id""")
def null_placement(t):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.col("quality").asc_nulls_first(), "doc_id").na.fill({"quality": -1})


@query("set_04_unions", """
SELECT 'all' AS how, k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'distinct', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def unions(t):
    both = t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))
    return both.withColumn("how", F.lit("all")).unionByName(both.distinct().withColumn("how", F.lit("distinct")))


@query("set_05_intersect_except", """
SELECT 'intersect' AS how, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'except_all', k FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def intersect_except(t):
    def keys(status):
        return t.orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    customers = t.customer.select(F.col("c_custkey").alias("k"))
    parts = {"intersect": keys("F").intersect(keys("O")), "except": customers.subtract(keys("P")),
             "except_all": relational.missing_rows(t.orders.select(F.col("o_custkey").alias("k")), keys("F"))}
    named = [df.withColumn("how", F.lit(name)) for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("set_06_distinct", """
SELECT event_type, count(*) AS users FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1""")
def distinct(t):
    return t.events.dropDuplicates(["event_type", "user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


@query("set_07_keep_first_or_last", """
SELECT a.user_id, first_id, last_id FROM
 (SELECT user_id, event_id AS first_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1) a
 JOIN (SELECT user_id, event_id AS last_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1) b USING (user_id)""")
def keep_first_or_last(t):
    rows = t.events.select("user_id", "value", "event_id")
    first = latest(rows, ["user_id"], ["value", "event_id"], newest=False).select("user_id", F.col("event_id").alias("first_id"))
    last = latest(rows, ["user_id"], ["value", "event_id"]).select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")


@query("set_09_top_k", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20""")
def top_k(t):
    return (t.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20)
            .select("l_orderkey", "l_linenumber", "l_extendedprice"))
