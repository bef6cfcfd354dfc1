"""As-of reads, rewrites, upserts, slowly changing dimensions and merges."""

import uuid

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.operators import merge as m
from tidemill.operators import relational, scd
from tidemill.operators.ordered import latest
from tidemill.plans.registry import query
from tidemill.session import shared_folder
from tidemill.sources import redo, writers


def order_changes(t):
    """Orders read as an append-only change feed per customer: finished orders delete the entry."""
    op = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert")
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", op.alias("op"))


_STATE = """(SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderdate <= TIMESTAMP '{at}') WHERE rn = 1 AND o_orderstatus <> 'F')"""


def state(t, at):
    rows = m.as_of(order_changes(t), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.lit(at).cast("timestamp_ntz"))
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query("src_08_as_of", "SELECT * FROM " + _STATE.format(at="1998-06-30"))
def as_of(t):
    return state(t, "1998-06-30")


@query("src_08_changed_between", "SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'insert' WHEN b.o_custkey IS NULL THEN 'delete' ELSE 'update' END AS change FROM "
       + _STATE.format(at="1998-06-30") + " a FULL JOIN " + _STATE.format(at="1998-12-31") + """ b ON a.o_custkey = b.o_custkey
WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.o_orderkey <> b.o_orderkey""")
def changed_between(t):
    return m.changed_between(state(t, "1998-06-30"), state(t, "1998-12-31"), ["o_custkey"], ["o_orderkey"])


@query("snk_07_replace_where", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2000-01-01')
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F'""")
def replace_where(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    late = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    new = rows.where(F.col("l_linestatus") == "F").withColumn("l_quantity", F.col("l_quantity") * 2)
    return m.replace_where(rows, late, new.where(late)).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("snk_07_replace_matching_path", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity * CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS DOUBLE) AS l_quantity, l_returnflag FROM lineitem
WHERE l_returnflag <> 'R' OR l_linestatus = 'F'""")
def replace_matching_path(t):
    path = f"{shared_folder(t.spark).rstrip('/')}/replaced-{uuid.uuid4().hex}"
    writers.replace_partitions(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_returnflag"), path, ["l_returnflag"])
    returned = F.col("l_returnflag") == "R"
    new = redo.read_table(t.spark, path).where(returned & (F.col("l_linestatus") == "F")).withColumn("l_quantity", F.col("l_quantity") * 2)
    for _ in range(2):  # the second run finds the named change done
        writers.replace_matching(t.spark, path, returned, new, ["l_returnflag"], name="returned")
    return redo.read_table(t.spark, path).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("snk_10_append_evolving", """
SELECT c_custkey AS k, c_name AS name, -1.0::DOUBLE AS acctbal FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1""")
def append_evolving(t):
    old = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = t.customer.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"),
                                                       F.col("c_acctbal").alias("acctbal"))
    return m.append_evolving(old, new).na.fill({"acctbal": -1.0})


@query("snk_11_update_and_delete", """
SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS p_size, CASE WHEN p_size > 40 THEN 'capped ' || p_name ELSE p_name END AS p_name
FROM part WHERE p_brand <> 'Brand#13'""")
def update_and_delete(t):
    rows = t.part.select("p_partkey", "p_brand", "p_size", "p_name")
    rows = m.update_where(rows, F.col("p_size") > 40, {"p_size": F.lit(40), "p_name": F.concat(F.lit("capped "), "p_name")})
    return m.delete_where(rows, F.col("p_brand") == "Brand#13")


def customer_batch(t):
    """Every third customer moved to another segment, some with a null name, plus new keys."""
    fresh = F.col("c_custkey") % 7 == 0
    return t.customer.where("c_custkey % 3 = 0").select(
        F.when(fresh, F.col("c_custkey") + 1000000000).otherwise(F.col("c_custkey")).alias("c_custkey"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit("*"))).alias("c_name"),
        F.lit("MOVED").alias("c_mktsegment"))


_BATCH = """batch AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' END AS c_name, 'MOVED' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)"""


def stored_customers(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("ups_01_scd1", "WITH " + _BATCH + """
SELECT coalesce(b.c_custkey, c.c_custkey) AS c_custkey, coalesce(b.c_name, c.c_name, '-') AS c_name, coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c FULL JOIN batch b ON b.c_custkey = c.c_custkey""")
def scd1(t):
    return scd.scd1(stored_customers(t), customer_batch(t), ["c_custkey"]).na.fill({"c_name": "-"})


@query("ups_02_back_up_rows", "WITH " + _BATCH + """
SELECT c_custkey, c_name, c_mktsegment, '2024-01-01' AS backup_time, 7 AS batch_no FROM customer WHERE c_custkey IN (SELECT c_custkey FROM batch)""")
def back_up_rows(t):
    return scd.rows_to_back_up(stored_customers(t), customer_batch(t), ["c_custkey"], F.lit("2024-01-01"), 7)


def brand_history(t, later):
    """Price points of a part type and brand over time; the later ones form the batch."""
    cut = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    rows = t.lineitem.where(cut if later else ~cut)
    return rows.groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("s")).agg(F.max("l_extendedprice").alias("price"))


_HIST = """pts AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS s, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
hist AS (SELECT k, s, price, lead(s) OVER (PARTITION BY k ORDER BY s) - 1 AS e FROM pts WHERE s < DATE '1999-01-01'),
news AS (SELECT * FROM pts WHERE s >= DATE '1999-01-01')"""
_OUT = " SELECT k, strftime(s, '%Y-%m-%d') AS s, coalesce(strftime(e, '%Y-%m-%d'), 'open') AS e, price FROM "


def dated(df):
    return df.select("k", dates.day_text("s").alias("s"), F.coalesce(dates.day_text("e"), F.lit("open")).alias("e"), "price")


def history(t):
    return scd.effective_dates(brand_history(t, False), ["k"], "s", "e")


@query("ups_03_close_and_insert", "WITH " + _HIST + """,
one AS (SELECT k, max(s) AS s, arg_max(price, s) AS price FROM news GROUP BY 1),
r AS (SELECT h.k, h.s, h.price, coalesce(h.e, one.s - 1) AS e FROM hist h LEFT JOIN one ON h.k = one.k UNION ALL SELECT k, s, price, NULL FROM one)""" + _OUT + "r")
def close_and_insert(t):
    batch = latest(brand_history(t, True), ["k"], ["s"]).withColumn("e", F.lit(None).cast("date"))
    return dated(scd.scd2_close_open(history(t), batch, ["k"], "s", "e"))


@query("ups_04_by_lead", "WITH " + _HIST + ", r AS (SELECT k, s, price, lead(s) OVER (PARTITION BY k ORDER BY s) - 1 AS e FROM pts)" + _OUT + "r")
def by_lead(t):
    return dated(scd.scd2_by_lead(history(t), brand_history(t, True), ["k"], "s", "e"))


@query("ups_05_end_only_and_resume", "WITH " + _HIST + """,
one AS (SELECT k, CASE WHEN k % 2 = 0 THEN max(s) END AS s, CASE WHEN k % 2 = 1 THEN max(s) END AS e, arg_max(price, s) AS price FROM news GROUP BY k),
closed AS (SELECT h.k, h.s, h.price, coalesce(h.e, one.s - 1, one.e) AS e FROM hist h LEFT JOIN one ON h.k = one.k UNION ALL SELECT k, s, price, NULL FROM one WHERE s IS NOT NULL),
again AS (SELECT k, DATE '2003-01-01' AS s, 1.0::DOUBLE AS price FROM one WHERE k % 4 < 2),
r AS (SELECT c.k, c.s, c.price, coalesce(c.e, a.s - 1) AS e FROM closed c LEFT JOIN again a ON c.k = a.k UNION ALL SELECT k, s, price, NULL FROM again)""" + _OUT + "r")
def end_only_and_resume(t):
    last = latest(brand_history(t, True), ["k"], ["s"])
    even = F.col("k") % 2 == 0
    batch = last.select("k", F.when(even, F.col("s")).alias("s"), "price", F.when(~even, F.col("s")).alias("e"))
    starts = batch.where(even)
    ends = batch.where(~even)
    closed = scd.scd2_close_open(history(t), starts.unionByName(ends), ["k"], "s", "e")
    again = last.where("k % 4 < 2").select("k", F.lit("2003-01-01").cast("date").alias("s"), F.lit(1.0).alias("price"),
                                           F.lit(None).cast("date").alias("e"))
    return dated(scd.scd2_close_open(closed, again, ["k"], "s", "e"))


@query("ups_06_staged_merge", "WITH " + _BATCH + """,
st AS (SELECT c_custkey, c_name, c_mktsegment, DATE '2020-01-01' AS s, NULL::DATE AS e, true AS active FROM customer),
r AS (SELECT c_custkey, c_name, c_mktsegment, s, CASE WHEN c_custkey IN (SELECT c_custkey FROM batch) THEN DATE '2024-01-01' END AS e, c_custkey NOT IN (SELECT c_custkey FROM batch) AS active FROM st
  UNION ALL SELECT c_custkey, coalesce(c_name, '-'), c_mktsegment, DATE '2024-01-01', NULL, true FROM batch)
SELECT c_custkey, c_name, c_mktsegment, strftime(s, '%Y-%m-%d') AS s, coalesce(strftime(e, '%Y-%m-%d'), 'open') AS e, active FROM r""")
def staged_merge(t):
    stored = stored_customers(t).withColumns({"s": F.lit("2020-01-01").cast("date"), "e": F.lit(None).cast("date"), "active": F.lit(True)})
    batch = customer_batch(t).na.fill({"c_name": "-"})
    out = scd.scd2_staged_merge(stored, batch, "c_custkey", "s", "e", "active", F.lit("2024-01-01").cast("date"))
    return out.select("c_custkey", "c_name", "c_mktsegment", dates.day_text("s").alias("s"),
                      F.coalesce(dates.day_text("e"), F.lit("open")).alias("e"), "active")


@query("ups_07_scd3", "WITH " + _BATCH + """
SELECT coalesce(b.c_custkey, c.c_custkey) AS c_custkey, coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment,
 CASE WHEN b.c_custkey IS NOT NULL AND c.c_custkey IS NOT NULL THEN c.c_mktsegment ELSE '-' END AS prev_c_mktsegment FROM customer c FULL JOIN batch b ON b.c_custkey = c.c_custkey""")
def scd3(t):
    stored = stored_customers(t).select("c_custkey", "c_mktsegment")
    out = scd.scd3(stored, customer_batch(t).select("c_custkey", "c_mktsegment"), ["c_custkey"], ["c_mktsegment"])
    return out.na.fill({"prev_c_mktsegment": "-"})


@query("ups_08_dated_prices", """
WITH p AS (SELECT l_partkey AS k, l_linenumber AS pos, CAST(l_shipdate AS DATE) AS s, min(l_quantity) AS price FROM lineitem GROUP BY 1, 2, 3)
SELECT k, pos, strftime(s, '%Y-%m-%d') AS s, coalesce(strftime(lead(s) OVER (PARTITION BY k, pos ORDER BY s) - 1, '%Y-%m-%d'), 'open') AS e, price FROM p""")
def dated_prices(t):
    points = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("pos"),
                               F.to_date("l_shipdate").alias("s"), F.col("l_quantity").alias("price"))
    out = scd.dated_prices(points, ["k", "pos"], "s", "e", "price")
    return out.select("k", "pos", dates.day_text("s").alias("s"), F.coalesce(dates.day_text("e"), F.lit("open")).alias("e"), "price")


@query("ups_09_load_dated", "WITH " + _HIST + """,
st AS (SELECT k, s, price, CASE WHEN k % 3 = 0 THEN e WHEN k % 3 = 1 THEN coalesce(e, DATE '1999-06-30') ELSE coalesce(e, DATE '1998-12-31') END AS e FROM hist WHERE k % 5 <> 0),
b AS (SELECT k, min(s) AS s, min(s) + 400 AS e, arg_min(price, s) AS price FROM news GROUP BY k),
l AS (SELECT k, max(s) AS ls, arg_max(coalesce(e, DATE '9999-01-01'), s) AS le FROM st GROUP BY k),
c AS (SELECT b.*, ls, CASE WHEN le = DATE '9999-01-01' THEN NULL ELSE le END AS le, CASE WHEN ls IS NULL THEN 5 WHEN le = DATE '9999-01-01' THEN CASE WHEN ls < b.s THEN 1 END
   WHEN le < b.s THEN 2 WHEN b.e > le THEN CASE WHEN le = b.s THEN 3 ELSE 4 END END AS c FROM b LEFT JOIN l ON b.k = l.k),
r AS (SELECT st.k, st.s, coalesce(st.e, c.s - 1) AS e, st.price FROM st LEFT JOIN c ON st.k = c.k AND c.c = 1
  UNION ALL SELECT k, CASE WHEN c IN (3, 4) THEN le + 1 ELSE s END, e, price FROM c WHERE c IS NOT NULL)""" + _OUT + "r")
def load_dated(t):
    k, e = F.col("k"), F.col("e")
    ended = (F.when(k % 3 == 0, e).when(k % 3 == 1, F.coalesce(e, F.lit("1999-06-30").cast("date")))
             .otherwise(F.coalesce(e, F.lit("1998-12-31").cast("date"))))
    stored = history(t).where("k % 5 <> 0").withColumn("e", ended)
    first = latest(brand_history(t, True), ["k"], ["s"], newest=False).withColumn("e", F.date_add("s", 400))
    return dated(scd.load_dated(stored, first, ["k"], "s", "e"))


@query("ups_10_check_then_insert", "WITH " + _HIST + """,
f AS (SELECT k, min(s) AS s, arg_min(price, s) AS price FROM news GROUP BY k),
r AS (SELECT h.k, h.s, h.price, coalesce(h.e, f.s - 1) AS e FROM hist h LEFT JOIN f ON h.k = f.k UNION ALL SELECT k, s, price, NULL FROM f)""" + _OUT + "r")
def check_then_insert(t):
    first = latest(brand_history(t, True), ["k"], ["s"], newest=False).withColumn("e", F.lit(None).cast("date"))
    return dated(scd.scd2_close_open(history(t), first, ["k"], "s", "e"))


@query("ups_11_revision_upsert", """
WITH st AS (SELECT user_id AS k, event_id % 3 AS rev, round(value) AS marks, ts FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
b AS (SELECT user_id AS k, event_id % 3 AS rev, round(value) AS marks, ts FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, ts DESC) = 1)
SELECT coalesce(b.k, st.k) AS k, CASE WHEN st.k IS NULL OR b.rev > st.rev THEN b.rev ELSE st.rev END AS rev,
 CASE WHEN st.k IS NULL OR b.rev >= st.rev THEN b.marks ELSE st.marks END AS marks,
 strftime(CASE WHEN st.k IS NULL OR b.rev > st.rev OR (b.rev = st.rev AND b.marks <> st.marks) THEN b.ts WHEN b.rev = st.rev THEN greatest(b.ts, st.ts) ELSE st.ts END, '%Y-%m-%d %H:%M:%S') AS at
FROM st FULL JOIN b ON st.k = b.k""")
def revision_upsert(t):
    rows = t.events.select(F.col("user_id").alias("k"), (F.col("event_id") % 3).alias("rev"), F.round("value").alias("marks"),
                           "ts", "event_type", "event_id")
    stored = latest(rows.where("event_type = 'view'"), ["k"], ["ts", "event_id"], newest=False).select("k", "rev", "marks", "ts")
    batch = rows.where("event_type = 'click'").select("k", "rev", "marks", "ts")
    out = scd.upsert_by_revision(stored, batch, ["k"], "rev", "marks", "ts")
    return out.select("k", "rev", "marks", dates.second_text("ts").alias("at"))


@query("ups_12_counters", """
SELECT page, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT event_type AS page, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1
 UNION ALL SELECT event_type, count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) GROUP BY 1""")
def counters(t):
    hits = t.events.withColumnRenamed("event_type", "page")
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    stored = hits.where(cut).groupBy("page").agg(F.count(F.lit(1)).alias("hits"))
    return scd.add_counters(stored, hits.where(~cut), ["page"], "hits")


@query("ups_13_classify", "WITH " + _BATCH + """
SELECT b.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'insert' WHEN c.c_mktsegment <> b.seg THEN 'update' ELSE 'unchanged' END AS action
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS seg FROM batch) b LEFT JOIN customer c ON b.c_custkey = c.c_custkey""")
def classify(t):
    segment = F.when(F.col("c_custkey") % 4 == 0, "MACHINERY").otherwise(F.col("c_mktsegment"))
    batch = customer_batch(t).select("c_custkey", segment.alias("c_mktsegment"))
    return scd.classify(stored_customers(t), batch, ["c_custkey"], ["c_mktsegment"]).select("c_custkey", "action")


def race_feed(t):
    verb = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return t.events.select(F.col("user_id").alias("k"), "event_id", F.round("value", 2).alias("v"), "ts", verb.alias("verb"))


@query("ups_14_newer_wins", """
WITH f AS (SELECT user_id AS k, event_id, round(value, 2) AS v, ts, event_type = 'error' AS gone FROM events),
st AS (SELECT k, event_id, v, ts FROM f WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT * FROM f WHERE (ts < TIMESTAMP '2024-01-20' AND k % 2 = 0) OR (ts >= TIMESTAMP '2024-01-25' AND k % 2 = 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(st.k, b.k) AS k, CASE WHEN st.k IS NULL OR b.ts > st.ts THEN b.event_id ELSE st.event_id END AS event_id, CASE WHEN st.k IS NULL OR b.ts > st.ts THEN b.v ELSE st.v END AS v
FROM st FULL JOIN b ON st.k = b.k WHERE NOT coalesce(b.gone AND (st.k IS NULL OR b.ts > st.ts), false)""")
def newer_wins(t):
    feed = race_feed(t)
    def at(day):
        return F.lit(day).cast("timestamp_ntz")
    ts, k = F.col("ts"), F.col("k")
    stored = latest(feed.where((ts >= at("2024-01-10")) & (ts < at("2024-01-25"))), ["k"], ["ts", "event_id"]).select("k", "event_id", "v", "ts")
    batch = feed.where(((ts < at("2024-01-20")) & (k % 2 == 0)) | ((ts >= at("2024-01-25")) & (k % 2 == 1)))
    return scd.newer_wins(stored, batch, ["k"], "ts", "verb").select("k", "event_id", "v")


@query("ups_15_invalidate_and_insert", "WITH " + _BATCH + """
SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey IN (SELECT c_custkey FROM batch) THEN 'N' ELSE 'Y' END AS flag, CASE WHEN c_custkey IN (SELECT c_custkey FROM batch) THEN '2024-01-01' ELSE '-' END AS closed FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, 'Y', '-' FROM batch""")
def invalidate_and_insert(t):
    stored = stored_customers(t).select("c_custkey", "c_mktsegment").withColumns({"flag": F.lit("Y"), "closed": F.lit(None).cast("string")})
    batch = customer_batch(t).select("c_custkey", "c_mktsegment")
    return scd.invalidate_and_insert(stored, batch, ["c_custkey"], "flag", "closed", F.lit("2024-01-01")).na.fill({"closed": "-"})


@query("ups_15_cap_of_four", """
WITH st AS (SELECT DISTINCT o_custkey AS p, o_orderkey AS c FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS p, o_orderkey AS c FROM orders WHERE o_orderstatus <> 'F'),
u AS (SELECT p, count(*) AS n FROM st WHERE c NOT IN (SELECT c FROM b) GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY c) AS rn FROM b)
SELECT r.p, r.c FROM r LEFT JOIN u ON r.p = u.p WHERE rn + coalesce(u.n, 0) <= 4""")
def cap_of_four(t):
    """Finished orders are the stored children of a customer, the others come in: at most four stay in all."""
    rows = t.orders.select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("c"), F.col("o_orderstatus") == "F")
    rows = rows.toDF("p", "c", "done")
    stored = rows.where("done").select("p", "c", F.lit("Y").alias("flag"))
    return scd.cap_active(stored, rows.where("not done").select("p", "c"), "p", "c", "flag", 4)


@query("mrg_01_merge", "WITH " + _BATCH + """
SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL AND c.c_acctbal > 5000 THEN 'BIG' WHEN b.c_custkey IS NOT NULL THEN b.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment,
 coalesce(c.c_acctbal, 0) AS c_acctbal FROM customer c FULL JOIN batch b ON c.c_custkey = b.c_custkey
WHERE NOT (b.c_custkey IS NOT NULL AND c.c_custkey IS NOT NULL AND c.c_acctbal < 0) AND (c.c_custkey IS NOT NULL OR b.c_name IS NOT NULL)""")
def merge_clauses(t):
    stored = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return m.merge(stored, customer_batch(t), ["c_custkey"],
                   [m.delete(F.col("t.c_acctbal") < 0), m.update({"c_mktsegment": F.lit("BIG")}, F.col("t.c_acctbal") > 5000),
                    m.update({"c_mktsegment": F.col("s.c_mktsegment")})],
                   [m.insert({"c_custkey": F.col("s.c_custkey"), "c_mktsegment": F.col("s.c_mktsegment"), "c_acctbal": F.lit(0.0)},
                             F.col("s.c_name").isNotNull())])


@query("mrg_01_merge_into_path", "WITH " + _BATCH + """
SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment,
 CAST(CASE WHEN c.c_custkey IS NULL THEN -1 WHEN b.c_custkey IS NOT NULL AND c.c_acctbal > 5000 THEN (c.c_nationkey + 1) % 25 ELSE c.c_nationkey END AS INTEGER) AS c_nationkey
FROM customer c FULL JOIN batch b ON c.c_custkey = b.c_custkey
WHERE (b.c_custkey IS NULL OR c.c_custkey IS NULL OR c.c_acctbal >= 0) AND (c.c_custkey IS NOT NULL OR b.c_name IS NOT NULL)""")
def merge_into_path(t):
    """Rows are deleted, changed in place, moved to another partition and added to a new one; run twice under one name."""
    path = f"{shared_folder(t.spark).rstrip('/')}/merged-{uuid.uuid4().hex}"
    stored = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("int"))
    writers.replace_partitions(stored, path, ["c_nationkey"])
    moved = F.when(F.col("t.c_acctbal") > 5000, (F.col("t.c_nationkey") + 1) % 25).otherwise(F.col("t.c_nationkey"))
    matched = [m.delete(F.col("t.c_acctbal") < 0), m.update({"c_mktsegment": F.col("s.c_mktsegment"), "c_nationkey": moved})]
    added = m.insert({"c_custkey": F.col("s.c_custkey"), "c_mktsegment": F.col("s.c_mktsegment"), "c_nationkey": F.lit(-1)}, F.col("s.c_name").isNotNull())
    for _ in range(2):
        writers.merge_into_path(t.spark, path, customer_batch(t), ["c_custkey"], ["c_nationkey"], matched, [added], name="customers")
    return redo.read_table(t.spark, path).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("mrg_02_guarded_changes", """
WITH st AS (SELECT user_id AS k, ts AS s, event_type AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
src AS (SELECT user_id AS k, ts AS s, event_type AS v, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Insert' END AS crud FROM events WHERE ts >= TIMESTAMP '2024-01-19' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
j AS (SELECT src.*, CASE WHEN src.s > st.s AND src.v <> st.v THEN 'Computed' ELSE 'Defective' END AS verdict FROM src JOIN st ON src.k = st.k WHERE crud <> 'Delete'),
a AS (SELECT k, s, v, 'Computed' AS crud FROM j WHERE verdict = 'Computed' UNION ALL SELECT k, s, v, crud FROM src),
f AS (SELECT * FROM a WHERE k NOT IN (SELECT k FROM j WHERE verdict = 'Defective'))
SELECT k, v, crud, strftime(s, '%Y-%m-%d %H:%M:%S') AS s, coalesce(strftime(CASE WHEN crud = 'Computed' THEN s - INTERVAL 60 SECOND WHEN crud = 'Delete' THEN s END, '%Y-%m-%d %H:%M:%S'), 'open') AS e FROM f""")
def guarded_changes(t):
    rows = t.events.select(F.col("user_id").alias("k"), F.col("ts").alias("s"), F.col("event_type").alias("v"), "event_id")
    stored = latest(rows.where("s < timestamp_ntz '2024-01-20'"), ["k"], ["s", "event_id"]).drop("event_id")
    stored = stored.withColumn("e", F.lit(None).cast("timestamp_ntz"))
    crud = F.when(F.col("v") == "error", "Delete").otherwise("Insert")
    source = latest(rows.where("s >= timestamp_ntz '2024-01-19'"), ["k"], ["s", "event_id"], newest=False).drop("event_id")
    out = scd.guarded_changes(stored, source.withColumn("crud", crud), ["k"], ["v"], "s", "e")
    return out.select("k", "v", "crud", dates.second_text("s").alias("s"), F.coalesce(dates.second_text("e"), F.lit("open")).alias("e"))


@query("mrg_03_change_feed", """
WITH st AS (SELECT DISTINCT user_id AS k FROM events WHERE ts < TIMESTAMP '2024-01-02'),
f AS (SELECT user_id AS k, event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(st.k, f.k) AS k, coalesce(f.event_id, -1) AS event_id FROM st FULL JOIN f ON st.k = f.k WHERE f.k IS NULL OR f.event_type <> 'error'""")
def change_feed(t):
    cut = F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")
    stored = t.events.where(cut).select(F.col("user_id").alias("k"), F.lit(-1).cast("bigint").alias("event_id")).distinct()
    action = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    feed = t.events.where(~cut).select(F.col("user_id").alias("k"), "event_id", "ts", action.alias("action"))
    return m.apply_feed(stored, feed, ["k"], ["ts", "event_id"])


@query("mrg_04_cascade_deletes", """
SELECT 'nation' AS level, CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey = 1 THEN '2024-01-01' ELSE 'open' END AS e FROM nation
UNION ALL SELECT 'customer', c_custkey, CASE WHEN n_regionkey = 1 THEN '2024-01-01' ELSE 'open' END FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'order', o_orderkey, CASE WHEN n_regionkey = 1 THEN '2024-01-01' ELSE 'open' END FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def cascade(t):
    opened = F.lit(None).cast("string").alias("e")
    nations = t.nation.select(F.col("n_nationkey").alias("nation"), opened)
    customers = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"), opened)
    orders = t.orders.select(F.col("o_custkey").alias("cust"), "o_orderkey", opened)
    deleted = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"), F.lit("2024-01-01").alias("e"))
    a, b, c = scd.cascade_deletes(nations, customers, orders, deleted, "nation", "cust", "e")
    def shape(df, level, key):
        return df.select(F.lit(level).alias("level"), F.col(key).cast("bigint").alias("id"), F.coalesce("e", F.lit("open")).alias("e"))
    return shape(a, "nation", "nation").unionByName(shape(b, "customer", "cust")).unionByName(shape(c, "order", "o_orderkey"))


@query("mrg_05_append_missing", """
WITH silver AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3)
SELECT event_id, user_id, event_type FROM silver UNION ALL (SELECT event_id, user_id, event_type FROM events EXCEPT SELECT * FROM silver)""")
def append_missing(t):
    bronze = t.events.select("event_id", "user_id", "event_type")
    silver = bronze.where("event_id % 10 <> 3")
    return silver.unionByName(relational.missing_rows(bronze, silver))
