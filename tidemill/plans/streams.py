"""Streaming queries: the events table is read as a stream of files and the output is read back."""

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.plans.registry import query
from tidemill.streaming import batches, sinks, state, versions, windows
from tidemill.streaming.sources import table_stream


def events(t):
    return table_stream(t.spark, t.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_01_file_stream", "SELECT event_id, event_type, value FROM events WHERE value > 50")
def file_stream(t):
    return sinks.run_to_end(events(t).where("value > 50").select("event_id", "event_type", "value"))


@query("str_08_partitioned_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def partitioned_sink(t):
    folder = sinks.new_folder(t.spark)
    sinks.start(events(t).select("event_type", "event_id"), f"{folder}/checkpoint", path=f"{folder}/data",
                partition_by=["event_type"]).awaitTermination()
    return t.spark.read.parquet(f"{folder}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("str_09_batch_lineage", "SELECT event_id, user_id, 0 AS batch_id FROM events")
def batch_lineage(t):
    folder = sinks.new_folder(t.spark)
    sinks.start(events(t).select("event_id", "user_id"), f"{folder}/checkpoint",
                sinks.into_batch_partition(f"{folder}/data")).awaitTermination()
    return t.spark.read.parquet(f"{folder}/data").select("event_id", "user_id", F.col("batch_id").cast("int").alias("batch_id"))


@query("str_11_sliding_windows", """
WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 3 MINUTE, ts), time_bucket(INTERVAL 3 MINUTE, ts) - INTERVAL 3 MINUTE]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s, event_type""")
def sliding_windows(t):
    out = windows.windowed(t.events, "ts", "6 minutes", ["event_type"], "3 minutes", n=F.count(F.lit(1)), total=F.sum("value"))
    return out.select(dates.second_text("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str_12_watermarked_windows", """
WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM w
WHERE s + INTERVAL 60 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY s, event_type""")
def watermarked_windows(t):
    """Append mode: only windows the watermark has passed are written."""
    out = windows.windowed(events(t), "ts", "60 minutes", ["event_type"], "30 minutes", "10 minutes", n=F.count(F.lit(1)))
    out = sinks.run_to_end(out)
    return out.select(dates.second_text("window_start").alias("window_start"), "event_type", "n")


def newest(out):
    """Rows of the newest batch of a complete-mode stream."""
    last = out.agg(F.max("batch_id").alias("batch_id"))
    return out.join(F.broadcast(last), "batch_id", "left_semi")


@query("str_11_sliding_stream", """
WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 3 MINUTE, ts), time_bucket(INTERVAL 3 MINUTE, ts) - INTERVAL 3 MINUTE]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s, event_type""")
def sliding_stream(t):
    """No watermark, so update mode: the newest batch of a window holds its totals."""
    out = windows.windowed(events(t), "ts", "6 minutes", ["event_type"], "3 minutes", n=F.count(F.lit(1)), total=F.sum("value"))
    out = sinks.run_to_end(out, "update").groupBy("window_start", "event_type").agg(
        F.max_by(F.struct("n", "total"), "batch_id").alias("now"))
    return out.select(dates.second_text("window_start").alias("window_start"), "event_type", "now.n", F.round("now.total", 4).alias("total"))


@query("str_13_tumbling_stream", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1""")
def tumbling_stream(t):
    out = windows.windowed(events(t), "ts", "1 hour", [], n=F.count(F.lit(1)), last=F.max("event_id"))
    return newest(sinks.run_to_end(out, "complete")).select(dates.second_text("window_start").alias("window_start"), "n", "last")


@query("str_13_session_stream", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 30 * 60000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_stream(t):
    out = windows.sessions(events(t), "ts", "30 minutes", ["user_id"], n=F.count(F.lit(1)))
    return newest(sinks.run_to_end(out, "complete")).select("user_id", dates.second_text("window_start").alias("window_start"), "n")


@query("str_13_tumbling_windows", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def tumbling_windows(t):
    out = windows.windowed(t.events, "ts", "1 hour", [], n=F.count(F.lit(1)), users=F.count_distinct("user_id"))
    return out.select(dates.second_text("window_start").alias("window_start"), "n", "users")


@query("str_13_session_windows", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 30 * 60000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(t):
    out = windows.sessions(t.events, "ts", "30 minutes", ["user_id"], n=F.count(F.lit(1)))
    return out.select("user_id", dates.second_text("window_start").alias("window_start"), "n")


@query("str_14_own_windows", """
WITH a AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_id, n FROM events e JOIN a ON e.event_type = a.event_type AND time_bucket(INTERVAL 1 HOUR, ts) = w
WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def own_windows(t):
    rows = events(t).select("event_id", "event_type", "ts")
    out = windows.with_own_windows(rows, "ts", "1 hour", "event_type", "10 minutes", n=F.count(F.lit(1)))
    return sinks.run_to_end(out.select("event_id", "n"))


@query("str_15_streaming_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_counts(t):
    """Update mode: each batch writes the counts it changed; the newest batch of a key holds its count."""
    counts = events(t).groupBy(dates.day_text("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = sinks.run_to_end(counts, "update")
    return out.groupBy("day", "event_type").agg(F.max_by("n", "batch_id").alias("n"))


@query("str_16_route_by_type", """
SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'error output' END AS route, count(*) AS n FROM events GROUP BY 1""")
def route_by_type(t):
    folder = sinks.new_folder(t.spark)
    paths = {k: f"{folder}/{k}" for k in ("view", "click")}
    rows = events(t).select("event_id", "event_type")
    sinks.start(rows, f"{folder}/checkpoint",
                sinks.route_by_type(paths, "event_type", f"{folder}/errors")).awaitTermination()
    parts = [sinks.read_batches(t.spark, p, rows.schema).agg(F.lit(name).alias("route"), F.count(F.lit(1)).alias("n"))
             for name, p in [*paths.items(), ("error output", f"{folder}/errors")]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def released(rows, step, *how):
    """What a batch function that holds rows in a table of its own has released."""
    folder = sinks.new_folder(rows.sparkSession)
    sinks.start(rows, f"{folder}/checkpoint", step(f"{folder}/data", f"{folder}/held", *how)).awaitTermination()
    return sinks.read_batches(rows.sparkSession, f"{folder}/data", rows.schema).drop("run", "batch_id")


@query("str_18_hold_first", """
SELECT key, message FROM (SELECT user_id || '-' || event_type || '-' || (event_id % 40) AS key, CAST(event_id AS VARCHAR) AS message,
  count(*) OVER (PARTITION BY user_id, event_type, event_id % 40) AS n FROM events) WHERE n > 1""")
def hold_first(t):
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type", (F.col("event_id") % 40).cast("string"))
    rows = events(t).select(key.alias("key"), F.col("event_id").cast("string").alias("message"))
    return released(rows, batches.hold_first)


@query("str_21_release_with_parent", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) || '-' || (event_id % 7) AS key, CASE WHEN event_type = 'signup' THEN 'parent' WHEN event_type = 'view' THEN 'child' END AS kind, ts, event_id, user_id FROM events WHERE event_type IN ('signup', 'view')),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, kind ORDER BY ts DESC, event_id DESC) = 1)
SELECT key, kind, CAST(event_id AS VARCHAR) AS message FROM l WHERE kind = 'parent' OR key IN (SELECT key FROM l WHERE kind = 'parent') OR user_id % 10 = 0""")
def release_with_parent(t):
    rows = events(t).where("event_type in ('signup', 'view')").select(
        F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("key"),
        F.when(F.col("event_type") == "signup", "parent").otherwise("child").alias("kind"), "ts", "event_id",
        F.col("event_id").cast("string").alias("message"))
    stored = t.events.where("user_id % 10 = 0").select(
        F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("key"))
    out = released(rows, batches.release_with_parent, lambda spark: stored, 90 * 86_400_000, 86_400_000, ("ts", "event_id"))
    return out.select("key", "kind", "message")


@query("str_25_hierarchy", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'signup' THEN 'parent' WHEN 'view' THEN 'child' ELSE 'grandchild' END AS level,
   CASE WHEN value > 40 THEN 'Delete' ELSE 'Insert' END AS crud, event_id FROM events WHERE event_type IN ('signup', 'view', 'click')),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, level ORDER BY event_id DESC) = 1),
p AS (SELECT p.key, p.event_id AS pid, p.crud AS pc, c.event_id AS cid, c.crud AS cc, g.event_id AS gid, g.crud AS gc FROM (SELECT * FROM l WHERE level = 'parent') p
  LEFT JOIN (SELECT * FROM l WHERE level = 'child') c ON p.key = c.key LEFT JOIN (SELECT * FROM l WHERE level = 'grandchild') g ON p.key = g.key)
SELECT key, 'parent' AS level, pc AS crud, pid AS at FROM p
UNION ALL SELECT key, 'child', CASE WHEN pc = 'Delete' THEN 'Delete' ELSE cc END, CASE WHEN pc = 'Delete' THEN pid ELSE cid END FROM p WHERE pc = 'Delete' OR cid IS NOT NULL
UNION ALL SELECT key, 'grandchild', CASE WHEN pc = 'Delete' OR cc = 'Delete' THEN 'Delete' ELSE gc END, CASE WHEN pc = 'Delete' THEN pid WHEN cc = 'Delete' THEN cid ELSE gid END FROM p WHERE pc = 'Delete' OR cc = 'Delete' OR gid IS NOT NULL""")
def hierarchy(t):
    level = F.when(F.col("event_type") == "signup", "parent").when(F.col("event_type") == "view", "child").otherwise("grandchild")
    rows = events(t).where("event_type in ('signup', 'view', 'click')").select(
        F.col("user_id").cast("string").alias("key"), level.alias("level"), F.when(F.col("value") > 40, "Delete").otherwise("Insert").alias("crud"),
        F.col("event_id").alias("at"), F.col("event_id").cast("string").alias("message"))
    return sinks.run_to_end(state.hierarchy(rows)).select("key", "level", "crud", "at")


@query("join_17_stream_static", """
SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey""")
def stream_static(t):
    people = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return sinks.run_to_end(events(t).select("event_id", "user_id").join(people, "user_id").select("event_id", "c_mktsegment"))


@query("join_18_stream_stream", """
SELECT a.event_id AS viewed, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'
 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""")
def stream_stream(t):
    views = events(t).where("event_type = 'view'").select("user_id", F.col("event_id").alias("viewed"), F.col("ts").alias("seen_at"))
    buys = events(t).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("bought_at"))
    out = windows.join_within(views, buys, "user_id", "seen_at", "bought_at", "2 hours")
    return sinks.run_to_end(out.select("viewed", "bought"))


@query("join_18_stream_stream_left", """
SELECT a.event_id AS viewed, coalesce(b.event_id, -1) AS bought FROM (SELECT * FROM events WHERE event_type = 'view') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
 ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR
WHERE b.event_id IS NOT NULL OR a.ts + INTERVAL 2 HOUR < (SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 10 MINUTE FROM events)""")
def stream_stream_left(t):
    views = events(t).where("event_type = 'view'").select("user_id", F.col("event_id").alias("viewed"), F.col("ts").alias("seen_at"))
    buys = events(t).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("bought_at"))
    out = windows.join_within(views, buys, "user_id", "seen_at", "bought_at", "2 hours", "left")
    return sinks.run_to_end(out.select("viewed", "bought")).na.fill({"bought": -1})


@query("join_18_stream_stream_right", """
SELECT coalesce(a.event_id, -1) AS viewed, b.event_id AS bought FROM (SELECT * FROM events WHERE event_type = 'view') a RIGHT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
 ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR
WHERE a.event_id IS NOT NULL OR b.ts < (SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 10 MINUTE FROM events)""")
def stream_stream_right(t):
    views = events(t).where("event_type = 'view'").select("user_id", F.col("event_id").alias("viewed"), F.col("ts").alias("seen_at"))
    buys = events(t).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("bought_at"))
    out = windows.join_within(views, buys, "user_id", "seen_at", "bought_at", "2 hours", "right")
    return sinks.run_to_end(out.select("viewed", "bought")).na.fill({"viewed": -1})


@query("str_06_complete_mode", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def complete_mode(t):
    """Complete mode: every batch writes all counts, so the newest batch is the result."""
    counts = events(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    out = sinks.run_to_end(counts, "complete")
    return newest(out).select("user_id", "n", "last")


@query("str_22_pair_up", """
WITH m AS (SELECT user_id, event_id FROM events WHERE event_type = 'signup'), o AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT user_id FROM m))
SELECT CAST(user_id AS VARCHAR) AS key, 'member' AS side, CAST(event_id AS VARCHAR) AS id FROM m WHERE user_id IN (SELECT c_custkey FROM o)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'owner', '' FROM o""")
def pair_up(t):
    """Customers own the sign-ups of their number; both wait for each other in keyed state."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(setting)
    t.spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        members = events(t).where("event_type = 'signup'").select(
            F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("id"), "ts", "event_type")
        members = members.withWatermark("ts", "1 day").select("key", "id", "ts", F.col("event_type").alias("message"))
        users = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("c_custkey")).distinct()
        owners = table_stream(t.spark, t.folder, "customer").where("c_acctbal > 0").join(users, "c_custkey", "left_semi").select(
            F.col("c_custkey").cast("string").alias("key"), F.lit("2024-01-15").cast("timestamp").alias("ts"), F.col("c_name").alias("message"))
        out = state.pair_up(owners.withWatermark("ts", "1 day"), members, 365 * 86_400_000)
        return sinks.run_to_end(out).select("key", "side", "id")
    finally:
        t.spark.conf.set(setting, before)


@query("str_02_table_changes", """
WITH v1 AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS p FROM orders WHERE o_orderkey % 3 <> 0),
v2 AS (SELECT k, st, CASE WHEN st = 'F' THEN p * 2 ELSE p END AS p FROM v1), v3 AS (SELECT * FROM v2 WHERE st <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0)
SELECT k, p, 'insert' AS change, 1::BIGINT AS version FROM v1
UNION ALL (SELECT k, p, 'insert', 2 FROM v2 EXCEPT SELECT k, p, 'insert', 2 FROM v1) UNION ALL (SELECT k, p, 'delete', 2 FROM v1 EXCEPT SELECT k, p, 'delete', 2 FROM v2)
UNION ALL (SELECT k, p, 'insert', 3 FROM v3 EXCEPT SELECT k, p, 'insert', 3 FROM v2) UNION ALL (SELECT k, p, 'delete', 3 FROM v2 EXCEPT SELECT k, p, 'delete', 3 FROM v3)""")
def table_changes(t):
    """Orders as a table of three versions: a third is missing at first, then finished orders are rewritten, then some are deleted and the missing ones come.
    The stream ends after the second version and starts again from its checkpoint."""
    folder = sinks.new_folder(t.spark)
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("p"))
    first = rows.where("k % 3 <> 0")
    second = first.withColumn("p", F.when(F.col("st") == "F", F.col("p") * 2).otherwise(F.col("p")))
    third = second.where("st <> 'P'").unionByName(rows.where("k % 3 = 0"))

    def drain():
        changes = versions.version_stream(t.spark, f"{folder}/table", "rows")
        sinks.start(changes, f"{folder}/checkpoint", path=f"{folder}/data").awaitTermination()
    versions.write_version(first, f"{folder}/table", 1)
    versions.write_version(second, f"{folder}/table", 2)
    drain()
    versions.write_version(third, f"{folder}/table", 3)
    drain()
    return t.spark.read.parquet(f"{folder}/data").select("k", "p", F.col("_change").alias("change"), F.col("_version").alias("version"))
