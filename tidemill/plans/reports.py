"""End-to-end flow queries."""

from pyspark.sql import functions as F

from tidemill.flows import assessments, layers, marks, ranking, reports
from tidemill.functions import dates
from tidemill.operators import aggregates, holding
from tidemill.operators.ordered import latest
from tidemill.plans.registry import query
from tidemill.session import materialise


def readings(t):
    """Events as ``reading~year~circuit~session~processDate`` messages; some readings are not numbers."""
    reading = F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.round("value", 1).cast("string"))
    text = F.concat_ws("~", reading, F.lit("2024"), F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")), "event_type",
                       dates.day_text("ts"))
    return t.events.select(F.col("event_id").alias("key"), text.alias("value"))


_READINGS = """r AS (SELECT event_id AS key, round(value, 1) AS reading, 'c' || (user_id % 9) AS circuit, event_type AS session, CAST(ts AS DATE) AS d FROM events WHERE event_id % 97 <> 0)"""


@query("e2e_01_layers_counts", "WITH " + _READINGS + " SELECT 2024 AS year, circuit, session, count(DISTINCT reading) AS readings FROM r GROUP BY circuit, session")
def layers_counts(t):
    return layers.gold_counts(layers.silver(layers.bronze(readings(t), 1)))


@query("e2e_01_layers_latest", "WITH " + _READINGS + """
SELECT key, reading, circuit, session, strftime(d, '%Y-%m-%d') AS day FROM r QUALIFY row_number() OVER (PARTITION BY reading, circuit, session ORDER BY d DESC, key DESC) = 1""")
def layers_latest(t):
    rows = layers.gold_latest(layers.silver(layers.bronze(readings(t), 1)))
    return rows.select("key", "reading", "circuit", "session", dates.day_text("process_date").alias("day"))


_KIND = "CASE WHEN l_orderkey % 2 = 0 THEN 'SA' ELSE 'CA' END"


# A number of thousandths as a decimal of three places.
_MARK = "CAST(CAST({} AS BIGINT) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(16,3))"


def exam_marks(t):
    """An order is an exam sitting, its line numbers are subjects; the marks of half of them have a 5 in the fourth place."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("student"), F.col("l_linenumber").alias("subject")).agg(
        F.max("l_quantity").alias("q")).select(
        F.lit(1).alias("exam"), "student", F.when(F.col("student") % 2 == 0, "SA").otherwise("CA").alias("kind"), "subject",
        F.when(F.col("student") % 2 == 0, F.col("q") * 2).otherwise(F.col("q") * 17 / 16).alias("marks"))


_GRADE = """CASE WHEN p > 95 THEN 'A+' WHEN p > 90 THEN 'A' WHEN p > 85 THEN 'B+' WHEN p > 80 THEN 'B' WHEN p > 75 THEN 'C+' WHEN p > 70 THEN 'C' WHEN p > 65 THEN 'D+' WHEN p > 60 THEN 'D'
 WHEN kind = 'CA' AND p > 50 THEN 'E+' WHEN kind = 'CA' AND p >= 45 THEN 'E' WHEN kind = 'SA' AND p >= 50 THEN 'E' ELSE 'F' END"""


@query("e2e_02_exam_results", f"""
WITH q AS (SELECT l_orderkey AS student, l_linenumber AS subject, {_KIND} AS kind, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
m AS (SELECT student, subject, kind, {_MARK.format("CASE kind WHEN 'SA' THEN q::BIGINT * 2000 ELSE (q::BIGINT * 34000 + 16) // 32 END")} AS marks,
 CAST(CASE kind WHEN 'SA' THEN 100 ELSE 60 END AS DECIMAL(16,3)) AS mx, CAST(CASE kind WHEN 'SA' THEN 50 ELSE 27 END AS DECIMAL(16,3)) AS pm FROM q),
u AS (SELECT student, kind, CAST(subject AS VARCHAR) AS subject, marks, mx, pm, CASE WHEN marks >= pm THEN 'PASS' ELSE 'FAIL' END AS result, '' AS comment FROM m
 UNION ALL SELECT student, kind, 'subTotal', sum(marks)::DECIMAL(16,3), sum(mx)::DECIMAL(16,3), sum(pm)::DECIMAL(16,3), CASE WHEN count_if(marks < pm) > 0 THEN 'FAIL' ELSE 'PASS' END,
  coalesce('Failed in ' || string_agg(CASE WHEN marks < pm THEN CAST(subject AS VARCHAR) END, ',' ORDER BY subject), '') FROM m GROUP BY student, kind),
g AS (SELECT *, marks * 100 / mx AS p FROM u)
SELECT student, kind, subject, marks, mx AS max_marks, pm AS pass_mark, result, comment, {_GRADE} AS grade FROM g""")
def exam_results(t):
    return marks.exam_results(exam_marks(t)).drop("exam")


def semester(t):
    """Customers are students, priorities subjects; order keys give twelve exams, a third of them not attended."""
    exam = F.col("o_orderkey") % 12
    rows = t.orders.groupBy(F.col("o_custkey").alias("student"), F.col("o_orderpriority").alias("subject"), exam.alias("exam")).agg(
        F.max(F.round(F.col("o_totalprice") % 65)).alias("marks"))
    rows = rows.withColumn("kind", F.when(F.col("exam") % 2 == 0, "SA").otherwise("CA")).withColumn("max_marks", F.lit(64.0))
    return rows.select("student", "subject", "kind", "exam"), rows.where("exam % 3 <> 0")


@query("e2e_03_semester_results", f"""
WITH r AS (SELECT o_custkey AS student, o_orderpriority AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'SA' ELSE 'CA' END AS kind, o_orderkey % 12 AS exam, CASE WHEN o_orderkey % 3 <> 0 THEN max(round(o_totalprice % 65))::BIGINT END AS marks FROM orders GROUP BY 1, 2, 3, 4, o_orderkey % 3),
h AS (SELECT *, (2 * marks * 100000 + 64) // 128 AS share, CASE kind WHEN 'SA' THEN 60 ELSE 40 END AS w, count(*) OVER (PARTITION BY student, subject, kind) AS planned FROM r),
k AS (SELECT student, subject, kind, sum(coalesce((2 * share * w + planned * 100) // (2 * planned * 100), 0)) AS points,
  string_agg(CASE WHEN marks IS NULL THEN CAST(exam AS VARCHAR) END, ',' ORDER BY CAST(exam AS VARCHAR)) AS missed FROM h GROUP BY student, subject, kind),
s AS (SELECT student, subject, coalesce(max(CASE WHEN kind = 'SA' THEN points END), 0) AS sa, coalesce(max(CASE WHEN kind = 'CA' THEN points END), 0) AS ca,
  concat_ws(',', max(CASE WHEN kind = 'CA' THEN missed END), max(CASE WHEN kind = 'SA' THEN missed END)) AS missed FROM k GROUP BY student, subject),
t AS (SELECT *, sa + ca AS total, sa >= 30000 AND sa + ca >= 60000 AS passed FROM s),
u AS (SELECT student, subject, sa, ca, total, 100 AS out_of, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS result,
  CASE WHEN sa < 30000 THEN 'FAIL in SA' WHEN total < 60000 THEN 'Failed to achieve total pass' WHEN ca >= 18000 THEN 'PASS in SA and CA' ELSE 'PASS in SA and total, but fail in CA' END AS comment,
  CASE WHEN missed <> '' THEN 'Did not attend ' || missed ELSE '' END AS attendance FROM t
 UNION ALL SELECT student, 'subTotal', sum(sa), sum(ca), sum(total), CAST(count(*) * 100 AS INTEGER), CASE WHEN bool_and(passed) THEN 'ALL-CLEAR' ELSE 'RE-APPEAR' END, '', '' FROM t GROUP BY student),
g AS (SELECT *, total / 10.0::DOUBLE / out_of AS p FROM u)
SELECT student, subject, {_MARK.format("sa")} AS sa_marks, {_MARK.format("ca")} AS ca_marks, {_MARK.format("total")} AS total, out_of, result, comment, attendance, CASE WHEN p > 95 THEN 'A+' WHEN p > 90 THEN 'A' WHEN p > 85 THEN 'B+' WHEN p > 80 THEN 'B' WHEN p > 75 THEN 'C' WHEN p > 70 THEN 'D' WHEN p >= 60 THEN 'E' WHEN p = 0 THEN 'F-' ELSE 'F' END AS grade FROM g""")
def semester_results(t):
    planned, attended = semester(t)
    return marks.semester_results(planned, attended)


@query("e2e_04_race_ranking", """
WITH res AS (SELECT year(o_orderdate) AS season, o_orderkey % 50 AS race, o_custkey AS driver, CAST(o_orderkey % 20 + 1 AS INTEGER) AS position, o_orderkey FROM orders),
l AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY season, race, driver ORDER BY o_orderkey DESC) = 1),
rel AS (SELECT l.* FROM l WHERE race IN (SELECT p_size FROM part) AND driver IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)),
pts AS (SELECT *, CASE WHEN position <= 10 THEN 11 - position ELSE 0 END AS point FROM rel),
tot AS (SELECT season, driver, CAST(sum(point) AS BIGINT) AS total_points, sum(position) / count(*) AS mp FROM pts GROUP BY 1, 2)
SELECT CAST(season AS INTEGER) AS season, driver, total_points, round(mp, 6) AS mean_position, row_number() OVER (PARTITION BY season ORDER BY CASE WHEN total_points = 0 THEN 1 ELSE 0 END, total_points DESC, mp, driver) AS standing FROM tot""")
def race_ranking(t):
    """Results wait until race and driver are known, then standings are made per season."""
    rows = t.orders.select(F.year("o_orderdate").alias("season"), (F.col("o_orderkey") % 50).alias("race"), F.col("o_custkey").alias("driver"),
                           (F.col("o_orderkey") % 20 + 1).cast("int").alias("position"), "o_orderkey",
                           F.lit("2024-01-01").cast("timestamp").alias("at"))
    positions = rows.select("season", "position").where("position <= 10").distinct()
    rows = latest(rows, ["season", "race", "driver"], ["o_orderkey"]).drop("o_orderkey")
    races = t.part.select(F.col("p_size").cast("bigint").alias("race"))
    drivers = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("driver"))
    step = holding.resolve(rows.where("driver % 2 = 0"), rows.where("driver % 2 = 1"), [(races, ["race"]), (drivers, ["driver"])],
                           ["season", "race", "driver"], "at", F.lit("2024-01-02").cast("timestamp"), "2 days")
    points = positions.withColumn("point", F.lit(11) - F.col("position"))
    out = ranking.season_standings(step.released, points)
    return out.select("season", "driver", "total_points", F.round("mean_position", 6).alias("mean_position"), F.col("standing").cast("bigint").alias("standing"))


@query("e2e_05_leaderboard", """
WITH p AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS pts FROM events),
s AS (SELECT user_id, sum(pts) AS a, max(ts) AS at FROM p WHERE ts < TIMESTAMP '2024-01-28' GROUP BY 1), b AS (SELECT user_id, sum(pts) AS b, max(ts) AS bt FROM p WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1),
j AS (SELECT coalesce(s.user_id, b.user_id) AS user_id, CAST(coalesce(a, 0) + coalesce(b, 0) AS BIGINT) AS points, CASE WHEN coalesce(b, 0) <> 0 OR s.at IS NULL THEN bt ELSE s.at END AS reached FROM s FULL JOIN b ON s.user_id = b.user_id)
SELECT user_id, points, strftime(reached, '%Y-%m-%d %H:%M:%S') AS reached, CAST(rank() OVER (ORDER BY points DESC, j.reached) AS INTEGER) AS place FROM j""")
def leaderboard(t):
    points = F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0)
    rows = t.events.select("user_id", points.alias("points"), F.col("ts").alias("reached"))
    cut = F.col("reached") < F.lit("2024-01-28").cast("timestamp_ntz")
    stored = rows.where(cut).groupBy("user_id").agg(F.sum("points").alias("points"), F.max("reached").alias("reached"))
    out = ranking.leaderboard(stored, rows.where(~cut), "user_id", "points", "reached")
    return out.withColumn("reached", dates.second_text("reached"))


@query("e2e_06_page_hits", """
SELECT event_type AS page, strftime(ts, '%Y-%m-%d') AS day, count(*) AS hits FROM events GROUP BY 1, 2
UNION ALL SELECT event_type, 'total', count(*) FROM events GROUP BY 1""")
def page_hits(t):
    """Daily and overall counters after three successive batches: each batch leaves partial counts, made in one scan, and both totals add these up."""
    hits = t.events.select(F.col("event_type").alias("page"), dates.day_text("ts").alias("day"), (F.col("event_id") % 3).alias("batch_id"))
    partial = materialise(hits.groupBy("page", "day", "batch_id").agg(F.count(F.lit(1)).alias("hits")))
    daily, total = (partial.groupBy(*keys).agg(F.sum("hits").alias("hits")) for keys in (["page", "day"], ["page"]))
    return daily.unionByName(total.withColumn("day", F.lit("total")))


@query("e2e_07_survey", """
WITH s AS (SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'Others' END AS category, CASE quality WHEN 1 THEN 'Yes ' ELSE ' no' END AS answer FROM documents JOIN labels USING (doc_id))
SELECT category, count_if(lower(trim(answer)) = 'yes') AS all_yes, count_if(lower(trim(answer)) = 'no') AS all_no FROM s GROUP BY 1 HAVING all_yes > 0 AND all_no > 0""")
def survey(t):
    category = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "French").otherwise("Others")
    answer = F.when(F.col("quality") == 1, "Yes ").otherwise(" no")
    return reports.yes_no_counts(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), category, answer)


@query("e2e_08_tracked_metadata", """
WITH st AS (SELECT user_id AS k, ts AS s, event_type AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
src AS (SELECT user_id AS k, ts AS s, event_type AS v, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Insert' END AS crud FROM events WHERE ts >= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
j AS (SELECT src.*, st.k AS old, st.v AS ov FROM src LEFT JOIN st ON src.k = st.k),
ok AS (SELECT * FROM j WHERE crud = 'Delete' OR old IS NULL OR v <> ov)
SELECT st.k, strftime(st.s, '%Y-%m-%d %H:%M:%S') AS s, st.v, coalesce(strftime(CASE WHEN ok.crud = 'Delete' THEN ok.s ELSE ok.s - INTERVAL 60 SECOND END, '%Y-%m-%d %H:%M:%S'), 'open') AS e FROM st LEFT JOIN ok ON st.k = ok.k
UNION ALL SELECT k, strftime(s, '%Y-%m-%d %H:%M:%S'), v, 'open' FROM ok WHERE crud <> 'Delete'""")
def tracked_metadata(t):
    rows = t.events.select(F.col("user_id").alias("k"), F.col("ts").alias("s"), F.col("event_type").alias("v"), "event_id")
    cut = F.col("s") < F.lit("2024-01-20").cast("timestamp_ntz")
    stored = latest(rows.where(cut), ["k"], ["s", "event_id"]).drop("event_id").withColumn("e", F.lit(None).cast("timestamp_ntz"))
    crud = F.when(F.col("v") == "error", "Delete").otherwise("Insert")
    feed = rows.where(~cut).drop("event_id").withColumn("crud", crud)
    out = assessments.apply_level(stored, feed, ["k"], ["v"], "s", "e")
    return out.select("k", dates.second_text("s").alias("s"), "v", F.coalesce(dates.second_text("e"), F.lit("open")).alias("e"))


@query("e2e_09_lap_analytics", """
WITH laps AS (SELECT l_suppkey AS driver, l_partkey % 20 AS lap, l_linenumber AS sector, l_extendedprice AS dist, l_quantity AS secs FROM lineitem),
a AS (SELECT driver, sum(dist) / (sum(secs) / 3600) AS overall FROM laps GROUP BY 1),
g AS (SELECT driver, lap, coalesce(sector, 0) AS sector, sum(dist) / (sum(secs) / 3600) AS speed FROM laps GROUP BY GROUPING SETS ((driver, lap, sector), (driver, lap))),
f AS (SELECT driver, lap, -1 AS sector, speed FROM g WHERE sector = 0 QUALIFY row_number() OVER (PARTITION BY driver ORDER BY speed DESC, lap) = 1)
SELECT u.driver, lap, sector, round(speed, 4) AS speed, round(overall, 4) AS overall FROM (SELECT * FROM g UNION ALL SELECT * FROM f) u JOIN a USING (driver)""")
def lap_analytics(t):
    laps = t.lineitem.select(F.col("l_suppkey").alias("driver"), (F.col("l_partkey") % 20).alias("lap"), F.col("l_linenumber").alias("sector"),
                             "l_extendedprice", "l_quantity")
    overall = laps.groupBy("driver").agg(aggregates.speed("l_extendedprice", "l_quantity").alias("s")).select(
        "driver", F.round("s.speed", 4).alias("overall"))
    return aggregates.lap_speeds(laps, "driver", "lap", "sector", "l_extendedprice", "l_quantity").join(overall, "driver")


@query("e2e_10_store_report", "SELECT l_suppkey AS store, CAST(year(o_orderdate) AS INTEGER) AS order_year, " + ", ".join(
    f'round(coalesce(sum(l_extendedprice) FILTER (month(o_orderdate) = {i + 1}), 0), 2) AS "{m}"' for i, m in enumerate(reports.MONTHS)) +
    ", round(sum(l_extendedprice), 2) AS total_revenue, count(DISTINCT o_orderkey) AS number_of_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def store_report(t):
    lines = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("store"), "l_extendedprice")
    sales = lines.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return reports.store_report(sales, "store", "l_orderkey", "o_orderdate", "l_extendedprice", lines.count())


@query("e2e_10_buyers_report", """
SELECT c_custkey, c_name, md5(lower(c_name) || '@example.com') AS mail_digest, count(*) AS orders_placed FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def buyers_report(t):
    people = t.customer.select("c_custkey", "c_name")
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return reports.buyers_report(orders, people, "c_custkey", F.concat(F.lower("c_name"), F.lit("@example.com")))


@query("str_23_hold_step", """
SELECT CASE WHEN d.doc_id IS NULL THEN 'held' ELSE 'released' END AS state, count(*) AS n FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE source <> 'src3' AND lang = 'en') d ON l.doc_id = d.doc_id
WHERE l.doc_id % 11 <> 0 GROUP BY 1""")
def hold_step(t):
    rows = t.labels.withColumn("at", F.when(F.col("doc_id") % 11 == 0, F.lit("2023-01-01").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp")))
    parents = t.documents.where("source <> 'src3' and lang = 'en'").select("doc_id")
    empty = rows.where("false")
    step = holding.resolve(rows, empty, [(parents, ["doc_id"])], ["doc_id"], "at", F.lit("2024-01-02").cast("timestamp"), "30 days")
    out = step.released.withColumn("state", F.lit("released")).unionByName(step.held.withColumn("state", F.lit("held")))
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
