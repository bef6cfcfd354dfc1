"""Aggregation queries."""

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import aggregates, relational
from tidemill.plans.registry import query


@query("agg_01_group_by", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
       min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem GROUP BY 1, 2""")
def group_by(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"), F.min("l_discount").alias("min_disc"),
        F.max("l_tax").alias("max_tax"))


@query("agg_02_conditional", """
SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS closed,
       count_if(o_totalprice > 250000) AS big, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END), 2) AS signed_total
FROM orders GROUP BY 1""")
def conditional(t):
    signed = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return t.orders.groupBy("o_orderpriority").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("closed"),
        F.count_if(F.col("o_totalprice") > 250000).alias("big"), F.round(F.sum(signed), 2).alias("signed_total"))


@query("agg_03_distinct_count", """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def distinct_count(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"),
                                                  F.count_distinct("l_partkey").alias("parts"))


@query("agg_04_approx_distinct", """
SELECT event_type, true AS within_tolerance FROM events GROUP BY 1""")
def approx_distinct(t):
    """The estimate is checked against the exact count with a 15 % tolerance. Values are made distinct first, which an estimate does not depend on: beside a distinct count it
    would keep a sketch of some kilobytes for each value."""
    values = t.events.select("event_type", "user_id").distinct()
    counts = values.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("approx"), F.count("user_id").alias("exact"))
    return counts.select("event_type", (F.abs(F.col("approx") - F.col("exact")) <= 0.15 * F.col("exact"))
                         .alias("within_tolerance"))


@query("agg_05_pivot", """
SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), 0) AS "F",
  coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS "O",
  coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2), 0) AS "P" FROM orders GROUP BY 1""")
def pivot(t):
    return (t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"])
            .agg(F.round(F.sum("o_totalprice"), 2)).na.fill(0))


@query("agg_06_having", """
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 4""")
def having(t):
    return (t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("o_year")).agg(F.count(F.lit(1)).alias("n"))
            .where("n >= 4"))


@query("agg_06_duplicates", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicates(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("agg_07_detail_and_subtotal", """
SELECT l_suppkey, coalesce(l_returnflag, 'subTotal') AS part_of, round(sum(l_extendedprice), 2) AS total, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_suppkey, l_returnflag), (l_suppkey))""")
def detail_and_subtotal(t):
    return aggregates.with_subtotals(t.lineitem, ["l_suppkey"], "l_returnflag", "part_of",
                                     total=F.round(F.sum("l_extendedprice"), 2), n=F.count(F.lit(1)))


@query("agg_08_collected_comment", """
WITH d AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN flags LIKE '%R%' THEN 'RETURNED in ' || regexp_replace(flags, ',?R', '') ELSE 'CLEAR' END AS comment, flags FROM d""")
def collected_comment(t):
    """Values are deduplicated before they are listed, so a list is as long as the flag domain."""
    flags = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    joined = F.concat_ws(",", "f")
    comment = F.when(F.array_contains("f", "R"), F.concat(F.lit("RETURNED in "), F.regexp_replace(joined, ",?R", "")))
    return flags.select("l_orderkey", comment.otherwise("CLEAR").alias("comment"), joined.alias("flags"))


@query("agg_09_word_count", """
WITH w AS (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1""")
def word_count(t):
    words = t.documents.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("agg_10_max_by", """
SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest
FROM orders GROUP BY 1""")
def max_by(t):
    by = F.struct("o_totalprice", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"),
                                             F.min_by("o_orderkey", by).alias("cheapest"))


@query("agg_11_bool_and_bits", """
SELECT l_suppkey, count_if(l_discount > 0.05) AS discounted, bool_and(l_quantity > 0) AS all_positive, bool_or(l_tax > 0.07) AS some_taxed,
  bit_and(l_linenumber) AS b_and, bit_or(l_linenumber) AS b_or, bit_xor(l_linenumber) AS b_xor, CAST(bit_count(bit_or(l_linenumber)) AS INTEGER) AS bits
FROM lineitem GROUP BY 1""")
def bool_and_bits(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
        F.bool_or(F.col("l_tax") > 0.07).alias("some_taxed"), F.bit_and("l_linenumber").alias("b_and"),
        F.bit_or("l_linenumber").alias("b_or"), F.bit_xor("l_linenumber").alias("b_xor"),
        F.bit_count(F.bit_or("l_linenumber")).alias("bits"))


@query("agg_12_average_speed", """
SELECT l_suppkey, round(sum(l_extendedprice), 2) AS distance, round(sum(l_extendedprice) / (sum(l_quantity) / 3600), 4) AS speed
FROM lineitem GROUP BY 1""")
def average_speed(t):
    stats = t.lineitem.groupBy("l_suppkey").agg(aggregates.speed("l_extendedprice", "l_quantity").alias("s"))
    return stats.select("l_suppkey", F.round("s.distance", 2).alias("distance"), F.round("s.speed", 4).alias("speed"))


@query("agg_13_sector_speeds", """
WITH laps AS (SELECT l_suppkey AS driver, l_partkey % 20 AS lap, l_linenumber AS sector, l_extendedprice AS dist, l_quantity AS secs FROM lineitem),
g AS (SELECT driver, lap, coalesce(sector, 0) AS sector, sum(dist) / (sum(secs) / 3600) AS speed
      FROM laps GROUP BY GROUPING SETS ((driver, lap, sector), (driver, lap))),
f AS (SELECT driver, lap, speed, row_number() OVER (PARTITION BY driver ORDER BY speed DESC, lap) AS rn FROM g WHERE sector = 0)
SELECT driver, lap, sector, round(speed, 4) AS speed FROM g
UNION ALL SELECT driver, lap, -1, round(speed, 4) FROM f WHERE rn = 1""")
def sector_speeds(t):
    laps = t.lineitem.select(F.col("l_suppkey").alias("driver"), (F.col("l_partkey") % 20).alias("lap"),
                             F.col("l_linenumber").alias("sector"), "l_extendedprice", "l_quantity")
    return aggregates.lap_speeds(laps, "driver", "lap", "sector", "l_extendedprice", "l_quantity")


@query("agg_14_per_group_function", """
WITH y AS (SELECT o_custkey % 25 AS grp, year(o_orderdate) AS o_year, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT grp, round(max(total) - min(total), 2) AS spread, CAST(arg_max(o_year, total) AS INTEGER) AS best_year FROM y GROUP BY 1""")
def per_group_function(t):
    """A Python function per group, fed with rows already totalled per group and year."""
    yearly = t.orders.groupBy((F.col("o_custkey") % 25).alias("grp"), F.year("o_orderdate").alias("o_year")).agg(
        F.sum("o_totalprice").alias("total"))

    def spread(pdf):
        import pandas as pd
        best = pdf.loc[pdf.total.idxmax()]
        return pd.DataFrame({"grp": [pdf.grp.iloc[0]], "spread": [round(pdf.total.max() - pdf.total.min(), 2)],
                             "best_year": [best.o_year]})

    return yearly.groupBy("grp").applyInPandas(spread, "grp long, spread double, best_year int")


@query("agg_15_pairwise_reduce", """
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 1""")
def pairwise_reduce(t):
    """Reduce by keeping the greater of two rows: ``max_by`` with partial aggregation."""
    best = t.orders.agg(F.max_by(F.struct("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")),
                                 F.struct("o_totalprice", -F.col("o_orderkey"))).alias("r"))
    return best.select("r.*")


@query("agg_16_all_match", """
WITH d AS (SELECT source, text, list_aggregate(list_transform(string_split(text, ' '), lambda x: CASE WHEN instr(x, 'e') > 0 THEN 1 ELSE 0 END), 'min') = 1 AS ok FROM documents)
SELECT source, count_if(ok) AS rows_all, bool_and(ok) AS group_all FROM d GROUP BY 1""")
def all_match(t):
    rows = t.documents.select("source", text.all_match("text", "e", " ").alias("ok"))
    return rows.groupBy("source").agg(F.count_if("ok").alias("rows_all"), F.bool_and("ok").alias("group_all"))


@query("agg_17_header_maps", """
SELECT event_type, count(DISTINCT props) AS maps, min(CAST(json_extract(props, '$.k') AS INTEGER)) AS least_k FROM events GROUP BY 1""")
def header_maps(t):
    """Each record's headers as a map; the distinct maps are counted and compared, not listed."""
    headers = t.events.select("event_type", F.map_from_entries(F.array(F.struct(
        F.lit("k"), F.get_json_object("props", "$.k")))).alias("h")).select("event_type", F.to_json("h").alias("h")).distinct()
    k = F.from_json("h", "map<string,string>")["k"].cast("int")
    return headers.groupBy("event_type").agg(F.count(F.lit(1)).alias("maps"), F.min(k).alias("least_k"))


@query("agg_18_total_across_tables", """
SELECT k, round(sum(v), 2) AS total FROM (SELECT c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1""")
def total_across_tables(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    return relational.total_across([a, b], ["k"], "v", "total").select("k", F.round("total", 2).alias("total"))


@query("agg_19_most_frequent", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM c QUALIFY rank() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def most_frequent(t):
    return relational.top_values(t.events, ["user_id"], "event_type")


@query("agg_20_greedy_allocation", """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(28,6)) AS qty,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
r AS (SELECT o_custkey, o_orderkey, rn, qty AS computed, CASE WHEN qty <= 800000.5 THEN qty ELSE 0 END AS total FROM o WHERE rn = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.rn, r.total + o.qty, CASE WHEN r.total + o.qty <= 800000.5 THEN r.total + o.qty ELSE r.total END
  FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.rn = r.rn + 1)
SELECT o_custkey, o_orderkey, CAST(computed AS DOUBLE) AS computed, CASE WHEN computed <= 800000.5 THEN 'ok' ELSE 'ko' END AS control FROM r""")
def greedy_allocation(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("qty"),
                           F.lit(800000.5).alias("room"))
    out = relational.allocate(rows, ["o_custkey"], "o_orderkey", "qty", "room")
    return out.select("o_custkey", "o_orderkey", "computed", "control")
