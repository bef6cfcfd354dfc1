"""User-defined function queries."""

import pandas as pd
from pyspark.sql import functions as F

from tidemill.functions import dates, udfs
from tidemill.plans.registry import query


@query("udf_01_registered", """
SELECT CASE WHEN lower(trim(c_mktsegment)) IN ('building', 'household') THEN 'Home' ELSE 'Others' END AS category, count(*) AS n FROM customer GROUP BY 1""")
def registered(t):
    udfs.register(t.spark, "home_or_not", udfs.lookup_category({"Home": ["building", "household"]}, "Others"), "string")
    return t.spark.sql("SELECT home_or_not(c_mktsegment) AS category, count(*) AS n FROM {c} GROUP BY 1", c=t.customer)


@query("udf_02_column_function", "SELECT p_partkey, CASE WHEN p_type IN ('PROMO') THEN 'cheap' ELSE 'full' END AS price FROM part")
def column_function(t):
    price = F.pandas_udf(udfs.lookup_category({"cheap": ["promo"]}, "full"), "string")
    return t.part.select("p_partkey", price("p_type").alias("price"))


@query("udf_03_array_result", """
SELECT o_orderkey, CAST(count_if(isodow(d) < 6) AS INTEGER) AS week, CAST(count_if(isodow(d) >= 6) AS INTEGER) AS weekend FROM
 (SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 9 DAY, INTERVAL 1 DAY)) AS d FROM orders) GROUP BY 1""")
def array_result(t):
    kinds = F.pandas_udf(udfs.day_kinds, "array<int>")
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("a"))
    rows = rows.select("o_orderkey", kinds("a", F.col("a") + F.expr("interval 10 days")).alias("k"))
    return rows.select("o_orderkey", F.col("k")[0].alias("week"), F.col("k")[1].alias("weekend"))


@query("udf_04_aggregate", "SELECT l_suppkey, round(sum(l_extendedprice) / (sum(l_quantity) / 3600), 4) AS speed FROM lineitem GROUP BY 1")
def aggregate(t):
    """Sums per supplier and ship month are made first, so the Python function sees a few rows per group."""
    sums = t.lineitem.groupBy("l_suppkey", F.date_trunc("month", "l_shipdate")).agg(
        F.sum("l_extendedprice").alias("d"), F.sum("l_quantity").alias("s"))
    speed = F.pandas_udf(udfs.weighted_speed, "double")
    return sums.groupBy("l_suppkey").agg(speed("d", "s").alias("speed")).select("l_suppkey", F.round("speed", 4).alias("speed"))


@query("udf_05_row_to_rows", """
WITH m AS (SELECT event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS a FROM events)
SELECT event_id, unnest(generate_series(a // 15, (a + 39) // 15)) * 15 AS slot FROM m""")
def row_to_rows(t):
    minute = F.floor(F.unix_timestamp("ts") / 60)
    rows = t.events.select("event_id", minute.alias("a"), (minute + 40).alias("b"))
    return udfs.row_to_rows(rows, udfs.slots("a", "b"), "slot long").select("event_id", "slot")


@query("udf_06_per_group", "SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS busiest FROM events GROUP BY event_type, CAST(ts AS DATE) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(ts AS DATE)) = 1")
def per_group(t):
    daily = t.events.groupBy("event_type", dates.day_text("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))

    def busiest(pdf: pd.DataFrame) -> pd.DataFrame:
        top = pdf.sort_values(["n", "day"], ascending=[False, True]).iloc[0]
        return pd.DataFrame({"event_type": [top.event_type], "busiest": [top.day]})

    return daily.groupBy("event_type").applyInPandas(busiest, "event_type string, busiest string")


@query("udf_07_per_partition", "SELECT event_id, round(value * 2, 2) AS doubled FROM events")
def per_partition(t):
    def double(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": pdf["event_id"], "doubled": (pdf["value"] * 2).round(2)})
    return udfs.per_partition(t.events.select("event_id", "value"), double, "event_id long, doubled double")
