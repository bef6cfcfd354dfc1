"""Data-quality, reconciliation and audit queries."""

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.operators import quality
from tidemill.plans.registry import query


@query("dq_01_metrics", """
SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'Column', 'l_tax', 'Completeness', count(l_tax) / count(*) FROM lineitem
UNION ALL SELECT 'Column', 'l_quantity', 'Mean', round(avg(l_quantity), 6) FROM lineitem
UNION ALL SELECT 'Column', 'big', 'Compliance', round(count_if(l_quantity > 40) / count(*), 6) FROM lineitem
UNION ALL SELECT 'Multicolumn', 'l_quantity,l_extendedprice', 'Correlation', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem""")
def metrics(t):
    out = quality.metrics(t.lineitem, complete=["l_tax"], mean=["l_quantity"], compliance={"big": F.col("l_quantity") > 40},
                          correlation=[("l_quantity", "l_extendedprice")])
    return out.withColumn("value", F.round("value", 6))


@query("dq_02_checks", """
SELECT 'has size' AS constraint_name, CASE WHEN count(*) > 0 THEN 'Success' ELSE 'Failure' END AS status FROM orders
UNION ALL SELECT 'price not negative', CASE WHEN min(o_totalprice) >= 0 THEN 'Success' ELSE 'Failure' END FROM orders
UNION ALL SELECT 'price below 100', CASE WHEN max(o_totalprice) < 100 THEN 'Success' ELSE 'Failure' END FROM orders
UNION ALL SELECT 'status contained', CASE WHEN bool_and(o_orderstatus IN ('F', 'O', 'P')) THEN 'Success' ELSE 'Failure' END FROM orders
UNION ALL SELECT 'complete o_custkey', CASE WHEN count(o_custkey) = count(*) THEN 'Success' ELSE 'Failure' END FROM orders
UNION ALL SELECT 'unique o_orderkey', CASE WHEN count(DISTINCT o_orderkey) = count(*) THEN 'Success' ELSE 'Failure' END FROM orders
UNION ALL SELECT 'unique o_custkey', CASE WHEN count(DISTINCT o_custkey) = count(*) THEN 'Success' ELSE 'Failure' END FROM orders""")
def checks(t):
    return quality.checks(t.orders, {
        "has size": F.count(F.lit(1)) > 0, "price not negative": F.min("o_totalprice") >= 0,
        "price below 100": F.max("o_totalprice") < 100,
        "status contained": F.bool_and(F.col("o_orderstatus").isin("F", "O", "P")),
        "complete o_custkey": F.count("o_custkey") == F.count(F.lit(1))}, unique=["o_orderkey", "o_custkey"])


def layer_stats(t):
    bronze = t.events.select("event_id", F.to_date("ts").alias("day"))
    return quality.layer_counts(bronze, bronze.where("event_id % 50 <> 7 or day > date '2024-01-20'"), "day")


_LAYERS = """b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS upper_rows, count_if(event_id % 50 <> 7 OR CAST(ts AS DATE) > DATE '2024-01-20') AS lower_rows FROM events GROUP BY 1)"""


@query("dq_03_layer_reconciliation", "WITH " + _LAYERS + """
SELECT strftime(b.day, '%Y-%m-%d') AS day, b.upper_rows, b.lower_rows, b.upper_rows - b.lower_rows AS diff, b.upper_rows - coalesce(p.upper_rows, 0) AS diff_to_day_before
FROM b LEFT JOIN b p ON b.day = p.day + 1""")
def layer_reconciliation(t):
    return layer_stats(t).withColumn("day", dates.day_text("day"))


@query("dq_04_days_to_reload", "WITH " + _LAYERS + " SELECT strftime(day, '%Y-%m-%d') AS day FROM b WHERE upper_rows <> lower_rows")
def days_to_reload(t):
    runs = layer_stats(t).withColumn("run", F.lit(2)).unionByName(
        layer_stats(t).withColumn("diff", F.lit(1).cast("bigint")).withColumn("run", F.lit(1)))
    return quality.reload_days(runs, "run", "day").select(dates.day_text("day").alias("day"))


def audit_rows(t):
    """Events read as audit rows: one run per day, one step per event type."""
    status = F.when(F.col("event_id") % 3 == 0, "failed").otherwise("success")
    return t.events.select(F.to_date("ts").alias("run"), F.col("event_type").alias("step"), status.alias("status"),
                           F.struct("ts", "event_id").alias("at"))


_AUDIT = """a AS (SELECT CAST(ts AS DATE) AS run, event_type AS step, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status FROM events
 QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) = 1)"""


@query("dq_05_last_status", "WITH " + _AUDIT + " SELECT strftime(run, '%Y-%m-%d') AS run, step, status FROM a")
def last_status(t):
    return quality.last_status(audit_rows(t), "run", "step", "status", "at").select(dates.day_text("run").alias("run"), "step", "status")


@query("dq_06_restart_point", "WITH " + _AUDIT + """, s AS (SELECT DISTINCT event_type AS step FROM events)
SELECT strftime(r.run, '%Y-%m-%d') AS run, min(s.step) AS restart_at FROM (SELECT DISTINCT run FROM a) r CROSS JOIN s LEFT JOIN a ON a.run = r.run AND a.step = s.step
WHERE coalesce(a.status, 'missing') <> 'success' GROUP BY r.run""")
def restart_point(t):
    steps = ["click", "error", "purchase", "signup", "view"]
    return (quality.restart_point(audit_rows(t), steps, "run", "step", "status", "at")
            .select(dates.day_text("run").alias("run"), "restart_at"))
