"""Queries that write a table out in some layout and read it back through the readers."""

from pyspark.sql import functions as F

from tidemill.plans.registry import query
from tidemill.sources import readers, redo, schemas, writers
from tidemill.streaming import batches
from tidemill.streaming.sinks import new_folder


@query("src_01_delimited_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def delimited_round_trip(t):
    """Header, own delimiter and a given schema."""
    path, rows = new_folder(t.spark, "csv"), t.customer.select("c_custkey", "c_name", "c_acctbal")
    writers.write(rows, "csv", path, header="true", sep="|")
    return readers.read(t.spark, "csv", path, schema=rows.schema, sep="|")


@query("src_02_headerless_round_trip", "SELECT s_suppkey, s_acctbal FROM supplier")
def headerless_round_trip(t):
    path, rows = new_folder(t.spark, "csv"), t.supplier.select("s_suppkey", "s_acctbal")
    writers.write(rows, "csv", path, sep="~")
    return readers.read(t.spark, "csv", path, schema=rows.schema, names="s_suppkey, s_acctbal", sep="~")


@query("src_05_orc_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def orc_round_trip(t):
    path = new_folder(t.spark, "orc")
    writers.write(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "orc", path)
    return readers.read(t.spark, "orc", path)


@query("src_11_read_partitions", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) IN (1996, 1998) AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def read_partitions(t):
    """Only the folders asked for are listed and read; a value without a folder is skipped."""
    path = new_folder(t.spark, "orders")
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("o_year"))
    writers.write(rows, "parquet", path, partition_by=["o_year", "o_orderpriority"], repartition_by=["o_year", "o_orderpriority"])
    wanted = {"o_year": [1996, 1998, 2050], "o_orderpriority": ["1-URGENT", "2-HIGH", "9-NONE"]}
    return readers.read_partitions(t.spark, path, wanted).select("o_orderkey", "o_orderpriority")


@query("snk_04_dynamic_overwrite", """
SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name FROM nation""")
def dynamic_overwrite(t):
    path, rows = new_folder(t.spark, "nations"), t.nation.select("n_nationkey", "n_name", "n_regionkey")
    writers.replace_partitions(rows, path, ["n_regionkey"])
    writers.replace_partitions(rows.where("n_regionkey = 1").withColumn("n_name", F.lower("n_name")), path, ["n_regionkey"])
    return t.spark.read.schema(rows.schema).parquet(path).select("n_nationkey", "n_regionkey", "n_name")


@query("snk_09_compaction", "SELECT event_id, user_id, value FROM events")
def compaction(t):
    folder = new_folder(t.spark, "events")
    writers.write(t.events.select("event_id", "user_id", "value"), "parquet", f"{folder}/small", repartition=20)
    writers.compact(t.spark, f"{folder}/small", f"{folder}/big")
    return t.spark.read.parquet(f"{folder}/big")


@query("src_10_lines", "SELECT CAST(event_id AS VARCHAR) || ' ' || event_type AS value FROM events")
def lines(t):
    path = new_folder(t.spark, "lines")
    writers.write(t.events.select(F.concat_ws(" ", "event_id", "event_type").alias("value")), "text", path)
    return readers.read_lines(t.spark, path, 8)


@query("src_14_rejects", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 3) THEN 'reject' ELSE 'good' END AS kind, CASE WHEN o_orderkey % 7 NOT IN (0, 3) THEN o_custkey ELSE -1 END AS o_custkey FROM orders""")
def rejects(t):
    """Lines of orders, some with a word for a number, some with a field too many."""
    path, k = new_folder(t.spark, "rejects"), F.col("o_orderkey")
    line = F.concat_ws(",", k, F.when(k % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string")), F.when(k % 7 == 3, "more"))
    writers.write(t.orders.select(line.alias("value")), "text", path)
    good, bad = readers.read_with_rejects(t.spark, path, "o_orderkey bigint, o_custkey bigint")
    bad = bad.select(F.split("_reject", ",")[0].cast("bigint").alias("o_orderkey"), F.lit("reject").alias("kind"), F.lit(-1).cast("bigint").alias("o_custkey"))
    return good.select("o_orderkey", F.lit("good").alias("kind"), "o_custkey").unionByName(bad)


@query("src_18_variants", """
SELECT p_brand AS chrom, p_partkey AS pos, p_size::DOUBLE AS qual, p_type AS kind, CASE WHEN p_size > 25 THEN '1|1' ELSE '0|1' END AS sample FROM part""")
def variants(t):
    """Parts as variant calls: header lines, fields by tabs, a map of details, a sample column."""
    path = new_folder(t.spark, "variants")
    detail = F.concat(F.lit("TYPE="), "p_type", F.lit(";DB"))
    sample = F.when(F.col("p_size") > 25, "1|1").otherwise("0|1")
    calls = t.part.select(F.concat_ws("\t", "p_brand", "p_partkey", F.lit("."), F.lit("A"), F.lit("T"), "p_size", F.lit("PASS"), detail, F.lit("GT"), sample).alias("value"))
    head = t.region.select(F.concat(F.lit("##region="), "r_name").alias("value"))
    writers.write(head.unionByName(calls), "text", path)
    found = readers.read_vcf(t.spark, path)
    return found.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("QUAL").alias("qual"), F.col("INFO")["TYPE"].alias("kind"),
                        F.element_at("SAMPLES", -1).alias("sample"))


@query("prj_08_clean_names", "SELECT o_orderkey AS order_key, o_totalprice AS total_price FROM orders")
def clean_names(t):
    return schemas.clean_names(t.orders.select("o_orderkey", "o_totalprice").toDF(" order  key", "total price "))


@query("nest_12_team_documents", """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity)::INTEGER AS p FROM lineitem GROUP BY 1, 2), s AS (SELECT k, sum(p)::INTEGER AS made FROM l GROUP BY 1)
SELECT 'T' || l.k AS team, 'D' || n AS driver, p AS driver_points, made AS team_points, (l.k % 5)::INTEGER AS pit_stop_points FROM l JOIN s ON l.k = s.k""")
def team_documents(t):
    """An order is a team, its lines are drivers; documents are written as text and read as XML."""
    path = new_folder(t.spark, "teams")
    made = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("p"))
    driver = F.concat(F.lit('<driver raceEntries="1" nationality="x"><driverName>D'), "l_linenumber", F.lit("</driverName><avgFinishPosition>1</avgFinishPosition><points>"), "p",
                      F.lit("</points></driver>"))
    teams = made.groupBy("l_orderkey").agg(F.array_join(F.collect_list(driver), "").alias("drivers"), (F.sum("p") + F.col("l_orderkey") % 5).alias("points"))
    document = F.concat(F.lit("<x><Teams><team><teamName>T"), "l_orderkey", F.lit("</teamName><constructorPoints>"), "points",
                        F.lit("</constructorPoints><constructorStanding>1st</constructorStanding><drivers>"), "drivers", F.lit("</drivers></team></Teams></x>"))
    writers.write(teams.select(document.alias("value")), "text", path)
    rows = readers.team_rows(readers.read_lines(t.spark, path), "value")
    return rows.select(F.col("teamName").alias("team"), F.col("driverName").alias("driver"), F.col("driverPoints").alias("driver_points"),
                       F.col("teamPoints").alias("team_points"), F.col("pitStopPoints").alias("pit_stop_points"))


@query("str_26_triggered_recompute", """
SELECT o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN count(*) ELSE count_if(o_orderkey % 2 = 0) END AS orders FROM orders GROUP BY 1""")
def triggered_recompute(t):
    """Totals of half the orders; then all orders are there, and a trigger names two priorities, whose totals alone are made anew."""
    folder = new_folder(t.spark, "triggered")
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    fn = batches.recompute_affected(lambda s: s.read.parquet(f"{folder}/orders"), ["o_orderpriority"],
                                    lambda df: df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders")), f"{folder}/totals")
    writers.write(rows.where("o_orderkey % 2 = 0"), "parquet", f"{folder}/orders")
    fn(rows.select("o_orderpriority"), 0)
    writers.write(rows.where("o_orderkey % 2 = 1"), "parquet", f"{folder}/orders", mode="append")
    fn(rows.where("o_orderpriority in ('1-URGENT', '5-LOW')").select("o_orderpriority"), 1)
    return redo.read_table(t.spark, f"{folder}/totals").select("o_orderpriority", "orders")


@query("str_28_two_writers", """
SELECT 'customers' AS writer, c_custkey AS id, c_mktsegment AS segment, -1::DOUBLE AS balance FROM customer UNION ALL SELECT 'suppliers', s_suppkey, '-', s_acctbal FROM supplier""")
def two_writers(t):
    """Two writers append with columns of their own; a batch that runs twice is there once."""
    path = new_folder(t.spark, "parties")
    for _ in range(2):
        batches.append_with_own_schema(path, "customers")(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), 0)
    batches.append_with_own_schema(path, "suppliers")(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), 0)
    rows = t.spark.read.option("mergeSchema", "true").parquet(path)
    return rows.select("writer", "id", "segment", "balance").na.fill({"segment": "-", "balance": -1.0})
