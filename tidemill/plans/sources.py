"""Source queries over the driver tables."""

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.operators import nested
from tidemill.plans.registry import query
from tidemill.sources import messages, readers, schemas, writers
from tidemill.streaming.sinks import new_folder


@query("src_03_scan", """
SELECT l_returnflag, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_discount > 0.05 GROUP BY 1""")
def scan(t):
    late = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return t.lineitem.where(late & (F.col("l_discount") > 0.05)).groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("src_04_json_in_strings", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_in_strings(t):
    return schemas.parse_json(t.events.select("event_id", "props"), "props", "k:long").select("event_id", "k")


@query("src_06_xml", "SELECT p_partkey, p_brand AS brand, p_size AS size, p_name AS name FROM part")
def xml(t):
    """Each part written as an XML text with attributes and read back."""
    rows = t.part.select("p_partkey", F.to_xml(F.struct(F.col("p_brand").alias("_brand"), F.col("p_size").alias("_size"),
                                                        F.col("p_name").alias("name")), {"rowTag": "part"}).alias("doc"))
    out = readers.parse_xml(rows, "doc", "_brand string, _size int, name string")
    return out.select("p_partkey", F.col("_brand").alias("brand"), F.col("_size").alias("size"), "name")


@query("src_11_partition_values", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) IN (1996, 1998) AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def partition_values(t):
    """The orders are written in folders by year and priority; two years and two priorities of them are read."""
    path = new_folder(t.spark, "partitions")
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("o_year"), "o_orderpriority")
    writers.write(rows, "parquet", path, partition_by=["o_year", "o_orderpriority"], repartition_by=["o_year", "o_orderpriority"])
    rows = readers.read_partitions(t.spark, path, {"o_year": [1996, 1998, 2050], "o_orderpriority": ["1-URGENT", "2-HIGH", "9-NONE"]})
    return rows.select("o_orderkey", "o_orderpriority")


@query("src_12_run_time_schema", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2 AS n_tags FROM events""")
def run_time_schema(t):
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.array("event_type", F.lit("x")).alias("tags")))
    return schemas.parse_json(t.events.select("event_id", body.alias("body")), "body", "k:long~tags:array(string)").select(
        "event_id", "k", F.size("tags").alias("n_tags"))


@query("src_15_record_shapes", """
SELECT 'short' AS shape, event_id AS id, event_type AS kind, '' AS user_id FROM events WHERE event_type IN ('view', 'click')
UNION ALL SELECT 'long', event_id, event_type, CAST(user_id AS VARCHAR) FROM events WHERE event_type NOT IN ('view', 'click')""")
def record_shapes(t):
    short = F.col("event_type").isin("view", "click")
    lines = t.events.select(F.when(short, F.concat_ws("~", F.col("event_id").cast("string"), "event_type")).otherwise(
        F.concat_ws("~", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))).alias("value"))
    parts = readers.by_field_count(lines, {"short": ["id", "kind"], "long": ["id", "kind", "user_id"]})
    both = parts["short"].withColumn("user_id", F.lit("")).withColumn("shape", F.lit("short")).unionByName(
        parts["long"].withColumn("shape", F.lit("long")))
    return both.select("shape", F.col("id").cast("bigint").alias("id"), "kind", "user_id")


@query("src_19_catalog_columns", "SELECT p_partkey AS id, p_size AS size, p_brand AS brand FROM part")
def catalog_columns(t):
    cells = F.create_map(F.lit("a:size"), F.col("p_size").cast("string"), F.lit("b:brand"), F.col("p_brand"))
    catalog = """{"columns": {"id": {"cf": "rowkey", "col": "p_partkey", "type": "long"},
        "size": {"cf": "a", "col": "size", "type": "int"}, "brand": {"cf": "b", "col": "brand", "type": "string"}}}"""
    return schemas.catalog_columns(t.part.select("p_partkey", cells.alias("cells")), catalog)


@query("src_20_sql_text", """
SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1""")
def sql_text(t):
    return readers.sql(t.spark, """SELECT n_name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        GROUP BY n_name HAVING count(*) > 1""", customer=t.customer, nation=t.nation)


@query("msg_two_layer", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase'")
def two_layer(t):
    """Events wrapped as outer and inner JSON, routed by type and unwrapped."""
    inner = F.to_json(F.struct("event_id", "user_id"))
    outer = t.events.select(F.to_json(F.struct(F.col("event_type").alias("messageType"), F.col("ts").cast("timestamp").alias("messageTimestamp"),
                                               inner.alias("incomingMessage"))).alias("value"))
    out = messages.two_layer(outer, "event_id bigint, user_id bigint", "purchase")
    return out.select("payload.event_id", F.col("messageType").alias("event_type"), "payload.user_id")


@query("str_17_header_filter", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) IN (7, 8)")
def header_filter(t):
    headers = F.array(F.struct(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"), F.encode("event_type", "UTF-8").alias("value")))
    return messages.with_header(t.events.select("event_id", headers.alias("headers")), ["k7", "k8"]).select("event_id")


@query("str_27_json_messages", "SELECT CAST(p_partkey AS VARCHAR) AS key, '{\"p_partkey\":' || p_partkey || ',\"p_brand\":\"' || p_brand || '\"}' AS value FROM part")
def json_messages(t):
    return messages.as_json_messages(t.part.select("p_partkey", "p_brand"), "p_partkey")


@query("prj_09_add_column_after", "SELECT p_partkey, p_size, p_size * 2 AS doubled, p_brand FROM part")
def add_column_after(t):
    return nested.add_column_after(t.part.select("p_partkey", "p_size", "p_brand"), "p_size", "doubled", F.col("p_size") * 2)


@query("src_16_first_and_last", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY 1""")
def first_and_last(t):
    """Events are written as lines of a file for each day, in order; the ends of the files are read."""
    path = new_folder(t.spark, "lines")
    rows = t.events.select(dates.day_text("ts").alias("day"), "ts", "event_id").repartition("day").sortWithinPartitions("day", "ts", "event_id")
    rows.select("day", F.col("event_id").cast("string").alias("value")).write.partitionBy("day").text(path)
    ends = readers.first_and_last_line(t.spark, path)
    return ends.select(F.regexp_extract("file", "day=([0-9-]+)", 1).alias("day"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))
