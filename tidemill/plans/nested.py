"""Nested-data queries."""

from pyspark.sql import functions as F

from tidemill.functions import dates, text
from tidemill.operators import nested
from tidemill.plans.registry import query
from tidemill.sources.messages import order_items


def order_documents(t):
    """One nested document per order. Lines are totalled per flag first, so an item list is as short as the flag domain."""
    lines = (t.lineitem.groupBy("l_orderkey", "l_returnflag")
             .agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price")))
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("l_returnflag").alias("flag"), F.struct("qty", "price").alias("amount")))).alias("items"))
    return items.select(F.col("l_orderkey").alias("k"), F.struct(F.lit("EUR").alias("currency"), "items").alias("info"))


_DOCS = """WITH l AS (SELECT l_orderkey AS k, l_returnflag AS flag, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2)
"""


@query("nest_01_add", _DOCS + "SELECT k, flag, 'new' AS tag, qty FROM l")
def add(t):
    out = nested.add_nested(order_documents(t), "info.items.amount.tag", F.lit("new"))
    return out.select("k", F.explode("info.items").alias("i")).select("k", "i.flag", "i.amount.tag", "i.amount.qty")


@query("nest_02_add_extended", _DOCS + "SELECT k, flag, k || '-' || flag || '-EUR' AS id FROM l")
def add_extended(t):
    out = nested.add_nested(order_documents(t), "info.items.amount.id", lambda get: F.concat_ws(
        "-", get("k").cast("string"), get("info.items.flag"), get("info.currency")))
    return out.select("k", F.explode("info.items").alias("i")).select("k", "i.flag", "i.amount.id")


@query("nest_03_drop", _DOCS + "SELECT k, '{\"flag\":\"' || flag || '\",\"amount\":{\"qty\":' || qty || '}}' AS item FROM l")
def drop(t):
    out = nested.drop_nested(order_documents(t), "info.items.amount.PRICE")
    return out.select("k", F.explode("info.items").alias("i")).select("k", F.to_json("i").alias("item"))


@query("nest_04_map", _DOCS + "SELECT k, flag, qty * 2 AS doubled, lower(flag) AS low FROM l")
def map_field(t):
    out = nested.map_nested(order_documents(t), "info.items.amount.qty", "doubled", lambda x: x * 2)
    out = nested.map_nested(out, "info.items.flag", "low", F.lower)
    return out.select("k", F.explode("info.items").alias("i")).select("k", "i.flag", "i.amount.doubled", "i.low")


@query("nest_05_struct_map", _DOCS + "SELECT k, flag, round(price / qty, 9) AS unit, 'EUR' AS currency FROM l")
def struct_map(t):
    out = nested.map_nested_struct(order_documents(t), "info.items.amount.*", "unit", lambda s: F.round(s["price"] / s["qty"], 9))
    out = nested.map_nested_struct(out, "info.items.*", "currency", lambda s, get: get("info.currency"))
    return out.select("k", F.explode("info.items").alias("i")).select("k", "i.flag", "i.amount.unit", "i.currency")


@query("nest_06_map_with_errors", _DOCS + """
SELECT k, count(*)::INTEGER AS items, coalesce(string_agg(DISTINCT CASE WHEN qty > 60 THEN 'too much ' || flag END, ',' ORDER BY CASE WHEN qty > 60 THEN 'too much ' || flag END), '') AS errors
FROM l GROUP BY k""")
def map_with_errors(t):
    out = nested.map_with_errors(order_documents(t), "info.items.amount.qty", "checked", lambda x, get: x,
                                 lambda x, get: F.when(x > 60, F.concat(F.lit("too much "), get("info.items.flag"))))
    return out.select("k", F.size("info.items").alias("items"), F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query("nest_07_gather_errors", _DOCS + "SELECT k, count(*)::INTEGER + 1 AS n_errors, 'root' AS first FROM l GROUP BY k")
def gather(t):
    docs = nested.add_nested(order_documents(t), "info.items.errs", lambda get: F.array(get("info.items.flag"), get("info.items.flag")))
    out = nested.gather_errors(docs.withColumn("errors", F.array(F.lit("root"))), "info.items.errs", "errors")
    return out.select("k", F.size("errors").alias("n_errors"), F.col("errors")[0].alias("first"))


@query("nest_09_flatten", _DOCS + "SELECT k, 'EUR' AS info_currency, count(*)::INTEGER AS n FROM l GROUP BY k")
def flatten(t):
    return nested.flatten_structs(order_documents(t)).select("k", "info_currency", F.size("info_items").alias("n"))


@query("nest_10_deep_flatten", _DOCS + "SELECT k, 'EUR' AS info_currency, flag AS info_items_flag, qty AS info_items_amount_qty, price AS info_items_amount_price FROM l")
def deep_flatten(t):
    return nested.deep_flatten(order_documents(t))


@query("nest_10_relational_split", _DOCS + """, d AS (SELECT DISTINCT l_orderkey AS k, CAST(l_shipdate AS DATE) AS s FROM lineitem),
i AS (SELECT k, count(*)::INTEGER AS items, sum(qty) AS qty, min(flag) AS first_flag FROM l GROUP BY k)
SELECT i.k, items, qty, first_flag, count(*)::INTEGER AS dates, strftime(max(s), '%Y-%m-%d') AS last_date FROM i JOIN d ON i.k = d.k GROUP BY ALL""")
def relational_split(t):
    """Documents with two arrays side by side, split into a frame for each and put together again."""
    sent = t.lineitem.select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("day")).distinct()
    sent = sent.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(dates.day_text("day").alias("day")))).alias("dates"))
    frames = nested.split_documents(order_documents(t).join(sent, "k"))
    docs = nested.join_documents(frames)
    qty = F.aggregate("info_items", F.lit(0.0), lambda s, x: s + x["amount_qty"])
    return docs.select("k", F.size("info_items").alias("items"), qty.alias("qty"), F.col("info_items")[0]["flag"].alias("first_flag"),
                       F.size("dates").alias("dates"), F.element_at("dates", -1)["day"].alias("last_date"))


@query("nest_11_explode_list", """
WITH w AS (SELECT source, unnest(string_split(lang || ',' || source, ',')) AS tag, n_chars FROM documents)
SELECT tag, CAST(sum(n_chars) AS BIGINT) AS chars FROM w GROUP BY 1""")
def explode_list(t):
    tags = t.documents.select(F.explode(F.split(F.concat_ws(",", "lang", "source"), ",")).alias("tag"), "n_chars")
    return tags.groupBy("tag").agg(F.sum("n_chars").alias("chars"))


@query("nest_13_url_categories", """
WITH u AS (SELECT page_id, split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1) AS path, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page_no FROM pages)
SELECT page_id, split_part(path, '/', 2) AS category, coalesce(page_no, '') AS page_no, split_part(path, '/', 2) IN ('en', 'fr') AS registered FROM u""")
def url_categories(t):
    path = F.split(F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "/")
    asked = F.str_to_map(F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2)), F.lit("&"), F.lit("="))
    urls = t.pages.select("page_id", F.get(path, F.lit(1)).alias("category"), F.coalesce(asked["page"], F.lit("")).alias("page_no"))
    return urls.withColumn("registered", F.col("category").isin("en", "fr"))


@query("nest_14_tags", """
WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS tag FROM conversations)
SELECT tag, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM w GROUP BY 1""")
def tag_counts(t):
    words = t.conversations.select("conv_id", "role", F.explode(text.tags("text", "([A-Z][a-z]{5,})")).alias("tag")).distinct()
    return words.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query("nest_15_json_settings", """
SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k, coalesce(json_extract_string(props, '$.mode'), 'default') AS mode FROM events""")
def json_settings(t):
    parsed = t.events.select("event_id", F.from_json("props", "k int, mode string").alias("p")).select("event_id", "p.*")
    return parsed.na.fill({"k": 0, "mode": "default"})


@query("nest_16_order_grammar", """
SELECT DISTINCT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'INS' ELSE 'UPD' END AS verb, l_partkey AS item_id, CAST(l_quantity AS INTEGER) AS qty,
  CASE WHEN l_discount > 0.05 THEN CAST(round(l_discount * 100) AS INTEGER) ELSE 0 END AS discount
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""")
def order_grammar(t):
    """Messages ``VERB||orderId::..+orderItems::(id~qty~..),(..)`` built from orders and parsed back.
    One message takes the items of a hundred part ids, so its length is bounded by their domain."""
    known = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount").join(known, "l_orderkey", "left_semi")  # grouped below in the same hash by order
    pct = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    item, qty = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
    rebated = F.col("l_discount") > 0.05
    ins = F.concat_ws("~", item, qty, F.when(rebated, "Y").otherwise("N"), F.lit("D"), F.when(rebated, pct).otherwise("0"), F.lit("10"))
    upd = F.concat_ws("~", item, qty, F.lit("10"), F.when(rebated, "D").otherwise("NA"), F.when(rebated, pct).otherwise("0"))
    even = F.col("l_orderkey") % 2 == 0
    messages = lines.groupBy("l_orderkey", F.floor(F.col("l_partkey") / 100)).agg(F.concat(F.lit("("), F.array_join(
        F.collect_set(F.when(even, ins).otherwise(upd)), "),("), F.lit(")")).alias("items"))
    verb = F.when(F.col("l_orderkey") % 2 == 0, "INS").otherwise("UPD")
    messages = messages.select(F.concat(verb, F.lit("||orderId::"), F.col("l_orderkey").cast("string"), F.lit("+orderItems::"),
                                        "items").alias("message"))
    out = order_items(messages, "message")
    return out.select(F.col("orderId").cast("bigint").alias("order_id"), "verb", F.col("item_id").cast("bigint").alias("item_id"),
                      "qty", F.coalesce("discount", F.lit(0)).alias("discount"))

