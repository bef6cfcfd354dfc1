"""One query per family of scalar functions."""

from pyspark.sql import functions as F

from tidemill.functions import dates, text
from tidemill.plans.registry import query


@query("fn_01_string", """
SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim('  ' || c_mktsegment || ' ') AS tr, substring(c_name, 1, 8) AS sub,
  instr(c_name, '#') AS ins, strpos(c_name, '00') AS loc, concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR)) AS cat, concat_ws('|', c_name, c_mktsegment) AS ws,
  split_part(c_name, '#', 2) AS part2, replace(c_name, 'Customer', 'C') AS rep, regexp_replace(c_name, '0+', '0', 'g') AS rex, length(c_name) AS len,
  reverse(c_mktsegment) AS rev, 'Client' || substring(c_name, 9) AS ovl FROM customer""")
def string(t):
    return t.customer.select(
        "c_custkey", F.lower("c_name").alias("lo"), F.upper("c_mktsegment").alias("up"),
        F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("tr"), F.substring("c_name", 1, 8).alias("sub"),
        F.instr("c_name", "#").alias("ins"), F.locate("00", "c_name").alias("loc"),
        F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("cat"),
        F.concat_ws("|", "c_name", "c_mktsegment").alias("ws"), F.split("c_name", "#", 2)[1].alias("part2"),
        F.replace("c_name", F.lit("Customer"), F.lit("C")).alias("rep"), F.regexp_replace("c_name", "0+", "0").alias("rex"),
        F.length("c_name").alias("len"), F.reverse("c_mktsegment").alias("rev"),
        F.overlay("c_name", F.lit("Client"), F.lit(1), F.lit(8)).alias("ovl"))


@query("fn_02_text_rules", """
SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS the_count,
  CASE WHEN len(string_split(text, 'an')) > 3 THEN length(array_to_string(string_split(text, 'an')[1:3], 'an')) + 1 ELSE 0 END AS third_an,
  len(regexp_extract_all(text, '[A-Z][a-z]+')) AS capitalised FROM documents""")
def text_rules(t):
    return t.documents.select("doc_id", text.occurrences("text", "the").alias("the_count"),
                              text.nth_index("text", "an", 3).alias("third_an"),
                              F.size(text.tags("text", "([A-Z][a-z]+)")).cast("bigint").alias("capitalised"))


@query("fn_02_camel_case", """
SELECT p_partkey, lower(left(p_name, 1)) || substring(split_part(p_name, ' ', 1), 2) || upper(left(split_part(p_name, ' ', 2), 1)) || substring(split_part(p_name, ' ', 2), 2) AS camel FROM part""")
def camel(t):
    return t.part.select("p_partkey", text.camel_case("p_name").alias("camel"))


@query("fn_03_date", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS plus2, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS add10,
  strftime(o_orderdate - INTERVAL 10 DAY, '%Y-%m-%d') AS sub10, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS days,
  CAST(day(o_orderdate) AS INTEGER) AS dom, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(quarter(o_orderdate) AS INTEGER) AS q,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS mon, CAST(epoch(o_orderdate) AS BIGINT) AS unix, strftime(make_date(year(o_orderdate), 1, 1), '%Y-%m-%d') AS jan1,
  strftime(o_orderdate + INTERVAL 1 YEAR + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS made FROM orders""")
def date(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", dates.day_text(F.add_months(d, 2)).alias("plus2"), dates.day_text(F.date_add(d, 10)).alias("add10"),
        dates.day_text(F.date_sub(d, 10)).alias("sub10"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"),
        F.dayofmonth(d).alias("dom"), F.dayofweek(d).alias("dow"), F.dayofyear(d).alias("doy"), F.quarter(d).alias("q"),
        dates.day_text(F.date_trunc("month", d)).alias("mon"), F.unix_timestamp(d).alias("unix"),
        dates.day_text(F.make_date(F.date_part(F.lit("year"), d), F.lit(1), F.lit(1))).alias("jan1"),
        dates.second_text(d + F.make_interval(years=F.lit(1), hours=F.lit(1))).alias("made"))


@query("fn_04_date_rules", """
SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2002-01-01 00:30:00') - epoch(o_orderdate)) / 60) AS BIGINT) AS minutes, strftime(o_orderdate, '%Y%j') AS julian,
  strftime(o_orderdate + INTERVAL 1 DAY, '%Y%j') AS next_julian, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap,
  CAST(day(last_day(o_orderdate)) AS BIGINT) * 86400000 AS month_ms,
  CASE WHEN (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 THEN 366 ELSE 365 END::BIGINT * 86400000 AS year_ms FROM orders""")
def date_rules(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", dates.minutes_between(d, F.lit("2002-01-01 00:30:00").cast("timestamp_ntz")).alias("minutes"),
        dates.julian_day(d).alias("julian"), dates.next_julian_day(dates.julian_day(d)).alias("next_julian"),
        dates.is_leap_year(F.year(d)).alias("leap"), dates.month_millis(d).alias("month_ms"), dates.year_millis(d).alias("year_ms"))


@query("fn_05_math", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(l_discount), 9) AS e, round(pow(l_quantity, 2), 4) AS p, round(radians(l_quantity), 9) AS r, round(l_extendedprice, 1) AS rd,
  CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, round(acosh(l_quantity), 9) AS ach, round(asinh(l_quantity), 9) AS ash, round(atanh(l_tax), 9) AS ath,
  CAST(l_quantity AS BIGINT) // 7 AS dv FROM lineitem""")
def math(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.exp("l_discount"), 9).alias("e"),
        F.round(F.pow(q, 2), 4).alias("p"), F.round(F.radians(q), 9).alias("r"), F.round("l_extendedprice", 1).alias("rd"),
        F.floor("l_extendedprice").alias("fl"), F.ceil("l_extendedprice").alias("ce"), F.round(F.acosh(q), 9).alias("ach"),
        F.round(F.asinh(q), 9).alias("ash"), F.round(F.atanh("l_tax"), 9).alias("ath"),
        F.expr("cast(l_quantity as bigint) div 7").alias("dv"))


@query("fn_06_array", """
WITH a AS (SELECT vec_id, embedding AS e, [label, label + 1, label, 3] AS x, [3, 4, 5] AS y FROM embeddings)
SELECT vec_id, list_contains(x, 3) AS has3, array_to_string(list_sort(list_distinct(x)), ',') AS uniq,
  coalesce(array_to_string(list_sort(list_filter(list_distinct(x), lambda v: NOT list_contains(y, v))), ','), '') AS exc,
  coalesce(array_to_string(list_sort(list_intersect(list_distinct(x), y)), ','), '') AS inter, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS uni,
  CAST(list_max(x) AS INTEGER) AS mx, CAST(list_min(x) AS INTEGER) AS mn, coalesce(list_position(x, 3), 0)::BIGINT AS pos, array_to_string(list_filter(x, lambda v: v <> 3), ',') AS removed,
  list_has_any(x, y) AS overlap, x[2] AS second, len(e)::INTEGER AS dims, round(CAST(list_max(e) AS DOUBLE), 5) AS biggest FROM a""")
def array(t):
    x = F.array("label", F.col("label") + 1, "label", F.lit(3))
    a = t.embeddings.select("vec_id", F.col("embedding").alias("e"), x.alias("x"), F.array(F.lit(3), F.lit(4), F.lit(5)).alias("y"))
    joined = lambda c: F.array_join(c, ",")
    return a.select(
        "vec_id", F.array_contains("x", 3).alias("has3"), joined(F.array_sort(F.array_distinct("x"))).alias("uniq"),
        joined(F.array_sort(F.array_except("x", "y"))).alias("exc"), joined(F.array_sort(F.array_intersect("x", "y"))).alias("inter"),
        joined(F.array_sort(F.array_union("x", "y"))).alias("uni"), F.array_max("x").alias("mx"), F.array_min("x").alias("mn"),
        F.array_position("x", 3).alias("pos"), joined(F.array_remove("x", 3)).alias("removed"),
        F.arrays_overlap("x", "y").alias("overlap"), F.try_element_at("x", F.lit(2)).alias("second"), F.size("e").alias("dims"),
        F.round(F.array_max("e").cast("double"), 5).alias("biggest"))


@query("fn_06_array_shapes", """
SELECT vec_id, array_to_string(list_transform([1, 2, 3], lambda v: label), ',') AS repeated, 4 AS flat_size, label || ':a' AS zipped,
  CAST(label AS VARCHAR) || ',' || CAST(label + 1 AS VARCHAR) || ',9,8' AS flat FROM embeddings""")
def array_shapes(t):
    nested = F.flatten(F.array(F.array("label", F.col("label") + 1), F.array(F.lit(9), F.lit(8))))
    rows = t.embeddings.select("vec_id", "label", F.array("label").alias("n"), F.array(F.lit("a")).alias("s"), nested.alias("f"))
    pair = F.arrays_zip("n", "s")[0]
    return rows.select("vec_id", F.array_join(F.array_repeat("label", 3), ",").alias("repeated"), F.size("f").alias("flat_size"),
                       F.concat_ws(":", pair["n"].cast("string"), pair["s"]).alias("zipped"), F.array_join("f", ",").alias("flat"))


@query("fn_07_higher_order", """
SELECT vec_id, round(CAST(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)) AS DOUBLE), 4) AS norm2, len(list_filter(embedding, lambda v: v > 0))::INTEGER AS positives,
  len(list_filter(embedding, lambda v: v > 0.4)) > 0 AS some_big, len(list_filter(embedding, lambda v: abs(v) < 1)) = len(embedding) AS all_small FROM embeddings""")
def higher_order(t):
    e = F.col("embedding")
    squares = F.zip_with(e, e, lambda a, b: a.cast("double") * b)
    return t.embeddings.select(
        "vec_id", F.round(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v), 4).alias("norm2"),
        F.size(F.filter(e, lambda v: v > 0)).alias("positives"), F.exists(e, lambda v: v > 0.4).alias("some_big"),
        F.forall(e, lambda v: F.abs(v) < 1).alias("all_small"))


@query("fn_08_map", """
SELECT event_id, 'k,user' AS keys, CAST(json_extract(props, '$.k') AS INTEGER) + user_id AS total,
 CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 50 THEN 'k' ELSE '' END AS big_keys, 'K,USER' AS upper_keys,
 CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS k10, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS zipped FROM events""")
def map_functions(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = t.events.select("event_id", F.create_map(F.lit("k"), k, F.lit("user"), F.col("user_id")).alias("m"))
    big = F.map_filter("m", lambda key, v: (key == "k") & (v > 50))
    return rows.select(
        "event_id", F.array_join(F.map_keys("m"), ",").alias("keys"),
        F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"),
        F.array_join(F.map_keys(big), ",").alias("big_keys"),
        F.array_join(F.map_keys(F.transform_keys("m", lambda key, v: F.upper(key))), ",").alias("upper_keys"),
        F.transform_values("m", lambda key, v: v * 10)["k"].alias("k10"),
        F.map_zip_with("m", F.create_map(F.lit("k"), F.lit(1).cast("bigint")), lambda key, a, b: a + b)["k"].alias("zipped"))


@query("fn_09_json_csv", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS as_json, user_id || ',' || event_type AS as_csv,
  event_type AS from_csv, CAST(json_extract(props, '$.k') AS INTEGER) AS from_variant FROM events""")
def json_csv(t):
    csv = F.to_csv(F.struct("user_id", "event_type"))
    return t.events.select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct("user_id", "event_type")).alias("as_json"),
        csv.alias("as_csv"), F.from_csv(csv, "u bigint, e string")["e"].alias("from_csv"),
        F.variant_get(F.parse_json("props"), "$.k", "int").alias("from_variant"))


@query("fn_10_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
 coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, CAST(trunc(o_totalprice) AS INTEGER) AS whole, coalesce(TRY_CAST(o_orderpriority AS INTEGER), 0) AS bad_cast, 'double' AS kind
FROM orders""")
def conditional(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.when(price > 400000, "high").when(price > 100000, "mid").otherwise("low").alias("band"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("pending")).alias("status"), price.cast("int").alias("whole"),
        F.coalesce(F.col("o_orderpriority").try_cast("int"), F.lit(0)).alias("bad_cast"), F.typeof("o_totalprice").alias("kind"))


@query("fn_11_ngrams", """
WITH t AS (SELECT string_split(lower(text), ' ') AS w FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t)
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def ngrams(t):
    # The words are joined after the explode, in generated code.
    tokens = t.documents.select(F.split(F.lower("text"), " ", -1).alias("w")).where(F.size("w") > 1)
    pairs = tokens.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p"))
    grams = pairs.select(F.concat_ws(" ", "p.a", "p.b").alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("fn_12_digest", "SELECT doc_id, md5(text) AS digest FROM documents")
def digest(t):
    return t.documents.select("doc_id", F.md5("text").alias("digest"))
