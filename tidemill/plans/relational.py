"""Projection, cleansing and join queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import dates, rules, text
from tidemill.operators import intervals, relational
from tidemill.plans.registry import query


@query("flagship_nation_revenue", """
WITH r AS (
  SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, grouping(n_name, year(o_orderdate)) AS lvl,
         sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS line_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ROLLUP (n_name, year(o_orderdate)))
SELECT coalesce(n_name, 'ALL') AS n_name, coalesce(CAST(o_year AS VARCHAR), 'subTotal') AS o_year,
       CAST(lvl AS INTEGER) AS lvl, round(revenue, 2) AS revenue, line_count,
       CAST(rank() OVER (PARTITION BY lvl, o_year ORDER BY round(revenue, 2) DESC) AS INTEGER) AS place
FROM r""")
def nation_revenue(t):
    """Revenue per nation and year with sub-totals, ranked within each level and year."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
                                                 F.count(F.lit(1)).alias("lines"))
    orders = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
    customers = t.customer.select("c_custkey", "c_nationkey")
    nations = t.nation.select("n_nationkey", "n_name")
    joined = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
              .join(customers, F.col("o_custkey") == F.col("c_custkey"))
              .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
    # only the totals of each nation and year are expanded by the rollup, and their ranks sort a few hundred rows
    yearly = joined.groupBy("n_name", "o_year").agg(F.sum("amount").alias("amount"), F.sum("lines").alias("lines"))
    totals = yearly.rollup("n_name", "o_year").agg(F.grouping_id().cast("int").alias("lvl"),
                                                   F.round(F.sum("amount"), 2).alias("revenue"), F.sum("lines").alias("line_count"))
    placed = totals.withColumn("place", F.rank().over(Window.partitionBy("lvl", "o_year").orderBy(F.desc("revenue"))))
    return placed.select(F.coalesce("n_name", F.lit("ALL")).alias("n_name"),
                         F.coalesce(F.col("o_year").cast("string"), F.lit("subTotal")).alias("o_year"),
                         "lvl", "revenue", "line_count", "place").orderBy("lvl", "o_year", "place")


# -- projection and cleansing ---------------------------------------------------------------

@query("prj_01_categorise", """
SELECT CASE WHEN lower(trim(c_mktsegment)) IN ('building', 'household') THEN 'Home'
            WHEN lower(trim(c_mktsegment)) IN ('machinery', 'automobile') THEN 'Industry' ELSE 'Others' END AS category,
       count(*) AS n FROM customer GROUP BY 1""")
def categorise(t):
    groups = {"Home": ["building", "household"], "Industry": ["machinery", "automobile"]}
    label = text.categorise("c_mktsegment", groups, "Others")
    return t.customer.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_02_nested_decision", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Closed'
   ELSE CASE WHEN lower(o_orderpriority) LIKE '1-%' THEN 'Rush' ELSE o_orderpriority END END AS handling
FROM orders""")
def nested_decision(t):
    rush = F.when(F.lower("o_orderpriority").startswith("1-"), "Rush").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Closed").otherwise(rush).alias("handling"))


@query("prj_03_positional_split", """
WITH m AS (SELECT event_id, concat_ws('~', CAST(user_id AS VARCHAR), event_type, props) AS msg FROM events)
SELECT event_id, TRY_CAST(split_part(msg, '~', 1) AS BIGINT) AS user_id, split_part(msg, '~', 2) AS kind,
       coalesce(TRY_CAST(split_part(msg, '~', 2) AS INTEGER), -1) AS not_a_number
FROM m""")
def positional_split(t):
    msg = t.events.select("event_id", F.concat_ws("~", F.col("user_id").cast("string"), "event_type", "props").alias("msg"))
    part = F.split("msg", "~")
    return msg.select("event_id", part[0].try_cast("bigint").alias("user_id"), part[1].alias("kind"),
                      F.coalesce(part[1].try_cast("int"), F.lit(-1)).alias("not_a_number"))


@query("prj_04_split_and_clamp", """
WITH s AS (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS num FROM pages)
SELECT page_id, least(TRY_CAST(num AS INTEGER), 31) AS day_no,
       CASE WHEN TRY_CAST(num AS INTEGER) > 12 THEN 'Dec' ELSE num END AS month_text
FROM s WHERE num <> ''""")
def split_and_clamp(t):
    pages = t.pages.select("page_id", F.regexp_extract("url", r"/([0-9]+)", 1).alias("num")).where("num <> ''")
    number = F.col("num").try_cast("int")
    return pages.select("page_id", F.least(number, F.lit(31)).alias("day_no"),
                        F.when(number > 12, "Dec").otherwise(F.col("num")).alias("month_text"))


@query("prj_05_keep_key_tuples", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_quantity = 50)""")
def keep_key_tuples(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return relational.keep_matching(lines, lines.where("l_quantity = 50"), ["l_partkey", "l_suppkey"])


@query("prj_06_null_replacement", """
SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, coalesce(lang, 'NA') AS lang
FROM documents LEFT JOIN labels USING (doc_id)""")
def null_replacement(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return joined.na.fill({"quality": -1, "toxic": 0, "lang": "NA"})


@query("prj_07_day_first_dates", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
                               ELSE strftime(o_orderdate, '%Y-%m-%d') END AS txt FROM orders)
SELECT o_orderkey, strftime(coalesce(try_strptime(txt, '%d-%m-%Y'), try_strptime(txt, '%Y-%m-%d')), '%Y-%m-%d') AS day,
       CASE WHEN regexp_matches(txt, '^[0-9]{2}-') THEN 'day-first' ELSE 'year-first' END AS shape FROM s""")
def day_first_dates(t):
    txt = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = t.orders.select("o_orderkey", txt.alias("txt"))
    return rows.select("o_orderkey",
                       dates.day_text(dates.parse_either("txt", "dd-MM-yyyy", "yyyy-MM-dd")).alias("day"),
                       F.when(F.col("txt").rlike("^[0-9]{2}-"), "day-first").otherwise("year-first").alias("shape"))


# Digits of numbers that are added up; sums have room for one more.
DIGITS = 37


@query("prj_11_numeric_test", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)
SELECT doc_id, count_if(regexp_full_match(w, '[0-9]+')) AS numbers, count(*) AS words,
       count_if(regexp_full_match(w, '[0-9]+') AND length(ltrim(w, '0')) > 37) AS too_long,
       coalesce(sum(CASE WHEN regexp_full_match(w, '[0-9]+') AND length(ltrim(w, '0')) <= 37 THEN ('0' || right(w, 37))::DECIMAL(38, 0) END), 0)::VARCHAR AS total
FROM w GROUP BY doc_id""")
def numeric_test(t):
    words = t.documents.select("doc_id", F.explode(F.split("text", " ", -1)).alias("w"))
    """Numbers of more digits than a decimal holds are counted as rejects and not added."""
    numeric = F.col("w").rlike(r"\A[0-9]+\z")
    fits = F.length(F.ltrim("w", F.lit("0"))) <= DIGITS
    total = F.sum(F.when(numeric & fits, F.col("w").try_cast("decimal(38,0)")))
    return words.groupBy("doc_id").agg(F.count_if(numeric).alias("numbers"), F.count(F.lit(1)).alias("words"), F.count_if(numeric & ~fits).alias("too_long"),
                                       F.coalesce(total.cast("string"), F.lit("0")).alias("total"))


@query("prj_12_collapse_sparse", """
WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS one,
   CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS two,
   CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus ELSE 'x' END AS three FROM orders)
SELECT o_custkey, coalesce(CAST(min(TRY_CAST(one AS BIGINT)) AS VARCHAR), min(one), '-') AS one,
  coalesce(CAST(min(TRY_CAST(two AS BIGINT)) AS VARCHAR), min(two), '-') AS two,
  coalesce(CAST(min(TRY_CAST(three AS BIGINT)) AS VARCHAR), min(three), '-') AS three
FROM s GROUP BY o_custkey""")
def collapse_sparse(t):
    third = F.col("o_orderkey") % 3
    sparse = t.orders.select(
        "o_custkey", F.when(third == 0, F.col("o_orderkey").cast("string")).alias("one"),
        F.when(third == 1, F.col("o_orderpriority")).alias("two"),
        F.when(third == 2, F.col("o_orderstatus")).otherwise("x").alias("three"))
    return sparse.groupBy("o_custkey").agg(*[
        F.coalesce(F.min(F.col(c).try_cast("bigint")).cast("string"), F.min(c), F.lit("-")).alias(c)
        for c in ("one", "two", "three")])


@query("prj_13_first_letter", """
SELECT upper(substring(p_name, 1, 1)) AS letter, count(*) AS parts FROM part GROUP BY 1""")
def first_letter(t):
    return t.part.groupBy(F.upper(F.substring("p_name", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("parts"))


@query("prj_14_buy_back", """
WITH a AS (SELECT o_orderkey, 2001 - year(o_orderdate) AS y,
                  date_diff('month', date_trunc('month', o_orderdate), DATE '2001-12-01') AS m FROM orders)
SELECT o_orderkey, CAST(CASE WHEN y = 0 THEN CASE WHEN m <= 6 THEN 90 WHEN m <= 9 THEN 80 ELSE 75 END
  WHEN y = 1 THEN CASE WHEN m <= 6 THEN 75 ELSE 70 END WHEN y = 2 THEN CASE WHEN m <= 6 THEN 65 ELSE 60 END
  WHEN y = 3 THEN CASE WHEN m <= 6 THEN 55 ELSE 50 END ELSE 50 END AS INTEGER) AS percent FROM a""")
def buy_back(t):
    percent = rules.buy_back_percent(F.year("o_orderdate"), F.month("o_orderdate"), 2001, 12)
    return t.orders.select("o_orderkey", percent.alias("percent"))


@query("prj_15_grades", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS pct,
                  CASE WHEN l_linenumber % 2 = 0 THEN 'SA' ELSE 'CA' END AS kind FROM lineitem)
SELECT kind, CASE WHEN pct > 95 THEN 'A+' WHEN pct > 90 THEN 'A' WHEN pct > 85 THEN 'B+' WHEN pct > 80 THEN 'B'
  WHEN pct > 75 THEN 'C+' WHEN pct > 70 THEN 'C' WHEN pct > 65 THEN 'D+' WHEN pct > 60 THEN 'D'
  WHEN kind = 'CA' AND pct > 50 THEN 'E+' WHEN kind = 'CA' AND pct >= 45 THEN 'E'
  WHEN kind = 'SA' AND pct >= 50 THEN 'E' ELSE 'F' END AS grade, count(*) AS n
FROM m GROUP BY 1, 2""")
def grades(t):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "SA").otherwise("CA")
    marks = t.lineitem.select("l_quantity", kind.alias("kind"))
    letter = rules.grade_by_type(F.col("l_quantity"), F.lit(50.0), F.col("kind"))
    return marks.groupBy("kind", letter.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_16_sentinel", """
SELECT doc_id, coalesce(nullif(quality, 0), -1) AS quality FROM labels""")
def sentinel(t):
    return t.labels.select("doc_id", F.coalesce(F.nullif("quality", F.lit(0)), F.lit(-1)).alias("quality"))


@query("prj_17_row_map", """
SELECT p_partkey, concat('p_brand=', p_brand, ';p_type=', p_type) AS picked, 2 AS n_keys FROM part""")
def row_map(t):
    picked = F.create_map(*[x for c in ("p_brand", "p_type") for x in (F.lit(c), F.col(c))])
    rows = t.part.select("p_partkey", picked.alias("m"))
    entry = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("p_partkey", entry.alias("picked"), F.size("m").alias("n_keys"))


@query("prj_18_provider", """
WITH h AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)
SELECT CASE WHEN host LIKE '%.com' THEN 'commercial' WHEN host LIKE '%.org' THEN 'organisation' ELSE 'other' END AS provider,
       upper(left(split_part(host, '.', 1), 3)) AS abbreviation, count(*) AS n
FROM h GROUP BY 1, 2""")
def provider(t):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    pages = t.pages.select(host.alias("host"))
    kind = (F.when(F.col("host").endswith(".com"), "commercial").when(F.col("host").endswith(".org"), "organisation")
            .otherwise("other"))
    short = F.upper(F.substring(F.split_part("host", F.lit("."), F.lit(1)), 1, 3))
    return pages.groupBy(kind.alias("provider"), short.alias("abbreviation")).agg(F.count(F.lit(1)).alias("n"))


# -- joins ----------------------------------------------------------------------------------

@query("join_01_inner", """
SELECT o_orderkey, c_name, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal > 5000""")
def inner(t):
    rich = t.customer.where("c_acctbal > 5000").select("c_custkey", "c_name")
    return (t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("o_totalprice")))


@query("join_02_full_outer", """
WITH a AS (SELECT o_custkey AS k, count(*) AS open_orders FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
     b AS (SELECT o_custkey AS k, count(*) AS closed_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT k, coalesce(open_orders, 0) AS open_orders, coalesce(closed_orders, 0) AS closed_orders FROM a FULL JOIN b USING (k)""")
def full_outer(t):
    rows = t.orders.withColumnRenamed("o_custkey", "k")
    a = rows.where("o_orderstatus = 'O'").groupBy("k").agg(F.count(F.lit(1)).alias("open_orders"))
    b = rows.where("o_orderstatus = 'F'").groupBy("k").agg(F.count(F.lit(1)).alias("closed_orders"))
    return a.join(b, "k", "full").na.fill(0)


@query("join_03_insert_or_update", """
SELECT b.c_custkey, b.c_name, CASE WHEN s.k IS NULL THEN 'insert' ELSE 'update' END AS action
FROM customer b LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) s ON b.c_custkey = s.k""")
def insert_or_update(t):
    stored = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return relational.split_matched(t.customer.select("c_custkey", "c_name"), stored, ["c_custkey"])


@query("join_04_release_or_hold", """
SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'held' ELSE 'released' END AS status
FROM (SELECT doc_id FROM documents WHERE lang = 'en') d RIGHT JOIN labels l ON d.doc_id = l.doc_id""")
def release_or_hold(t):
    parents = t.documents.where("lang = 'en'").select("doc_id").distinct().withColumn("_p", F.lit(1))
    children = t.labels.select("doc_id")
    status = F.when(F.col("_p").isNull(), "held").otherwise("released")
    return parents.join(children, "doc_id", "right").select("doc_id", status.alias("status"))


@query("join_05_anti", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def anti(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("join_06_semi_and_not_in", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) THEN 1 ELSE 0 END AS big_buyer
FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def semi_and_not_in(t):
    # NOT IN as an anti join and one row that says whether the other side is empty or holds a null; no side is forced into a broadcast.
    side = t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    held = side.agg(F.count(F.lit(1)).alias("_rows"), F.count("c_nationkey").alias("_keys"))
    outside = t.customer.select("c_custkey", "c_nationkey").join(side, "c_nationkey", "left_anti").join(F.broadcast(held))
    outside = outside.where("_rows = 0 or (_keys = _rows and c_nationkey is not null)").select("c_custkey")
    big = t.orders.where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    semi = outside.join(big, "c_custkey", "left_semi").withColumn("big_buyer", F.lit(1))
    rest = outside.join(big, "c_custkey", "left_anti").withColumn("big_buyer", F.lit(0))
    return semi.unionByName(rest)


@query("join_07_unequal_partners", """
SELECT n_regionkey, count(*) AS members, CAST(sum((SELECT count(*) FROM nation b WHERE b.n_regionkey <> a.n_regionkey)) AS BIGINT) AS unequal_pairs,
       CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS unordered_pairs
FROM nation a GROUP BY n_regionkey""")
def unequal_partners(t):
    """``a <> b`` and unordered pairs per value, counted from value frequencies; no pair is made."""
    return relational.unequal_pair_counts(t.nation, "n_regionkey")


@query("join_08_single_row_aggregates", """
SELECT * FROM (SELECT round(sum(o_totalprice), 2) AS open_total FROM orders WHERE o_orderstatus = 'O') a,
              (SELECT round(-sum(o_totalprice), 2) AS closed_total FROM orders WHERE o_orderstatus <> 'O') b""")
def single_row_aggregates(t):
    """Two one-row aggregates side by side come from one pass with conditions."""
    is_open = F.col("o_orderstatus") == "O"
    return t.orders.agg(F.round(F.sum(F.when(is_open, F.col("o_totalprice"))), 2).alias("open_total"),
                        F.round(-F.sum(F.when(~is_open, F.col("o_totalprice"))), 2).alias("closed_total"))


@query("join_09_range_join", """
SELECT a.o_orderkey, b.o_orderkey AS ref_orderkey, strftime(b.o_orderdate, '%Y-%m-%d') AS ref_start
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
 AND b.o_orderdate > a.o_orderdate AND b.o_orderdate < a.o_orderdate + INTERVAL 60 DAY
 AND b.o_orderdate + (b.o_orderkey % 30 + 10) * INTERVAL 1 DAY > a.o_orderdate + INTERVAL 60 DAY""")
def range_joined(t):
    day = F.to_date("o_orderdate")
    rows = t.orders.select("o_custkey", "o_orderkey", day.alias("s"), F.date_add(day, 60).alias("e"))
    refs = t.orders.select("o_custkey", F.col("o_orderkey").alias("ref_orderkey"), day.alias("ref_start"),
                           F.date_add(day, (F.col("o_orderkey") % 30 + 10).cast("int")).alias("ref_end"))
    hits = intervals.range_join(rows, refs, ["o_custkey"], "s", "e", "ref_start").where("ref_end > e")
    return hits.select("o_orderkey", "ref_orderkey", dates.day_text("ref_start").alias("ref_start"))


@query("join_10_effective_dated_lookup", """
WITH p AS (SELECT l_partkey AS k, l_shipdate AS s, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
     r AS (SELECT DISTINCT l_partkey AS k, l_orderkey, l_shipdate AS d FROM lineitem WHERE l_returnflag = 'R'),
     j AS (SELECT r.*, p.s, p.price FROM r ASOF LEFT JOIN p ON r.k = p.k AND r.d >= p.s)
SELECT k, l_orderkey, strftime(d, '%Y-%m-%d') AS d, coalesce(strftime(s, '%Y-%m-%d'), '-') AS valid_from, coalesce(round(price, 2), 0) AS price FROM j""")
def effective_dated_lookup(t):
    prices = (t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("k"), F.col("l_shipdate").alias("s"))
              .agg(F.max("l_extendedprice").alias("price")))
    rows = (t.lineitem.where("l_returnflag = 'R'")
            .select(F.col("l_partkey").alias("k"), "l_orderkey", F.col("l_shipdate").alias("d")).distinct())
    found = intervals.as_of_lookup(rows, prices, ["k"], "d", "s", ["price"], bound_by=t.lineitem.select(F.col("l_partkey").alias("k")))
    return found.select("k", "l_orderkey", dates.day_text("d").alias("d"),
                        F.coalesce(dates.day_text("s"), F.lit("-")).alias("valid_from"),
                        F.coalesce(F.round("price", 2), F.lit(0.0)).alias("price"))


@query("join_11_checked_broadcast", """
SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def checked_broadcast(t):
    nations = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return relational.lookup_join(t.supplier, nations, ["s_nationkey"]).select("s_suppkey", "n_name")


@query("join_12_multi_way", """
SELECT r_name, n_name, c_mktsegment, p_type, count(*) AS line_count, round(sum(l_quantity), 2) AS qty
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3, 4""")
def multi_way(t):
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("r_name", "n_name", "c_mktsegment", "p_type")
            .agg(F.count(F.lit(1)).alias("line_count"), F.round(F.sum("l_quantity"), 2).alias("qty")))


@query("join_13_expand_to_siblings", """
SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN
 (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1))""")
def siblings(t):
    keys = t.part.where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return relational.expand_to_siblings(keys, t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey")


@query("join_14_normalised_keys", """
WITH a AS (SELECT n_nationkey, '  ' || lower(n_name) || ' ' AS raw FROM nation)
SELECT s_suppkey, trim(raw) AS nation FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN a ON upper(trim(a.raw)) = trim(n.n_name)""")
def normalised_keys(t):
    messy = t.nation.select(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("raw"))
    messy = messy.withColumn("k", F.upper(F.trim("raw")))
    clean = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", F.trim("n_name"))
    return clean.join(messy, "k").select("s_suppkey", F.trim("raw").alias("nation"))


@query("join_15_full_row_reconciliation", """
SELECT user_id, event_type, count(*) AS missing FROM (
  SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE value > 10)
GROUP BY 1, 2""")
def full_row_reconciliation(t):
    left = t.events.select("user_id", "event_type")
    right = t.events.where("value > 10").select("user_id", "event_type")
    return relational.missing_rows(left, right).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("missing"))


@query("join_16_duplicate_keys", """
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
     b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, a.n AS left_rows, b.n AS right_rows, a.n * b.n AS joined_rows FROM a JOIN b USING (k)""")
def duplicate_keys(t):
    orders = t.orders.withColumnRenamed("o_custkey", "k")
    return relational.duplicate_key_join_counts(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "k")
