"""Readers, writers and table maintenance on small files."""

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from tidemill.sources import messages, readers, schemas, writers

TREES = [("t1", "oak", "harbour", 2011, 4), ("t2", "elm", "meadow", 2013, 9), ("t3", "yew", "quay", 2011, 11)]
TREE_SCHEMA = "id string, species string, site string, planted int, height int"


def text(path, *lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


@pytest.fixture
def trees(spark):
    return spark.createDataFrame(TREES, TREE_SCHEMA)


@pytest.mark.parametrize("kind", ["parquet", "json", "orc", "csv", "xml"])
def test_round_trip(spark, trees, folder, rows, kind):
    options = {"header": "true"} if kind == "csv" else {"rowTag": "tree"} if kind == "xml" else {}
    writers.write(trees, kind, f"{folder}/x", **options)
    read = readers.read(spark, kind, f"{folder}/x", schema=TREE_SCHEMA, **({"rowTag": "tree"} if kind == "xml" else {}))
    assert rows(read) == sorted(TREES)


def test_csv_header_delimiter_and_names(spark, folder, rows):
    text(f"{folder}/a.csv", "id|n", "x|1", "y|2")
    assert rows(readers.read(spark, "csv", f"{folder}/a.csv", sep="|")) == [("x", 1), ("y", 2)]
    text(f"{folder}/b.csv", "x|1", "y|2")
    named = readers.read(spark, "csv", f"{folder}/b.csv", names="id, n", sep="|")
    assert named.columns == ["id", "n"] and named.count() == 2


def test_multi_line_json_and_text(spark, folder):
    text(f"{folder}/a.json", '[{"a": 1,', '"b": {"c": [1, 2]}}]')
    assert readers.read(spark, "json", f"{folder}/a.json", multiLine="true").select("b.c").first()[0] == [1, 2]
    writers.write(spark.createDataFrame([("one",), ("two",)], "value string"), "text", f"{folder}/t", coalesce=1)
    assert readers.read_lines(spark, f"{folder}/t", 3).count() == 2


def test_missing_packages_are_named(spark, folder):
    with pytest.raises(ValueError, match="spark-avro"):
        readers.read(spark, "avro", folder)


def test_gzip_and_first_last_line(spark, folder, rows):
    with gzip.open(f"{folder}/a.txt.gz", "wt") as f:
        f.write("first\nmiddle\nlast\n")
    text(f"{folder}/b.txt", "one")
    out = readers.first_and_last_line(spark, folder).select(F.regexp_extract("file", "([^/]+)$", 1), "first", "last")
    assert rows(out) == [("a.txt.gz", "first", "last"), ("b.txt", "one", "one")]


def test_partitions_read_back_and_pruned(spark, trees, folder, rows):
    trees = trees.union(spark.createDataFrame([("t4", None, "harbour", 2015, 1)], TREE_SCHEMA))
    writers.write(trees, "parquet", f"{folder}/p", partition_by=["site", "species"], repartition=4, repartition_by=["site"])
    back = readers.read(spark, "parquet", f"{folder}/p")
    assert back.where("id = 't4'").first().species is None
    some = readers.read_partitions(spark, f"{folder}/p", {"site": ["harbour", "none"], "planted": [2011]})
    assert rows(some.select("id")) == [("t1",)]
    assert len(some.inputFiles()) <= 4


def test_dynamic_overwrite_keeps_other_partitions(spark, trees, folder, rows):
    writers.replace_partitions(trees, f"{folder}/p", ["planted"])
    writers.replace_partitions(trees.where("id = 't1'").withColumn("height", F.lit(12)), f"{folder}/p", ["planted"])
    assert rows(spark.read.parquet(f"{folder}/p").select("id", "height")) == [("t1", 12), ("t2", 9)]
    with pytest.raises(ValueError):
        writers.replace_matching(spark, f"{folder}/p", F.col("planted") == 2013, trees, ["planted"])


def test_bucketed_tables_join_without_shuffle(spark, trees, rows):
    for name in ("trees_a", "trees_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        writers.save_table(trees, name, partition_by=["planted"], bucket_by=["site"], buckets=4)
    writers.insert_into(trees.where("id = 't1'"), "trees_a", repartition=1)
    assert spark.table("trees_a").count() == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = spark.table("trees_a").join(spark.table("trees_b"), "site")
    joined.collect()
    plan = "\n".join(r[0] for r in spark.sql("EXPLAIN SELECT * FROM trees_a JOIN trees_b USING (site)").collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert readers.sql(spark, "SELECT count(*) AS n FROM trees_b").first().n == 3


def test_compaction_and_recover(spark, folder):
    spark.range(1000).repartition(20).write.parquet(f"{folder}/small")
    files = writers.compact(spark, f"{folder}/small", f"{folder}/big")
    assert files == 1 == len(glob.glob(f"{folder}/big/*.parquet"))
    assert writers.compact(spark, f"{folder}/small", f"{folder}/b2", file_bytes=2000) > 1
    spark.sql("DROP TABLE IF EXISTS ext")
    spark.sql(f"CREATE TABLE ext (id bigint, d string) USING parquet PARTITIONED BY (d) LOCATION '{folder}/ext'")
    spark.range(3).write.parquet(f"{folder}/ext/d=x")
    assert spark.table("ext").count() == 0
    writers.refresh_partitions(spark, "ext")
    assert spark.table("ext").count() == 3


def test_salted_partition_write(spark, folder):
    df = spark.range(1000).withColumn("d", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join such small pieces again
    writers.spread_for_partitions(df, ["d"], 4).write.partitionBy("d").parquet(f"{folder}/s")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{folder}/s/d=hot/*.parquet")) > 1
    assert spark.read.parquet(f"{folder}/s").count() == 1000


def test_versions(spark, trees, folder, rows):
    assert writers.next_version(spark, f"{folder}/v") == 1
    writers.write_version(trees, f"{folder}/v", 1)
    for _ in range(2):
        writers.write_version(trees.where("id <> 't2'"), f"{folder}/v", 2)
    assert writers.next_version(spark, f"{folder}/v") == 3
    assert readers.read(spark, "parquet", f"{folder}/v").count() == 5
    assert writers.read_version(spark, f"{folder}/v").count() == 2
    assert writers.read_version(spark, f"{folder}/v", 1).count() == 3


def test_merged_schemas(spark, trees, folder):
    trees.write.parquet(f"{folder}/m")
    trees.withColumn("keepers", F.lit(2)).write.mode("append").parquet(f"{folder}/m")
    both = spark.read.option("mergeSchema", "true").parquet(f"{folder}/m")
    assert both.where("keepers is null").count() == 3 and both.count() == 6


def test_jdbc(spark, trees, rows):
    options = {"url": "jdbc:derby:memory:tidemill;create=true", "dbtable": "trees", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    slim = trees.select("id", "site", "planted")
    writers.write(slim, "jdbc", mode="overwrite", **options)
    writers.write(slim.where("id = 't1'").withColumn("id", F.lit("t9")), "jdbc", mode="append", **options)
    out = readers.read_jdbc(spark, options["url"], 'SELECT "id" FROM trees WHERE "planted" = 2011', driver=options["driver"])
    assert rows(out) == [("t1",), ("t3",), ("t9",)]
    sliced = readers.read_jdbc(spark, options["url"], 'SELECT "id", "planted" FROM trees', driver=options["driver"], partition="planted",
                               bounds=(2011, 2015), partitions=2)
    assert sliced.count() == 4


def test_rejects_are_kept(spark, folder, rows):
    text(f"{folder}/r.csv", "1,a", "x,b", "3,c,extra")
    good, bad = readers.read_with_rejects(spark, f"{folder}/r.csv", "n int, t string")
    assert rows(good) == [(1, "a")]
    assert rows(bad) == [("3,c,extra",), ("x,b",)]


def test_union_with_origin(spark, folder, rows):
    text(f"{folder}/one.csv", "1,a")
    text(f"{folder}/two.csv", "2,b")
    out = readers.union_with_origin(spark, [f"{folder}/one.csv", f"{folder}/two.csv"], "n int, t string")
    assert rows(out) == [(1, "a", "one"), (2, "b", "two")]


def test_vcf(spark, folder):
    text(f"{folder}/a.vcf", "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1",
         "20\t14370\trs1\tG\tA\t29\tPASS\tNS=3;DB\tGT\t0|0", "20\t17330\t.\tT\tA\t.\tq10\tDP=11\tGT\t0|1")
    out = readers.read_vcf(spark, f"{folder}/a.vcf").orderBy("POS").collect()
    assert [(r.POS, r.QUAL, r.INFO.get("NS"), r.SAMPLES[-1]) for r in out] == [(14370, 29.0, "3", "0|0"), (17330, None, None, "0|1")]
    assert "DB" in out[0].INFO


def test_xml_teams(spark, rows):
    doc = """<formula1><Teams><team><teamName>Red</teamName><constructorPoints>400</constructorPoints><constructorStanding>2nd</constructorStanding>
      <drivers><driver raceEntries="100" nationality="Dutch"><driverName>Max</driverName><avgFinishPosition>3</avgFinishPosition><points>300</points></driver>
      <driver raceEntries="50" nationality="Thai"><driverName>Alex</driverName><avgFinishPosition>10</avgFinishPosition><points>90</points></driver></drivers></team></Teams></formula1>"""
    out = readers.team_rows(spark.createDataFrame([(doc,)], "doc string"), "doc")
    assert rows(out.select("driverName", "nationality", "driverPoints", "teamPoints", "pitStopPoints")) == [
        ("Alex", "Thai", 90, 390, 10), ("Max", "Dutch", 300, 390, 10)]


def test_run_time_schemas(spark):
    assert schemas.to_ddl("a:string~b:decimal(6,3)~c:array(int)") == "`a` string, `b` decimal(6,3), `c` array<int>"
    assert schemas.to_ddl("a string;b long") == "`a` string, `b` bigint"
    df = spark.createDataFrame([('{"a":"x","b":1.5,"c":[1,2]}',)], "v string")
    row = schemas.parse_json(df, "v", "a:string~b:decimal(6,3)~c:array(int)").first()
    assert (row.a, float(row.b), row.c) == ("x", 1.5, [1, 2])
    assert schemas.from_dtypes(df) == "`v` string"


def test_schema_gate(spark, trees, rows):
    assert schemas.schema_diff(spark, trees.schema, trees.schema).count() == 0
    other = trees.select("id", "site", "species", F.col("planted").cast("string").alias("planted"), F.lit(1).alias("keepers"))
    assert rows(schemas.schema_diff(spark, trees.schema, other.schema).select("name", "difference")) == [
        ("height", "missing in target"), ("keepers", "missing in source"), ("planted", "type"), ("site", "order"), ("species", "order")]
    assert schemas.clean_names(trees.toDF(" a b", "c ", "d", "e", "f")).columns[:2] == ["a_b", "c"]


def test_headers_and_order_messages(spark):
    df = spark.createDataFrame([([("k1", bytearray(b"a")), ("k1", bytearray(b"b")), ("k2", bytearray(b"c"))],)],
                               "headers array<struct<key:string,value:binary>>")
    assert df.select(messages.header_map().alias("m")).first().m == {"k1": "b", "k2": "c"}
    msg = spark.createDataFrame([("INS||orderId::o1+userId::u1+orderItems::(i1~2~Y~SALE~10~100),(i2~1~N~X~0~50)",),
                                 ("UPD||orderId::o2+orderItems::(i3~4~70~NA~0)",)], "m string")
    out = sorted((r.orderId, r.item_id, r.qty, r.price, r.discount_code, r.discount) for r in messages.order_items(msg, "m").collect())
    assert out == [("o1", "i1", 2, 100, "SALE", 10), ("o1", "i2", 1, 50, None, None), ("o2", "i3", 4, 70, None, None)]


def test_kafka_options():
    from tidemill.streaming.sources import kafka_options
    o = kafka_options("h:9092", assign={"t": [0, 1]}, starting={"t": {0: 5, 1: -2}}, headers=True, max_offsets=10,
                      tls={"truststore.location": "/x"})
    assert o["assign"] == '{"t": [0, 1]}' and o["startingOffsets"] == '{"t": {"0": 5, "1": -2}}'
    assert o["includeHeaders"] == "true" and o["maxOffsetsPerTrigger"] == "10" and o["kafka.security.protocol"] == "SSL"
    with pytest.raises(ValueError):
        kafka_options("h", topics="a", pattern="b")
