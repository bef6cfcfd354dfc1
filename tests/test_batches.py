"""Streams through batch functions: several micro-batches, replays, chained jobs."""

import json
import os
import time

import duckdb
import oracle
from pyspark.sql import functions as F

from tidemill.flows import assessments, layers
from tidemill.operators import scd
from tidemill.plans import catalogue
from tidemill.session import materialise
from tidemill.streaming import batches, sinks, state
from tidemill.streaming.sources import read_stream


def put(folder, rows):
    os.makedirs(folder, exist_ok=True)
    n = len(os.listdir(folder))
    with open(f"{folder}/f{n}.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


def run(spark, src, schema, checkpoint, fn):
    df = read_stream(spark, "json", src, schema, maxFilesPerTrigger="1")
    sinks.start(df, checkpoint, fn).awaitTermination()


def test_hold_and_release_between_batches(spark, folder, rows):
    src, schema = f"{folder}/in", "id string, user string, at timestamp"
    users = f"{folder}/users"
    spark.createDataFrame([("u1",)], "user string").write.parquet(users)
    fn = batches.hold_and_release(
        f"{folder}/released", f"{folder}/held", lambda s: [(s.read.parquet(users), ["user"])], ["id"], "at",
        lambda: F.lit("2024-01-02").cast("timestamp"), "1 day")
    put(src, [{"id": "b1", "user": "u1", "at": "2024-01-01 10:00:00"}, {"id": "b2", "user": "u2", "at": "2024-01-01 10:00:00"},
              {"id": "b3", "user": "u2", "at": "2023-12-01 10:00:00"}])
    run(spark, src, schema, f"{folder}/ck", fn)
    like = spark.read.schema(schema).json(src)
    assert rows(spark.read.parquet(f"{folder}/released").select("id")) == [("b1",)]
    assert rows(batches.current_state(spark, f"{folder}/held", like).select("id")) == [("b2",), ("b3",)]
    spark.createDataFrame([("u2",)], "user string").write.mode("append").parquet(users)
    put(src, [{"id": "b4", "user": "u1", "at": "2024-01-01 11:00:00"}])
    run(spark, src, schema, f"{folder}/ck", fn)
    first = rows(spark.read.parquet(f"{folder}/released").select("id", "batch_id"))
    assert first == [("b1", 0), ("b2", 1), ("b4", 1)]  # b3 expired while held
    assert batches.current_state(spark, f"{folder}/held", like).count() == 0
    for name in ("1", ".1.crc"):
        os.remove(f"{folder}/ck/commits/{name}")  # the last batch runs again and changes nothing
    run(spark, src, schema, f"{folder}/ck", fn)
    assert rows(spark.read.parquet(f"{folder}/released").select("id", "batch_id")) == first


def test_replay_reads_neither_clock_nor_parents_anew(spark, folder, rows):
    """Between the first run of a batch and its replay a parent comes and the clock passes the expiry; the replay releases what the first run did."""
    src, schema, users = f"{folder}/in", "id string, user string, at timestamp", f"{folder}/users"
    spark.createDataFrame([("u1",)], "user string").write.parquet(users)
    clock = ["2024-01-01 12:00:00"]
    fn = batches.hold_and_release(f"{folder}/released", f"{folder}/held", lambda s: [(s.read.parquet(users), ["user"])], ["id"], "at",
                                  lambda: F.lit(clock[0]).cast("timestamp"), "1 day")
    put(src, [{"id": "b1", "user": "u1", "at": "2024-01-01 10:00:00"}, {"id": "b2", "user": "u2", "at": "2024-01-01 10:00:00"}])
    run(spark, src, schema, f"{folder}/ck", fn)
    put(src, [{"id": "b3", "user": "u1", "at": "2024-01-01 11:00:00"}, {"id": "b4", "user": "u3", "at": "2024-01-01 11:00:00"}])
    run(spark, src, schema, f"{folder}/ck", fn)
    like = spark.read.schema(schema).json(src)
    first = rows(spark.read.parquet(f"{folder}/released").select("id", "batch_id")), rows(batches.current_state(spark, f"{folder}/held", like).select("id"))
    assert first == ([("b1", 0), ("b3", 1)], [("b2",), ("b4",)])
    spark.createDataFrame([("u2",), ("u3",)], "user string").write.mode("append").parquet(users)
    clock[0] = "2024-02-01 00:00:00"
    for name in ("1", ".1.crc"):
        os.remove(f"{folder}/ck/commits/{name}")
    run(spark, src, schema, f"{folder}/ck", fn)
    assert (rows(spark.read.parquet(f"{folder}/released").select("id", "batch_id")), rows(batches.current_state(spark, f"{folder}/held", like).select("id"))) == first
    put(src, [{"id": "b5", "user": "u1", "at": "2024-02-01 00:00:00"}])
    run(spark, src, schema, f"{folder}/ck", fn)  # the next batch reads both anew: b2 and b4 have expired
    assert rows(spark.read.parquet(f"{folder}/released").select("id", "batch_id")) == [("b1", 0), ("b3", 1), ("b5", 2)]


def test_counters_are_replay_safe(spark, folder, rows):
    src, schema = f"{folder}/in", "page string, day string"
    put(src, [{"page": "a", "day": "1"}, {"page": "a", "day": "1"}])
    put(src, [{"page": "a", "day": "2"}, {"page": "b", "day": "1"}])
    fn = batches.count_into(f"{folder}/counts", ["page", "day"])
    run(spark, src, schema, f"{folder}/ck", fn)
    fn(spark.read.schema(schema).json(f"{src}/f1.json"), 1)
    assert rows(batches.counter_totals(spark, f"{folder}/counts", ["page"])) == [("a", 3), ("b", 1)]


def test_versions_by_merge(spark, folder, rows):
    src, schema = f"{folder}/in", "k string, v int"
    empty = spark.createDataFrame([], schema)
    for batch in ([{"k": "a", "v": 1}], [{"k": "a", "v": 2}, {"k": "b", "v": 5}], [{"k": "b", "v": None}]):
        put(src, batch)
        time.sleep(0.05)
    fn = batches.merge_into_versions(f"{folder}/t", lambda stored, batch: scd.scd1(stored, batch, ["k"]), empty)
    run(spark, src, schema, f"{folder}/ck", fn)
    assert rows(batches.current_state(spark, f"{folder}/t", empty)) == [("a", 2), ("b", 5)]


def test_a_new_checkpoint_goes_on_from_the_stored_state(spark, folder, rows):
    src, schema = f"{folder}/in", "k string, v int"
    empty = spark.createDataFrame([], schema)
    fn = batches.merge_into_versions(f"{folder}/t", lambda stored, batch: stored.unionByName(batch).groupBy("k").agg(
        F.sum("v").cast("int").alias("v")), empty)
    for n, checkpoint in enumerate(["ck1", "ck1", "ck2", "ck2"]):
        put(f"{src}-{checkpoint}", [{"k": "a", "v": 10 ** n}])
        run(spark, f"{src}-{checkpoint}", schema, f"{folder}/{checkpoint}", fn)
    assert rows(batches.current_state(spark, f"{folder}/t", empty)) == [("a", 1111)]
    assert len(os.listdir(f"{folder}/t")) == 2
    batches.drop_old_states(spark, f"{folder}/t", keep=1)
    assert rows(batches.current_state(spark, f"{folder}/t", empty)) == [("a", 1111)]


def test_triggers_drop_partitions_without_rows(spark, folder, rows):
    points = f"{folder}/points"
    spark.createDataFrame([(2020, 5), (2021, 1)], "season int, p int").write.parquet(points)
    fn = batches.recompute_affected(lambda s: s.read.parquet(points), ["season"],
                                    lambda df: df.groupBy("season").agg(F.sum("p").alias("total")), f"{folder}/totals")
    named = spark.createDataFrame([(2020,), (2021,)], "season int")
    fn(named, 0)
    spark.createDataFrame([(2021, 2)], "season int, p int").write.mode("overwrite").parquet(points)
    fn(named, 1)
    assert rows(spark.read.parquet(f"{folder}/totals").select("season", "total")) == [(2021, 2)]


def test_triggers_recompute_only_affected_keys(spark, folder, rows):
    points = f"{folder}/points"
    spark.createDataFrame([(2020, "d1", 5), (2020, "d2", 7), (2021, "d1", 1)], "season int, d string, p int").write.parquet(points)
    fn = batches.recompute_affected(lambda s: s.read.parquet(points), ["season"],
                                    lambda df: df.groupBy("season").agg(F.sum("p").alias("total")), f"{folder}/totals")
    fn(spark.createDataFrame([(2020,), (2021,)], "season int"), 0)
    spark.createDataFrame([(2020, "d3", 100), (2021, "d9", 50)], "season int, d string, p int").write.mode("append").parquet(points)
    fn(spark.createDataFrame([(2020,), (2020,)], "season int"), 1)
    assert rows(spark.read.parquet(f"{folder}/totals").select("season", "total")) == [(2020, 112), (2021, 1)]


def test_two_writers_one_table(spark, folder):
    a = spark.createDataFrame([("x", 1)], "name string, age int")
    batches.append_with_own_schema(f"{folder}/t", "one")(a, 0)
    batches.append_with_own_schema(f"{folder}/t", "two")(a.withColumn("height", F.lit(1.8)), 0)
    both = spark.read.option("mergeSchema", "true").parquet(f"{folder}/t")
    assert both.count() == 2 and both.where("height is null").count() == 1


def test_routing_with_unknown_types(spark, folder, rows):
    fn = sinks.route_by_type({"a": f"{folder}/a", "b": f"{folder}/b"}, "kind", f"{folder}/err")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("zzz", 3), (None, 4)], "kind string, n int")
    for _ in range(2):
        fn(batch, 0)
    assert rows(spark.read.parquet(f"{folder}/a").select("n")) == [(1,)]
    assert rows(spark.read.parquet(f"{folder}/err").select("n")) == [(3,), (4,)]
    fn(batch.where("kind = 'a'"), 1)
    only = sinks.route_by_type({"c": f"{folder}/c"}, "kind", f"{folder}/err2")
    only(batch, 0)
    assert sinks.read_batches(spark, f"{folder}/c", batch.schema).count() == 0  # a type without rows


def test_rate_source_row_writer_and_modes(spark, folder):
    class ToFile(sinks.RowWriter):
        def __init__(self, folder):
            self.folder = folder

        def open(self, partition_id, epoch_id):
            self.file = open(f"{self.folder}/{partition_id}-{epoch_id}.txt", "w")
            return True

        def process(self, row):
            self.file.write(f"{row.value}\n")

        def close(self, error):
            self.file.close()

    rate = read_stream(spark, "rate-micro-batch", rowsPerBatch="10", numPartitions="2")
    os.makedirs(f"{folder}/rows")
    writer = rate.writeStream.foreach(ToFile(f"{folder}/rows")).option("checkpointLocation", f"{folder}/ck").start()
    other = sinks.start(read_stream(spark, "rate", rowsPerSecond="5").withColumn("double", F.col("value") * 2),
                        f"{folder}/ck2", path=f"{folder}/rate", every="1 second")
    deadline = time.time() + 60
    while time.time() < deadline and (writer.lastProgress is None or other.lastProgress is None
                                      or sum(p["numInputRows"] for p in other.recentProgress) == 0):
        time.sleep(0.5)
    writer.stop(), other.stop()
    assert len(os.listdir(f"{folder}/rows")) >= 2
    assert spark.read.parquet(f"{folder}/rate").where("double <> value * 2").count() == 0


def test_late_rows_are_dropped(spark, folder, rows):
    from tidemill.streaming import windows
    src, schema = f"{folder}/in", "ts timestamp, k string, v int"
    for i, batch in enumerate([[("12:00:00", 1), ("12:20:00", 1)], [("12:09:00", 10), ("12:30:00", 1)], [("12:31:00", 1)], [("12:01:00", 100), ("13:30:00", 1)]]):
        put(src, [{"ts": f"2024-01-01 {t}", "k": "a", "v": v} for t, v in batch])
        os.utime(f"{src}/f{i}.json", (1_000_000 + i, 1_000_000 + i))
    df = read_stream(spark, "json", src, schema, maxFilesPerTrigger="1")
    out = windows.windowed(df, "ts", "10 minutes", ["k"], late="15 minutes", v=F.sum("v"))
    out = sinks.run_to_end(out)
    # 12:09 arrives while the watermark is 12:05 and counts; 12:01 arrives after its window was closed
    got = rows(out.select(F.date_format("window_start", "HH:mm"), "v"))
    assert got == [("12:00", 11), ("12:20", 1), ("12:30", 2)]


def test_layers_replay(spark, folder, rows):
    fn = layers.ingest(f"{folder}/bronze")
    batch = spark.createDataFrame([(1, "1.5~2024~c1~fp1~2024-01-01"), (2, "x~2024~c1~fp1~2024-01-01"), (3, "1.5~2024~c1~fp1~2024-01-02")],
                                  "key int, value string")
    for _ in range(2):
        fn(batch, 0)
    layers.to_silver(spark, f"{folder}/bronze", f"{folder}/silver")
    layers.to_gold(spark, f"{folder}/silver", f"{folder}/gold")
    assert spark.read.parquet(f"{folder}/bronze").count() == 3
    assert rows(spark.read.parquet(f"{folder}/gold/counts").select("circuit", "readings")) == [("c1", 1)]
    assert rows(spark.read.parquet(f"{folder}/gold/latest").select("key")) == [(3,)]
    stats = layers.reconcile(spark, f"{folder}/bronze", f"{folder}/silver")
    assert rows(stats.select("diff")) == [(0,), (1,)]


def test_three_level_metadata(spark, rows):
    schema = "sem string, exam string, year int, s timestamp, e timestamp"
    stored = spark.createDataFrame([], schema)
    feed = spark.createDataFrame([("s1", "e1", 2020, "2024-01-01 00:00:00", "Insert")], "sem string, exam string, year int, s string, crud string")
    feed = feed.withColumn("s", F.to_timestamp("s"))
    one = materialise(assessments.apply_level(stored, feed, ["sem", "exam"], ["year"], "s", "e"))
    assert one.count() == 1 and one.first().e is None
    changed = feed.withColumn("year", F.lit(2021)).withColumn("s", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    two = materialise(assessments.apply_level(one, changed, ["sem", "exam"], ["year"], "s", "e"))
    assert rows(two.select("year", F.date_format("e", "yyyy-MM-dd HH:mm"))) == [(2020, "2024-01-31 23:59"), (2021, None)]
    late = changed.withColumn("s", F.to_timestamp(F.lit("2023-01-01 00:00:00"))).withColumn("year", F.lit(1999))
    assert rows(assessments.apply_level(two, late, ["sem", "exam"], ["year"], "s", "e")) == rows(two)
    gone = changed.withColumn("crud", F.lit("Delete")).withColumn("s", F.to_timestamp(F.lit("2024-03-01 00:00:00")))
    three = assessments.apply_level(two, gone, ["sem", "exam"], ["year"], "s", "e")
    assert three.where("e is null").count() == 0
    children = two.withColumn("subject", F.lit("m1"))
    copied = assessments.copy_deletes(gone, children, ["sem", "exam"], "s", "e")
    assert rows(copied.select("subject", "crud")) == [("m1", "Delete")]
    known, orphans = assessments.parents_first(children, two.where("false"), ["sem", "exam"])
    assert known.count() == 0 and orphans.count() == 2


def test_three_levels_in_one_batch(spark, rows):
    values = "sem string, exam string, subject string, kind string, year int"
    def table(*cols):
        types = {"sem": "string", "exam": "string", "subject": "string", "kind": "string", "year": "int", "s": "timestamp", "e": "timestamp"}
        return spark.createDataFrame([], ", ".join(f"{c} {types[c]}" for c in cols))
    def feed(*data):
        df = spark.createDataFrame([(lv, "s1", "e1", sub, kind, year, crud, at) for lv, sub, kind, year, crud, at in data],
                                   f"level string, {values}, crud string, s string")
        return df.withColumn("s", F.to_timestamp("s"))
    levels = assessments.Levels(table("sem", "exam", "year", "s", "e"), table("sem", "exam", "subject", "s", "e"),
                                table("sem", "exam", "kind", "s", "e"), feed(("child", "x", None, 0, "Insert", "2024-01-01")).where("false"))
    keys, tracked = ["sem", "exam"], {"parent": ["year"], "child": ["subject"], "grandchild": ["kind"]}
    identity = {"parent": keys, "child": keys, "grandchild": keys}
    def step(levels, f):
        out = assessments.apply_batch(levels, f, keys, tracked, identity, "s", "e")
        return assessments.Levels(*[materialise(x) for x in (out.parents, out.children, out.grandchildren, out.orphans)])
    levels = step(levels, feed(("grandchild", None, "CA", None, "Insert", "2024-01-01")))
    assert levels.grandchildren.count() == 0 and levels.orphans.count() == 1
    levels = step(levels, feed(("parent", None, None, 2020, "Insert", "2024-01-02"), ("child", "m1", None, None, "Insert", "2024-01-03")))
    assert (levels.parents.count(), levels.children.count(), levels.grandchildren.count(), levels.orphans.count()) == (1, 1, 1, 0)
    levels = step(levels, feed(("child", "m1", None, None, "Delete", "2024-01-05")))
    assert levels.children.where("e is null").count() == 0 and levels.grandchildren.where("e is null").count() == 0
    assert levels.parents.where("e is null").count() == 1


def test_first_messages_held_in_a_table(spark, folder, rows):
    """Over batches and a restart, with null keys and messages; a replayed batch changes nothing. No key is handed to Python."""
    src, schema = f"{folder}/in", "key string, message string"
    fn = batches.hold_first(f"{folder}/out", f"{folder}/held")
    found = lambda: rows(spark.read.schema(schema).parquet(f"{folder}/out").select("key", "message"))
    put(src, [{"key": "x", "message": "1"}, {"key": "y", "message": None}, {"message": "n1"}])
    run(spark, src, schema, f"{folder}/ck", fn)
    assert found() == []
    put(src, [{"key": "x", "message": "2"}, {"key": "w", "message": "1"}, {"message": "n2"}])
    run(spark, src, schema, f"{folder}/ck", fn)
    assert found() == rows(spark.createDataFrame([("x", "1"), ("x", "2"), (None, "n1"), (None, "n2")], schema))
    third = [("x", "3"), ("y", "2"), ("z", "1"), ("z", "1"), ("w", "2"), ("v", "1")]
    put(src, [{"key": k, "message": m} for k, m in third])
    run(spark, src, schema, f"{folder}/ck", fn)
    every = [("x", "1"), ("x", "2"), (None, "n1"), (None, "n2"), *third[:5], ("y", None), ("w", "1")]
    assert found() == sorted(every, key=repr)
    for _ in range(2):  # called without a query: a run of its own, which goes on from the state
        fn(spark.createDataFrame([("v", "2"), ("x", "4")], schema), 0)
        assert found() == sorted([*every, ("v", "1"), ("v", "2"), ("x", "4")], key=repr)


def test_children_held_in_a_table_for_their_parents(spark, folder, rows):
    """The rules of ``state.release_with_parent``: latest child, parents in the batch, the state or a table, expiry by the batches before."""
    src, schema = f"{folder}/in", "key string, kind string, ts timestamp, message string"
    known = spark.createDataFrame([("k",)], "key string")
    fn = batches.release_with_parent(f"{folder}/out", f"{folder}/held", lambda s: known, 3_600_000)
    steps = [([("a", "child", 1, "c1"), ("k", "child", 1, "k1"), ("old", "child", 1, "o"), (None, "child", 1, "n")], [("k", "child", "k1")]),
             ([("a", "child", 2, "c3"), ("a", "child", 2, "c2"), ("p", "parent", 2, "p1"), (None, "parent", 2, "np")], [("p", "parent", "p1"), (None, "child", "n"), (None, "parent", "np")]),
             ([("a", "parent", 3, "q"), ("a", "child", 1, "late"), ("p", "child", 3, "pc")], [("a", "child", "c3"), ("a", "parent", "q"), ("p", "child", "pc")]),
             ([("z", "parent", 300, "z1")], [("z", "parent", "z1")]),
             ([("old", "parent", 301, "o2"), ("p", "child", 302, "pd"), ("a", "child", 4, "gone")], [("old", "parent", "o2")]),
             ([("p", "parent", 303, "p2")], [("p", "child", "pd"), ("p", "parent", "p2")])]
    expected = []
    for batch, out in steps:
        put(src, [{"key": k, "kind": kind, "ts": f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", "message": message} for k, kind, m, message in batch])
        run(spark, src, schema, f"{folder}/ck", fn)
        expected += out
        assert rows(spark.read.parquet(f"{folder}/out").select("key", "kind", "message")) == sorted(expected, key=repr)


def test_registered_holding_runs_on_the_jvm(spark, folder, monkeypatch):
    """Keys of these queries grow with the table, so no Python state is kept for each; of versions within one millisecond the latest counts, as in SQL."""
    for name in ("hold_first", "release_with_parent"):
        monkeypatch.setattr(state, name, None)
    events = [(9, 1, "view", "00:00:00.000900"), (10, 1, "view", "00:00:00.000100"), (8, 10, "view", "00:00:00.000500"), (15, 10, "view", "00:00:00.000500"),
              (99, 10, "view", "00:00:00.000700"), (106, 10, "view", "00:00:00.000700"), (2, 1, "signup", "00:00:01"), (40, 7, "click", "00:00:01"), (80, 7, "click", "00:00:02")]
    (spark.createDataFrame(events, "event_id long, user_id long, event_type string, at string")
     .select("event_id", F.to_timestamp_ntz(F.concat(F.lit("2024-01-01 "), "at")).alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
     .coalesce(1).write.parquet(f"{folder}/events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    for name in ("str_18_hold_first", "str_21_release_with_parent"):
        oracle.same(catalogue.QUERIES[name](spark, folder), con, catalogue.ORACLE[name])
