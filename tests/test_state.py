"""Keyed state over several micro-batches, with restarts."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.streaming import sinks, state


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    at = 1_000_000 + len(os.listdir(folder))  # files are read in this order
    os.utime(f"{folder}/{name}.json", (at, at))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(folder)


def drain(df, folder):
    sinks.start(df, f"{folder}/ck", path=f"{folder}/out").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_hold_first_over_batches_and_restart(spark, folder, rows):
    src = f"{folder}/in"
    put(src, "a", [{"key": "x", "message": "1"}, {"key": "y", "message": "1"}])
    stream = lambda: state.hold_first(source(spark, src, "key string, message string"))
    assert rows(drain(stream(), folder)) == []
    put(src, "b", [{"key": "x", "message": "2"}])
    assert rows(drain(stream(), folder)) == [("x", "1"), ("x", "2")]
    put(src, "c", [{"key": "x", "message": "3"}, {"key": "z", "message": "1"}, {"key": "z", "message": "2"}])
    out = rows(drain(stream(), folder))
    assert out == [("x", "1"), ("x", "2"), ("x", "3"), ("z", "1"), ("z", "2")]


def test_hold_first_expires_by_event_time(spark, folder, rows):
    src = f"{folder}/in"
    schema = "key string, message string, ts timestamp"
    put(src, "a", [{"key": "x", "message": "1", "ts": "2024-01-01 00:00:00"}])
    put(src, "b", [{"key": "other", "message": "1", "ts": "2024-01-02 00:00:00"}])
    put(src, "c", [{"key": "other", "message": "2", "ts": "2024-01-02 00:10:00"}])
    put(src, "d", [{"key": "x", "message": "2", "ts": "2024-01-02 00:20:00"}])
    df = source(spark, src, schema).withWatermark("ts", "1 minute")
    out = rows(drain(state.hold_first(df, timeout_ms=3_600_000, ts="ts"), folder))
    assert out == [("other", "1"), ("other", "2")]  # x's first message expired, its second is held


SCHEMA = "key string, kind string, ts timestamp, message string"


def parent_child(spark, folder, batches, known=None, expiry=3_600_000):
    src = f"{folder}/in"
    for i, batch in enumerate(batches):
        put(src, f"f{i}", [dict(zip(("key", "kind", "ts", "message"), r)) for r in batch])
    df = source(spark, src, SCHEMA).withWatermark("ts", "0 seconds")
    return drain(state.release_with_parent(df, known, expiry), folder).select("key", "kind", "message")


def test_child_waits_for_parent(spark, folder, rows):
    t = "2024-01-01 00:%02d:00"
    out = parent_child(spark, folder, [
        [("a", "child", t % 1, "c1")], [("a", "child", t % 2, "c2")], [("a", "parent", t % 3, "p1")],
        [("a", "child", t % 4, "c3")]])
    assert rows(out) == [("a", "child", "c2"), ("a", "child", "c3"), ("a", "parent", "p1")]


def test_child_released_by_table_and_expired(spark, folder, rows):
    known = spark.createDataFrame([("k",)], "key string")
    out = parent_child(spark, folder, [
        [("k", "child", "2024-01-01 00:01:00", "c1"), ("a", "child", "2024-01-01 00:01:00", "old")],
        [("b", "parent", "2024-01-01 05:00:00", "p")], [("a", "parent", "2024-01-01 06:00:00", "p2")]], known)
    assert rows(out) == [("a", "parent", "p2"), ("b", "parent", "p"), ("k", "child", "c1")]


def test_hierarchy_rules(spark, folder, rows):
    src = f"{folder}/in"
    batches = [
        [("k", "grandchild", "Insert", 1, "g1")],                                   # orphan waits
        [("k", "parent", "Insert", 2, "p1")],                                       # releases it
        [("k", "child", "Insert", 3, "c1"), ("k", "grandchild", "Insert", 4, "g2")],
        [("k", "child", "Delete", 5, "c1")],                                        # copied to the grandchild
        [("k", "parent", "Delete", 6, "p1")], [("k", "parent", "Insert", 7, "p2")], [("k", "parent", "Delete", 8, "p2")],
        [("k", "parent", "Insert", 9, "p3")]]                                       # deleted twice: closed for good
    for i, b in enumerate(batches):
        put(src, f"f{i}", [dict(zip(("key", "level", "crud", "at", "message"), r)) for r in b])
    df = source(spark, src, "key string, level string, crud string, at long, message string")
    out = sorted((r.at, r.level, r.crud) for r in drain(state.hierarchy(df), folder).collect())
    assert out == [(1, "grandchild", "Insert"), (2, "parent", "Insert"), (3, "child", "Insert"), (4, "grandchild", "Insert"),
                   (5, "child", "Delete"), (5, "grandchild", "Delete"),
                   (6, "child", "Delete"), (6, "grandchild", "Delete"), (6, "parent", "Delete"), (7, "parent", "Insert"),
                   (8, "child", "Delete"), (8, "grandchild", "Delete"), (8, "parent", "Delete")]


def test_hierarchy_with_a_schema_of_its_own(spark, folder, rows):
    src = f"{folder}/in"
    names = ("key", "level", "crud", "at", "message")
    put(src, "a", [dict(zip(names, ("k", "parent", "Insert", 1, '{"year": 2020, "title": "maths"}'))),
                   dict(zip(names, ("k", "child", "Insert", 2, '{"year": 2021}')))])
    df = source(spark, src, "key string, level string, crud string, at long, message string")
    out = drain(state.hierarchy(df, "title string, year int, level string, at string"), folder)
    assert out.columns == ["title", "year", "level", "at"]
    assert rows(out) == [("maths", 2020, "parent", "1"), (None, 2021, "child", "2")]


def test_held_message_expires_by_processing_time(spark, folder, rows):
    src = f"{folder}/in"
    put(src, "a", [{"key": "x", "message": "1"}])
    stream = state.hold_first(source(spark, src, "key string, message string"), timeout_ms=500)
    query = sinks.start(stream, f"{folder}/ck", path=f"{folder}/out", every="200 milliseconds")

    def wait_for(total):
        end = time.time() + 30
        while time.time() < end and sum(p["numInputRows"] for p in query.recentProgress) < total:
            time.sleep(0.2)

    try:
        wait_for(1)
        time.sleep(4)  # batches without rows go on, and x's timeout is due
        put(src, "b", [{"key": "x", "message": "2"}])
        wait_for(2)
    finally:
        query.stop()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    assert rows(out) == []  # held as a first message again


def test_passing_keys_are_forgotten(spark, folder, rows):
    src = f"{folder}/in"
    for name, batch in {"a": [("x", "1", "01 00:00:00"), ("x", "2", "01 00:00:01")], "b": [("y", "1", "02 00:00:00")],
                        "c": [("y", "2", "02 00:10:00")], "d": [("x", "3", "02 00:20:00")]}.items():
        put(src, name, [{"key": k, "message": m, "ts": f"2024-01-{t}"} for k, m, t in batch])
    df = source(spark, src, "key string, message string, ts timestamp").withWatermark("ts", "1 minute")
    out = rows(drain(state.hold_first(df, timeout_ms=3_600_000, ts="ts"), folder))
    assert out == [("x", "1"), ("x", "2"), ("y", "1"), ("y", "2")]


def test_pair_up_expires_each_entry(spark, folder, rows):
    """The first member and the first owner expire alone; later entries of the key live on."""
    src = f"{folder}/in"
    t = "2024-01-01 %02d:%02d:00"
    batches = [[("T1", "", "old", t % (0, 0), "o")], [("T1", "", "new", t % (0, 50), "n")], [("T9", "", "x", t % (1, 10), "x")],
               [("T1", "owner", "", t % (1, 20), "team")], [("T2", "owner", "", t % (1, 0), "gone")], [("T9", "", "y", t % (2, 30), "y")],
               [("T2", "", "late", t % (2, 40), "l")]]
    for i, b in enumerate(batches):
        put(src, f"f{i}", [dict(zip(("key", "side", "id", "ts", "message"), r)) for r in b])
    df = source(spark, src, "key string, side string, id string, ts timestamp, message string").withWatermark("ts", "0 seconds")
    out = drain(state.pair_up(df.where("side = 'owner'"), df.where("side = ''"), 3_600_000), folder)
    assert rows(out) == [("T1", "member", "new", "n"), ("T1", "owner", "", "team")]


def test_pair_up_both_orders(spark, folder, rows):
    src = f"{folder}/in"
    t = "2024-01-01 00:%02d:00"
    batches = [[("T5", "", "D5", t % 1, "senna")], [("T5", "owner", "", t % 2, "alpine")], [("T5", "", "D7", t % 3, "senna2")],
               [("T6", "owner", "", t % 4, "team6")], [("T6", "", "D8", t % 5, "m8")], [("T9", "", "D9", t % 6, "orphan")]]
    for i, b in enumerate(batches):
        put(src, f"f{i}", [dict(zip(("key", "side", "id", "ts", "message"), r)) for r in b])
    df = source(spark, src, "key string, side string, id string, ts timestamp, message string").withWatermark("ts", "0 seconds")
    out = drain(state.pair_up(df.where("side = 'owner'"), df.where("side = ''"), 3_600_000), folder)
    assert rows(out) == [("T5", "member", "D5", "senna"), ("T5", "member", "D7", "senna2"), ("T5", "owner", "", "alpine"),
                         ("T6", "member", "D8", "m8"), ("T6", "owner", "", "team6")]


class _Handle:
    """State of one key in memory, counting what is read."""

    def __init__(self):
        self.reads, self.timers, self.states = 0, set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, _Map(self))

    def registerTimer(self, at):
        self.timers.add(at)


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Map:
    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def containsKey(self, key):
        self.handle.reads += 1
        return key in self.rows

    def getValue(self, key):
        self.handle.reads += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key, None)

    def iterator(self):
        for item in list(self.rows.items()):
            self.handle.reads += 1
            yield item

    def clear(self):
        self.rows.clear()


class _At:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    def getExpiryTimeInMs(self):
        return self.at


def test_expiry_reads_are_linear():
    """100,000 waiting members of one key expire with a few reads each, whenever their timers run."""
    pair, handle = state._PairUp(64_000), _Handle()
    pair.init(handle)
    n = 100_000
    for low in range(0, n, 10_000):
        ids = range(low, low + 10_000)
        chunk = pd.DataFrame({"side": "", "id": [str(i) for i in ids], "message": "m", "at": [i // 10 for i in ids]})
        assert list(pair.handleInputRows(("k",), iter([chunk]), _At(0))) == []
    assert len(pair.waiting.rows) == n and len(handle.timers) <= 70
    before = handle.reads
    for timer in sorted(handle.timers):
        alive = len([1 for (_, at) in pair.waiting.rows.values() if at + 64_000 > timer])
        list(pair.handleExpiredTimer(("k",), _At(timer), _At(timer)))
        assert len(pair.waiting.rows) == alive
    assert not pair.waiting.rows and not pair.due.rows and not pair.parts.rows
    assert handle.reads - before <= 2.1 * n


def test_waiting_members_come_out_in_parts():
    pair, handle = state._PairUp(64_000), _Handle()
    pair.init(handle)
    members = pd.DataFrame({"side": "", "id": [str(i) for i in range(2500)], "message": "old", "at": 10})
    list(pair.handleInputRows(("k",), iter([members]), _At(0)))
    again = pd.DataFrame({"side": ["", "", "owner"], "id": ["7", "x", ""], "message": ["new", "first", "o"], "at": [20, 20, 30]})
    out = list(pair.handleInputRows(("k",), iter([again]), _At(0)))
    assert max(map(len, out)) <= pair.PART
    found = pd.concat(out)
    assert len(found) == 2502 and found["id"].is_unique and dict(zip(found["id"], found["message"]))["7"] == "new"
    assert not pair.waiting.rows and pair.owner.get() == ("o", 30, True)


@pytest.mark.parametrize("payload, make", [
    ("name string, tags array<string>, price decimal(8,3), one struct<a:int,b:array<double>>", lambda i: {"name": f"n{i}", "tags": [f"t{i}", None], "price": f"{i}.125", "one": {"a": i, "b": [0.5 * i]}}),
    ("seen timestamp, counts array<bigint>, flag boolean", lambda i: {"seen": f"2024-01-0{i + 1}T00:00:00Z", "counts": [i, i + 1], "flag": i % 2 == 0})], ids=["decimals", "times"])
def test_rows_of_a_schema_given_at_run_time(spark, folder, payload, make):
    """Several rows of a level wait with all their columns, over a restart, and come out as they went in."""
    src = f"{folder}/in"

    def row(level, id_, crud, at, i):
        return {"key": "k", "level": level, "id": id_, "crud": crud, "at": at, **make(i)}
    put(src, "f0", [row("child", "c1", "Insert", 1, 1), row("child", "c2", "Insert", 1, 2), row("grandchild", "c1", "Insert", 1, 3)])
    schema = f"key string, level string, id string, crud string, at long, {payload}"
    run = lambda: drain(state.row_hierarchy(source(spark, src, schema), payload), folder)
    assert run().count() == 0
    put(src, "f1", [row("child", "c1", "Update", 2, 4)])
    run()
    put(src, "f2", [row("parent", "p", "Insert", 3, 5)])
    out = {(r["level"], r["id"]): r for r in run().collect()}
    expected = {("parent", "p"): 5, ("child", "c1"): 4, ("child", "c2"): 2, ("grandchild", "c1"): 3}
    rows = spark.createDataFrame([json.dumps({"w": make(i), "l": level, "i": id_}) for (level, id_), i in expected.items()], "string")
    rows = rows.select(F.from_json("value", f"w struct<{', '.join(p.replace(' ', ':', 1) for p in _columns(payload))}>, l string, i string").alias("r")).select("r.l", "r.i", "r.w.*").collect()
    names = [p.split(" ")[0] for p in _columns(payload)]
    assert {k: [r[n] for n in names] for k, r in out.items()} == {(r["l"], r["i"]): [r[n] for n in names] for r in rows}
    put(src, "f3", [row("child", "c1", "Delete", 4, 6), row("grandchild", "c1", "Update", 4, 0), row("child", "c3", "Insert", 4, 0)])
    late = {(r["level"], r["id"], r["crud"]) for r in run().where("at = 4").collect()}
    assert late == {("child", "c1", "Delete"), ("grandchild", "c1", "Delete"), ("child", "c3", "Insert")}
    put(src, "f4", [row("parent", "p", "Delete", 5, 0)])
    put(src, "f5", [row("child", "c9", "Insert", 6, 0)])
    assert {(r["level"], r["crud"]) for r in run().where("at >= 5").collect()} == {("parent", "Delete")}


def _columns(payload):
    out, depth = [""], 0
    for c in payload:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]
