"""Keyed state: hold and release, expiry, parents and children.

Every function takes a stream with text keys and messages, so the state holds texts and numbers
only. State per key is bounded: one message per role, or a keyed map kept in the state store. A
group's rows of one micro-batch arrive in Arrow chunks and are reduced chunk by chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout


def _millis(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


def hold_first(stream: DataFrame, timeout_ms: int | None = None, ts: str | None = None) -> DataFrame:
    """(key, message) rows: the first message of a key is held and released together with the next
    ones; from then on messages pass. Independent of how rows fall into micro-batches: all messages
    of keys with at least two come out.

    With ``timeout_ms`` a key is forgotten, and its held message dropped, after that much processing time
    without news or, when ``ts`` is given, once the watermark passes the event time of the held message, or
    of the newest one that passed, plus ``timeout_ms``. Without it every key is remembered for ever.
    Processing-time timeouts need a trigger that goes on; ``availableNow`` waits for them without end."""
    by_event = timeout_ms is not None and ts is not None

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, passing, at = state.get if state.exists else (None, False, 0)
        for pdf in pdfs:
            out = list(pdf["message"])
            if not passing:
                if held is None and out:
                    held = out.pop(0)
                    at = _millis(pdf[ts].iloc[0]) if by_event else 0
                if held is not None and out:
                    out, held, passing = [held, *out], None, True
            if out:
                yield pd.DataFrame({"key": [key[0]] * len(out), "message": out})
            if by_event and passing:
                at = max(at, _millis(pdf[ts].max()))
        state.update((held, passing, at))
        if by_event:
            state.setTimeoutTimestamp(max(at + timeout_ms, state.getCurrentWatermarkMs() + 1))
        elif timeout_ms and not by_event:
            state.setTimeoutDuration(timeout_ms)

    kind = (GroupStateTimeout.EventTimeTimeout if by_event else
            GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
    return stream.groupBy("key").applyInPandasWithState(
        step, "key string, message string", "held string, passing boolean, at long", "append", kind)


def release_with_parent(stream: DataFrame, parents: DataFrame | None, expiry_ms: int) -> DataFrame:
    """(key, kind, ts, message) rows, kind ``parent`` or ``child``; the stream has a watermark on ts.

    Expired rows are dropped first. A parent is always released and remembered. A child is released
    when its parent is in the batch, in the state or in the ``parents`` table (column ``key``);
    otherwise only its latest version is held until the parent comes or it expires. Of several
    versions in one batch the latest is released. The table is looked up by a join before the state."""
    if parents is not None:
        known = parents.select("key").distinct().withColumn("known", F.lit(True))
        stream = stream.join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    else:
        stream = stream.withColumn("known", F.lit(False))

    def newer(best, pdf):
        if len(pdf):
            row = pdf.sort_values(["ts", "message"]).iloc[-1]
            found = (_millis(row["ts"]), str(row["message"]))
            return found if best is None or found > best else best
        return best

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            state.remove()
            return
        parent_at, child_at, child = state.get if state.exists else (None, None, None)
        held = None if child is None else (child_at, child)
        new_parent, new_child, known = None, None, False
        for pdf in pdfs:
            known = known or bool(pdf["known"].any())
            pdf = pdf[pdf["ts"].map(_millis) + expiry_ms > now]
            new_parent = newer(new_parent, pdf[pdf["kind"] == "parent"])
            new_child = newer(new_child, pdf[pdf["kind"] == "child"])
        if held is not None and held[0] + expiry_ms <= now:
            held = None
        if new_parent is not None:
            parent_at = max(new_parent[0], parent_at or 0)
        if parent_at is not None and parent_at + expiry_ms <= now:
            parent_at = None
        out = [] if new_parent is None else [("parent", *new_parent)]
        if new_child is not None and (held is None or new_child > held):
            held = new_child
        if held is not None and (known or parent_at is not None):
            out.append(("child", *held))
            held = None
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "kind": [o[0] for o in out],
                                "ts": [pd.Timestamp(o[1], unit="ms") for o in out], "message": [o[2] for o in out]})
        if parent_at is None and held is None:
            if state.exists:
                state.remove()
            return
        state.update((parent_at, held[0] if held else None, held[1] if held else None))
        state.setTimeoutTimestamp(max((parent_at or 0) + expiry_ms, (held[0] if held else 0) + expiry_ms, now + 1))

    return stream.groupBy("key").applyInPandasWithState(
        step, "key string, kind string, ts timestamp, message string",
        "parent_at long, child_at long, child string", "append", GroupStateTimeout.EventTimeTimeout)


class _PairUp(StatefulProcessor):
    """Members wait in a map in the state store until their owner comes; an owner waits for its first member.

    Deadlines are rounded up to buckets, 64 to an expiry. A second map lists, under its bucket, the members that came to wait in it, in parts of at most ``PART`` ids; a bucket has one
    timer, which looks up the members listed there and nothing else. What has expired is not paired even if its timer has yet to run.
    While the owner is there, members pass without touching the maps; the waiting ones are walked, in parts, only when an owner comes."""

    COLUMNS = ["key", "side", "id", "message"]
    PART = 1000

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms
        self.width = max(1, expiry_ms // 64)

    def init(self, handle) -> None:
        self.handle = handle
        self.owner = handle.getValueState("owner", "message string, at long, released boolean")
        self.waiting = handle.getMapState("waiting", "id string", "message string, at long")
        self.due = handle.getMapState("due", "bucket long, part long", "ids string")
        self.parts = handle.getMapState("parts", "bucket long", "n long")

    def _live(self, at: int, now: int) -> bool:
        return at + self.expiry_ms > now

    def _bucket(self, at: int) -> int:
        return -(-(at + self.expiry_ms) // self.width)

    def _owner(self, now: int):
        owner = self.owner.get() if self.owner.exists() else None
        return tuple(owner) if owner is not None and self._live(owner[1], now) else None

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf[pdf["at"] + self.expiry_ms > now].sort_values(["at", "message"])
            out = []
            before = owner = self._owner(now)
            owners = pdf[pdf["side"] == "owner"]
            for message, at in zip(owners["message"], owners["at"]):
                if owner is None or at >= owner[1]:
                    owner = (str(message), int(at), owner is not None and bool(owner[2]))
                    if owner[2]:
                        out.append(("owner", "", owner[0]))
            members = pdf[pdf["side"] != "owner"].drop_duplicates("id", keep="last")
            found = {str(m): (str(text), int(at)) for m, text, at in zip(members["id"], members["message"], members["at"])}
            if owner is None:
                self._wait(found)
            else:
                released = 0
                if before is None:
                    for part in self._take_waiting(found, now):
                        released += len(part)
                        yield self._frame(key, part)
                if (found or released) and not owner[2]:
                    owner = (owner[0], owner[1], True)
                    out.append(("owner", "", owner[0]))
                out += [("member", m, message) for m, (message, _) in found.items()]
                if owner != before:
                    self.owner.update(owner)
                    self.handle.registerTimer(self._bucket(owner[1]) * self.width)
            if out:
                yield self._frame(key, out)

    def _frame(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in out], columns=self.COLUMNS)

    def _wait(self, members: dict) -> None:
        lists: dict[int, list[str]] = {}
        for member, (message, at) in members.items():
            old = self.waiting.getValue((member,)) if self.waiting.containsKey((member,)) else None
            if old is None or at >= old[1]:
                self.waiting.updateValue((member,), (message, at))
                if old is None or self._bucket(old[1]) != self._bucket(at):
                    lists.setdefault(self._bucket(at), []).append(member)
        for bucket, ids in lists.items():
            n = self.parts.getValue((bucket,))[0] if self.parts.containsKey((bucket,)) else 0
            for low in range(0, len(ids), self.PART):
                self.due.updateValue((bucket, n), (json.dumps(ids[low:low + self.PART]),))
                n += 1
            self.parts.updateValue((bucket,), (n,))
            self.handle.registerTimer(bucket * self.width)

    def _take_waiting(self, members: dict, now: int) -> Iterator[list]:
        """The waiting members that have not expired, in parts; of two versions the newer comes out, here or with ``members``."""
        out = []
        for (member,), (message, at) in self.waiting.iterator():
            if self._live(at, now) and (member not in members or members[member][1] < at):
                members.pop(member, None)
                out.append(("member", member, message))
                if len(out) == self.PART:
                    yield out
                    out = []
        if out:
            yield out
        self.waiting.clear()
        self.due.clear()
        self.parts.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        bucket = expiredTimerInfo.getExpiryTimeInMs() // self.width
        if self.parts.containsKey((bucket,)):
            for part in range(self.parts.getValue((bucket,))[0]):
                for member in json.loads(self.due.getValue((bucket, part))[0]):
                    found = self.waiting.getValue((member,)) if self.waiting.containsKey((member,)) else None
                    if found is not None and not self._live(found[1], now):  # a newer version waits in a later bucket
                        self.waiting.removeKey((member,))
                self.due.removeKey((bucket, part))
            self.parts.removeKey((bucket,))
        if self.owner.exists() and not self._live(self.owner.get()[1], now):
            self.owner.clear()
        yield pd.DataFrame({c: [] for c in self.COLUMNS}, dtype=str)

    def close(self) -> None:
        pass


def pair_up(owners: DataFrame, members: DataFrame, expiry_ms: int, ts: str = "ts") -> DataFrame:
    """Owners (key, ts, message) and members (key, id, ts, message) resolve each other: members wait for
    their owner, an owner waits for its first member, and what waits longer than the expiry is dropped.
    Needs the RocksDB state store, where the waiting members of a key lie as separate entries."""
    a = owners.select("key", F.lit("owner").alias("side"), F.lit("").alias("id"), "message", ts)
    b = members.select("key", F.lit("member").alias("side"), "id", "message", ts)
    both = a.unionByName(b).withColumn("at", F.unix_millis(ts))
    return both.groupBy("key").transformWithStateInPandas(
        _PairUp(expiry_ms), "key string, side string, id string, message string", "Append", "EventTime",
        eventTimeColumnName="")


LEVELS = ["parent", "child", "grandchild"]


HIERARCHY = "key string, level string, crud string, at long, message string"


def hierarchy(stream: DataFrame, output: str = HIERARCHY) -> DataFrame:
    """(key, level, crud, at, message) rows of a three-level hierarchy.

    Parent inserts and updates pass while the key was deleted fewer than two times. A parent delete is
    copied to child and grandchild, a child delete to the grandchild. Orphans wait, latest version only,
    until the parent exists. The latest record per level counts.

    ``output``, given at run time, names and types the columns to return: any of these five, and fields of
    messages that are JSON objects. A field that a message lacks is null."""

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        active, deletes, child, grandchild = state.get if state.exists else (False, 0, None, None)
        waiting = {"child": child, "grandchild": grandchild}
        best: dict[str, tuple] = {}
        for pdf in pdfs:
            for level, group in pdf.groupby("level"):
                row = group.sort_values(["at", "crud", "message"]).iloc[-1]
                found = (int(row["at"]), str(row["crud"]), str(row["message"]))
                best[level] = max(best.get(level, found), found)
        for level in LEVELS[1:]:
            if waiting[level] is not None:
                at, crud, message = waiting[level].split("\x1f", 2)
                old = (int(at), crud, message)
                best[level] = max(best.get(level, old), old)
                waiting[level] = None
        out = []
        parent = best.get("parent")
        if parent is not None and parent[1] == "Delete":
            deletes, active = min(deletes + 1, 2), False
            out.append(("parent", *parent))
            for level in LEVELS[1:]:
                message = best[level][2] if level in best else parent[2]
                out.append((level, parent[0], "Delete", message))
        else:
            if parent is not None and deletes < 2:
                active = True
                out.append(("parent", *parent))
            if "child" in best and best["child"][1] == "Delete":
                message = best["grandchild"][2] if "grandchild" in best else best["child"][2]
                best["grandchild"] = (best["child"][0], "Delete", message)
            for level in LEVELS[1:]:
                if level in best:
                    if active:
                        out.append((level, *best[level]))
                    else:
                        waiting[level] = "\x1f".join(map(str, best[level]))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "level": [o[0] for o in out], "crud": [o[2] for o in out],
                                "at": [o[1] for o in out], "message": [o[3] for o in out]})
        state.update((active, deletes, waiting["child"], waiting["grandchild"]))

    out = stream.groupBy("key").applyInPandasWithState(
        step, HIERARCHY, "active boolean, deletes int, child string, grandchild string", "append", GroupStateTimeout.NoTimeout)
    wanted = T.StructType.fromDDL(output).fields
    fields = T.StructType([f for f in wanted if f.name not in out.columns])
    if fields:
        out = out.withColumn("_fields", F.from_json("message", fields))
    return out.select(*[(F.col("_fields")[f.name] if f in fields.fields else F.col(f.name).cast(f.dataType)).alias(f.name) for f in wanted])


# -- the hierarchy with rows of a schema known only at run time --------------------------------

def _plain(value, kind: T.DataType):
    """A pandas value as the state store takes it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value and not isinstance(kind, (T.DoubleType, T.FloatType))):
        return None
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        found = value if isinstance(value, dict) else value.asDict() if hasattr(value, "asDict") else dict(zip(kind.names, value, strict=True))
        return tuple(_plain(found[f.name], f.dataType) for f in kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if isinstance(kind, T.IntegralType):
        return int(value)
    return value.item() if isinstance(value, np.generic) else value


class _RowHierarchy(StatefulProcessor):
    """Per key the parent's standing and, for children and grandchildren, the latest waiting row of each id, typed as the payload given at run time."""

    def __init__(self, payload: T.StructType):
        self.payload = payload
        self.columns = ["level", "id", "crud", "at", *payload.names]
        self.kinds = [T.StringType(), T.StringType(), T.StringType(), T.LongType(), *(f.dataType for f in payload)]

    def init(self, handle) -> None:
        self.parent = handle.getValueState("parent", "active boolean, deletes int")
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("level", T.StringType()), T.StructField("id", T.StringType())]),
                                          T.StructType([T.StructField("crud", T.StringType()), T.StructField("at", T.LongType()), *self.payload.fields]))

    def handleInputRows(self, key, rows, timerValues):
        best: dict[tuple, tuple] = {}
        for pdf in rows:
            for row in zip(*(pdf[c] for c in self.columns), strict=True):
                row = tuple(_plain(v, k) for v, k in zip(row, self.kinds, strict=True))
                at = (row[0], row[1])
                if at not in best or (row[3], row[2]) >= (best[at][3], best[at][2]):
                    best[at] = row
        active, deletes = tuple(self.parent.get()) if self.parent.exists() else (False, 0)
        out = []
        parents = sorted((r for r in best.values() if r[0] == "parent"), key=lambda r: r[3])
        others = [r for r in best.values() if r[0] != "parent"]
        for row in parents:
            if row[2] == "Delete":
                deletes, active = min(deletes + 1, 2), False
                out.append(row)
            elif deletes < 2:
                active = True
                out.append(row)
        if active or any(r[2] == "Delete" for r in parents):
            others += [r for r in self._waiting() if (r[0], r[1]) not in best]
            self.waiting.clear()
        if parents and not active:
            last = parents[-1]
            out += [(*r[:2], "Delete", last[3], *r[4:]) for r in others] if last[2] == "Delete" else []
        elif active:
            deleted = {r[1] for r in others if r[0] == "child" and r[2] == "Delete"}
            out += [(*r[:2], "Delete", *r[3:]) if r[0] == "grandchild" and r[1] in deleted else r for r in others]
        else:
            for row in others:
                if not self.waiting.containsKey(row[:2]) or tuple(self.waiting.getValue(row[:2]))[1] <= row[3]:
                    self.waiting.updateValue(row[:2], row[2:])
        self.parent.update((active, deletes))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.columns])

    def _waiting(self) -> Iterator[tuple]:
        for at, row in self.waiting.iterator():
            yield (*tuple(at), *(_plain(v, k) for v, k in zip(tuple(row), self.kinds[2:], strict=True)))

    def close(self) -> None:
        pass


def row_hierarchy(stream: DataFrame, payload: T.StructType | str) -> DataFrame:
    """(key, level, id, crud, at) and the columns of ``payload``, a schema known only at run time, through three-level hierarchy state.

    Level is ``parent``, ``child`` or ``grandchild``; of each (key, level, id) the latest row of a batch, then of state and batch, counts. A level may hold many ids. Rows of children
    and grandchildren wait, with all their columns as they are typed, until the parent is there; a parent delete sends out all that came or wait as deletes, a child's delete
    the grandchildren of its id. A parent comes back while it was deleted fewer than two times. State is typed by ``payload``, so a query restarts with the
    schema it began with. Needs the RocksDB state store."""
    payload = T.StructType.fromDDL(payload) if isinstance(payload, str) else payload
    columns = ["key", "level", "id", "crud", "at", *payload.names]
    output = T.StructType([*T.StructType.fromDDL("key string, level string, id string, crud string, at long").fields, *payload.fields])
    return stream.select(*columns).groupBy("key").transformWithStateInPandas(_RowHierarchy(payload), output, "Append", "None")
