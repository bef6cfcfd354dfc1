"""Set-based merge: ordered WHEN clauses over a keyed target and source.

The result is a new DataFrame; the caller writes it to a new version or to the touched partitions.
Clause conditions and values see the stored row as ``t.<column>`` and the new one as ``s.<column>``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import latest


@dataclass(frozen=True)
class Clause:
    action: str
    when: Column | None = None
    values: dict = field(default_factory=dict)


def update(values: dict | None = None, when: Column | None = None) -> Clause:
    """Set the given columns; without values, every column the source has."""
    return Clause("update", when, values or {})


def delete(when: Column | None = None) -> Clause:
    return Clause("delete", when)


def insert(values: dict | None = None, when: Column | None = None) -> Clause:
    """Insert the given columns; without values, every column the source has."""
    return Clause("insert", when, values or {})


def _value(column: Column | str) -> Column:
    return F.expr(column) if isinstance(column, str) else column


def _first_true(clauses: list[Clause], applies: Column) -> Column:
    """Number of the first clause whose condition holds, else -1."""
    out = F.when(~applies, -1)
    for i, clause in enumerate(clauses):
        condition = F.lit(True) if clause.when is None else F.coalesce(_value(clause.when), F.lit(False))
        out = out.when(condition, i)
    return out.otherwise(-1)


def _columns(names, clauses, source_names, keep) -> list[Column]:
    out = []
    for name in names:
        result = F
        for i, clause in enumerate(clauses):
            if clause.action == "delete":
                continue
            if clause.values:
                value = _value(clause.values[name]) if name in clause.values else keep(name)
            else:
                value = F.col("s." + name) if name in source_names else keep(name)
            result = result.when(F.col("_clause") == i, value)
        out.append((keep(name) if result is F else result.otherwise(keep(name))).alias(name))
    return out


def check_unique(source: DataFrame, keys: list[str]) -> None:
    doubled = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not doubled.isEmpty():
        raise ValueError(f"merge source has several rows for one key {keys}")


def merge(target: DataFrame, source: DataFrame, keys: list[str], matched: list[Clause] = (),
          not_matched: list[Clause] = (), check: bool = True) -> DataFrame:
    """Rows of ``target`` after applying the clauses; of each list the first true clause wins.

    The stored side is on the left of a left join, so a key that fills much of the target can be
    split by the adaptive skew join. New keys come from an anti join that reads only the stored keys."""
    if check:
        check_unique(source, keys)
    matched, not_matched = list(matched), list(not_matched)
    s = source.withColumn("_hit", F.lit(True)).alias("s")
    t = target.alias("t")
    on = reduce(lambda a, b: a & b, [F.col("t." + k) == F.col("s." + k) for k in keys])
    both = t.join(s, on, "left").withColumn(
        "_clause", _first_true(matched, F.coalesce(F.col("s._hit"), F.lit(False))))
    gone = [i for i, c in enumerate(matched) if c.action == "delete"]
    if gone:
        both = both.where(~F.col("_clause").isin(gone))
    kept = both.select(*_columns(target.columns, matched, source.columns, lambda n: F.col("t." + n)))
    if not not_matched:
        return kept
    fresh = source.join(target.select(*keys), keys, "left_anti").alias("s")
    fresh = fresh.withColumn("_clause", _first_true(not_matched, F.lit(True))).where("_clause >= 0")
    types = {f.name: f.dataType for f in target.schema}
    added = fresh.select(*_columns(target.columns, not_matched, source.columns,
                                   lambda n: F.lit(None).cast(types[n])))
    return kept.unionByName(added)


def update_where(df: DataFrame, predicate: Column, values: dict) -> DataFrame:
    """Change the given columns on rows where the predicate is true."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.select(*[F.when(hit, _value(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
                       for c in df.columns])


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the predicate is not true."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def replace_where(df: DataFrame, predicate: Column, new: DataFrame) -> DataFrame:
    """Drop the rows matching the predicate and add the new ones; raises if some of them do not match it."""
    if not new.where(~F.coalesce(predicate, F.lit(False))).isEmpty():
        raise ValueError("some new rows do not match the predicate")
    return delete_where(df, predicate).unionByName(new)


def append_evolving(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows that may bring new columns; older rows read null there."""
    return old.unionByName(new, allowMissingColumns=True)


def as_of(changes: DataFrame, keys: list[str], order: list[str], at: Column, operation: str = "op") -> DataFrame:
    """State at a version or time: the newest change per key whose ``order[0]`` is not after ``at``,
    without deleted keys."""
    now = latest(changes.where(F.col(order[0]) <= at), keys, order)
    return now.where(F.col(operation) != "delete")


def changed_between(older: DataFrame, newer: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys inserted, updated or deleted between two states."""
    a = older.select(*keys, F.struct(*columns).alias("_old"))
    b = newer.select(*keys, F.struct(*columns).alias("_new"))
    change = (F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
              .when(F.col("_old") != F.col("_new"), "update"))
    return a.join(b, keys, "full").withColumn("change", change).where("change is not null").drop("_old", "_new")


def apply_feed(target: DataFrame, feed: DataFrame, keys: list[str], order: list[str],
               action: str = "action") -> DataFrame:
    """Apply insert / update / delete records; the newest record per key decides."""
    source = latest(feed, keys, order)
    gone = F.col(f"s.{action}") == "delete"
    return merge(target, source, keys, [delete(gone), update()], [insert(when=~gone)], check=False)
