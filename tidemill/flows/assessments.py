"""Change-tracked assessment metadata in three levels: exam year, subjects, exam type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.merge import merge, update
from tidemill.operators.ordered import latest
from tidemill.operators.scd import guarded_changes
from tidemill.session import materialise


def apply_level(stored: DataFrame, feed: DataFrame, keys: list[str], tracked: list[str], start: str, end: str,
                verb: str = "crud") -> DataFrame:
    """Versioned merge of one level: newer and different rows close the open version 60 seconds before
    they start and open a new one; deletes close it at their own start; late or equal rows change nothing."""
    source = latest(feed, keys, [start, verb])
    judged = guarded_changes(stored, source, keys, tracked, start, end, verb)
    closing = judged.where(F.col(verb).isin("Computed", "Delete")).groupBy(*keys).agg(F.min(end).alias("_close"))
    open_row = F.col(f"t.{end}").isNull()
    closed = merge(stored, closing, keys, [update({end: F.col("s._close")}, open_row)], check=False)
    fresh = judged.where(~F.col(verb).isin("Computed", "Delete")).select(*stored.columns)
    return closed.unionByName(fresh)


def parents_first(child: DataFrame, parent: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Child rows whose parent key is stored, and the orphans that wait."""
    known = parent.select(*keys).distinct()
    return child.join(known, keys, "left_semi"), child.join(known, keys, "left_anti")


def copy_deletes(parent_feed: DataFrame, level: DataFrame, keys: list[str], start: str, end: str, verb: str = "crud") -> DataFrame:
    """Delete records for every open child row under a deleted parent."""
    gone = parent_feed.where(F.col(verb) == "Delete").groupBy(*keys).agg(F.max(start).alias("_at"))
    rows = level.where(F.col(end).isNull()).join(gone, keys)
    return rows.withColumn(start, F.col("_at")).withColumn(verb, F.lit("Delete")).drop("_at", end)


@dataclass
class Levels:
    parents: DataFrame
    children: DataFrame
    grandchildren: DataFrame
    orphans: DataFrame


def apply_batch(stored: Levels, feed: DataFrame, keys: list[str], tracked: dict[str, list[str]], identity: dict[str, list[str]],
                start: str, end: str, verb: str = "crud", level: str = "level") -> Levels:
    """One batch over the three tables. ``feed`` holds all levels in one frame, with a column per
    tracked value; rows that waited as orphans join it. Parents go first, then children, then
    grandchildren; deletes are copied downwards and rows without a parent wait."""
    feed = feed.unionByName(stored.orphans)

    def rows(name):
        return feed.where(F.col(level) == name).select(*dict.fromkeys([*keys, *identity[name], *tracked[name], start, verb]))

    first = rows("parent")
    parents = materialise(apply_level(stored.parents, first, keys, tracked["parent"], start, end, verb))

    def below(name, table, upper_feed):
        known, _ = parents_first(rows(name), parents, keys)
        copied = copy_deletes(upper_feed, table, keys, start, end, verb).select(*known.columns)
        merged = apply_level(table, known.unionByName(copied), identity[name], tracked[name], start, end, verb)
        return merged, known.unionByName(copied)

    children, child_feed = below("child", stored.children, first)
    upper = first.select(*keys, start, verb).unionByName(child_feed.select(*keys, start, verb))
    grandchildren, _ = below("grandchild", stored.grandchildren, upper)
    held = feed.where(F.col(level) != "parent").join(parents.select(*keys).distinct(), keys, "left_anti")
    return Levels(parents, children, grandchildren, held)
