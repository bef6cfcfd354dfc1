"""Upserts and slowly changing dimensions as functions of (stored, batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.merge import delete, insert, merge, update
from tidemill.operators.ordered import OrderedGroups, beside, latest, same_keys, top_n


def scd1(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Updated rows (batch wins where not null), untouched rows and new rows."""
    values = {c: F.coalesce(F.col("s." + c), F.col("t." + c)) for c in batch.columns if c not in keys}
    return merge(stored, batch, keys, [update(values)], [insert()])


def rows_to_back_up(stored: DataFrame, batch: DataFrame, keys: list[str], stamp: Column, batch_no: int) -> DataFrame:
    """Stored rows about to change, stamped with time and batch number."""
    hit = stored.join(batch.select(*keys).distinct(), keys, "left_semi")
    return hit.withColumn("backup_time", stamp).withColumn("batch_no", F.lit(batch_no))


def scd2_by_lead(history: DataFrame, batch: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Base and batch together; each row ends the day before the next one of its key starts."""
    both = history.unionByName(batch, allowMissingColumns=True)
    return effective_dates(both, keys, start, end)


def effective_dates(df: DataFrame, keys: list[str], start: str, end: str, bound_by: DataFrame | None = None) -> DataFrame:
    rows = OrderedGroups(df.drop(end), keys, [start], bound_by=bound_by).lead("_next", start).frame
    return rows.withColumn(end, F.date_add("_next", -1)).drop("_next")


def scd2_close_open(history: DataFrame, batch: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Close the open row the day before the batch start and add the batch rows. A batch row with an
    end but no start only ends the open row; a later start resumes the key."""
    news = batch.groupBy(*keys).agg(F.min(start).alias("_start"), F.max(end).alias("_end"))
    news = news.select(*[F.col(k).alias("_n_" + k) for k in keys], "_start", "_end")
    closing = F.coalesce(F.col(end), F.date_add("_start", -1), F.col("_end"))
    old = (history.join(news, same_keys(keys, "_n_"), "left").withColumn(end, closing)
           .drop("_start", "_end", *["_n_" + k for k in keys]))
    return old.unionByName(batch.where(F.col(start).isNotNull()))


def scd2_staged_merge(stored: DataFrame, batch: DataFrame, key: str, start: str, end: str,
                      active: str, at: Column) -> DataFrame:
    """One merge that both closes and inserts: changed keys are staged twice, once with the merge key
    (closes the active row) and once with a null merge key (always inserted)."""
    current = stored.where(F.col(active))
    known = batch.join(current.select(key).distinct(), key, "left_semi")
    staged = (batch.withColumn("merge_key", F.col(key))
              .unionByName(known.withColumn("merge_key", F.lit(None).cast(stored.schema[key].dataType))))
    close = current.withColumn("merge_key", F.col(key))
    closed = (close.join(staged.select("merge_key").distinct(), "merge_key", "left_semi")
              .withColumn(active, F.lit(False)).withColumn(end, at).drop("merge_key"))
    kept = stored.where(~F.col(active)).unionByName(
        close.join(staged.select("merge_key").distinct(), "merge_key", "left_anti").drop("merge_key"))
    fresh = staged.join(close.select("merge_key").distinct(), "merge_key", "left_anti").drop("merge_key")
    fresh = (fresh.withColumn(active, F.lit(True)).withColumn(start, at)
             .withColumn(end, F.lit(None).cast(stored.schema[end].dataType)))
    return kept.unionByName(closed).unionByName(fresh.select(*stored.columns))


def scd3(stored: DataFrame, batch: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """Current value plus the previous one in ``prev_<column>``."""
    wide = stored.withColumns({f"prev_{c}": F.lit(None).cast(stored.schema[c].dataType)
                               for c in tracked if f"prev_{c}" not in stored.columns})
    values = {}
    for c in tracked:
        changed = ~F.col("s." + c).eqNullSafe(F.col("t." + c))
        values[f"prev_{c}"] = F.when(changed, F.col("t." + c)).otherwise(F.col("t.prev_" + c))
        values[c] = F.col("s." + c)
    return merge(wide, batch, keys, [update(values)], [insert()])


def dated_prices(points: DataFrame, keys: list[str], start: str, end: str, value: str) -> DataFrame:
    """Effective-date table from point-in-time values; the lowest value wins on one start date."""
    lowest = points.groupBy(*keys, start).agg(F.min(value).alias(value))
    return effective_dates(lowest, keys, start, end, bound_by=points)


def load_dated(stored: DataFrame, batch: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Load effective-dated rows against the latest stored row of their key.

    Open and older start: close it the day before, insert. Closed before the new start: insert.
    Closed on the new start: insert from the next day. Closed after it: insert what lies after the
    stored end, if anything. Nothing stored: insert. Anything else is ignored."""
    last = latest(stored.select(*keys, start, end), keys, [start])
    last = last.select(*[F.col(k).alias("_l_" + k) for k in keys],
                       F.col(start).alias("_ls"), F.col(end).alias("_le"), F.lit(True).alias("_known"))
    new = batch.join(last, same_keys(keys, "_l_"), "left")
    s, e, ls, le = F.col(start), F.col(end), F.col("_ls"), F.col("_le")
    after = e.isNull() | (e > le)
    case = (F.when(F.col("_known").isNull(), 5)
            .when(le.isNull() & (ls < s), 1).when(le < s, 2)
            .when((le == s) & after, 3).when((le > s) & after, 4))
    new = new.withColumn("_case", case).where("_case is not null")
    new = new.withColumn(start, F.when(F.col("_case").isin(3, 4), F.date_add(le, 1)).otherwise(s))
    closing = new.where("_case = 1").groupBy(*keys).agg(F.date_add(F.min(start), -1).alias("_close"))
    closing = closing.select(*[F.col(k).alias("_l_" + k) for k in keys], "_close")
    kept = (stored.join(closing, same_keys(keys, "_l_"), "left")
            .withColumn(end, F.coalesce(F.col(end), F.col("_close"))))
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))


def upsert_by_revision(stored: DataFrame, batch: DataFrame, keys: list[str], revision: str,
                       value: str, ts: str) -> DataFrame:
    """Newer revision replaces the row; the same revision with another value updates it; the same
    value refreshes only the time."""
    source = latest(batch, keys, [revision, ts])
    same = F.col("s." + revision) == F.col("t." + revision)
    changed = F.col("s." + value) != F.col("t." + value)
    return merge(stored, source, keys, [
        update(when=F.col("s." + revision) > F.col("t." + revision)),
        update({value: F.col("s." + value), ts: F.col("s." + ts)}, when=same & changed),
        update({ts: F.greatest(F.col("s." + ts), F.col("t." + ts))}, when=same),
    ], [insert()], check=False)


def add_counters(stored: DataFrame, batch: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Stored totals plus the batch's counts."""
    counted = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    return (stored.select(*keys, total).unionByName(counted)
            .groupBy(*keys).agg(F.sum(total).alias(total)))


def classify(stored: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Batch rows labelled insert, update or unchanged."""
    old = stored.select(*[F.col(k).alias("_o_" + k) for k in keys], F.struct(*columns).alias("_old"))
    label = (F.when(F.col("_old").isNull(), "insert")
             .when(F.col("_old") != F.struct(*columns), "update").otherwise("unchanged"))
    return (batch.join(old, same_keys(keys, "_o_"), "left").withColumn("action", label)
            .drop("_old", *["_o_" + k for k in keys]))


def newer_wins(stored: DataFrame, batch: DataFrame, keys: list[str], ts: str, verb: str) -> DataFrame:
    """Newest batch record per key; a delete verb removes, an older record changes nothing."""
    source = latest(batch, keys, [ts, verb])
    newer = F.col("s." + ts) > F.col("t." + ts)
    gone = F.col("s." + verb) == "delete"
    return merge(stored, source, keys, [delete(newer & gone), update(when=newer)],
                 [insert(when=~gone)], check=False)


def invalidate_and_insert(stored: DataFrame, batch: DataFrame, keys: list[str], flag: str, closed: str,
                          at: Column) -> DataFrame:
    """Soft-delete the valid rows of the batch's keys and append the batch as valid."""
    hit = batch.select(*keys).distinct().withColumn("_hit", F.lit(True))
    old = stored.join(hit, keys, "left")
    off = F.col("_hit").isNotNull() & F.col(closed).isNull()
    old = (old.withColumn(flag, F.when(off, "N").otherwise(F.col(flag)))
           .withColumn(closed, F.when(off, at).otherwise(F.col(closed))))
    fresh = batch.withColumn(flag, F.lit("Y")).withColumn(closed, F.lit(None).cast(stored.schema[closed].dataType))
    return old.select(*stored.columns).unionByName(fresh.select(*stored.columns))


def cap_active(stored: DataFrame, batch: DataFrame, parent: str, child: str, flag: str, cap: int) -> DataFrame:
    """Batch children whose parent has room for them: active children not in the batch, plus the
    batch's own in child order, may not exceed ``cap``."""
    active = stored.where(F.col(flag) == "Y").select(parent, child)
    others = active.join(batch.select(child).distinct(), child, "left_anti")
    used = others.groupBy(parent).agg(F.count(F.lit(1)).alias("_used"))
    ranked = top_n(batch, [parent], [child], cap, "_rn")
    fits = F.col("_rn") + F.coalesce(F.col("_used"), F.lit(0)) <= cap
    return ranked.join(used, parent, "left").where(fits).drop("_rn", "_used")


def guarded_changes(stored: DataFrame, source: DataFrame, keys: list[str], tracked: list[str],
                    start: str, end: str, verb: str = "crud") -> DataFrame:
    """Rows to merge into a versioned table. An incoming change that is newer and differs yields a
    ``Computed`` row closing the open one 60 seconds before it; a late or equal one makes its key
    ``Defective``, and that key's rows are dropped. Deletes end at their own start."""
    open_rows = stored.where(F.col(end).isNull()).select(
        *[F.col(k).alias("_o_" + k) for k in keys], F.col(start).alias("_start"),
        F.struct(*tracked).alias("_old"))
    changes = source.where(F.col(verb) != "Delete").join(open_rows, same_keys(keys, "_o_"))
    good = (F.col(start) > F.col("_start")) & (F.col("_old") != F.struct(*tracked))
    judged = changes.withColumn(verb, F.when(good, "Computed").otherwise("Defective"))
    bad = judged.where(F.col(verb) == "Defective").select(*keys).distinct()
    closing = judged.where(F.col(verb) == "Computed").select(*source.columns)
    passed = closing.unionByName(source).join(bad, keys, "left_anti")
    ends = (F.when(F.col(verb) == "Computed", F.col(start) - F.expr("interval 60 seconds"))
            .when(F.col(verb) == "Delete", F.col(start)))
    return passed.withColumn(end, ends)


def cascade_deletes(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, deleted: DataFrame,
                    parent_key: str, child_key: str, end: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Close every open row under the deleted parents. ``deleted`` holds (parent_key, end)."""
    gone = deleted.groupBy(parent_key).agg(F.min(end).alias("_end"))

    def close(level: DataFrame, by: DataFrame, key: str) -> DataFrame:
        return (level.join(by, key, "left").withColumn(end, F.coalesce(F.col(end), F.col("_end")))
                .select(*level.columns))

    hit = children.join(gone, parent_key).groupBy(child_key).agg(F.min("_end").alias("_end"))
    return close(parents, gone, parent_key), close(children, gone, parent_key), close(grandchildren, hit, child_key)
