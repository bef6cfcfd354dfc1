"""Joins, reconciliation, totals and allocation helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import OrderedGroups, beside, fits_one_task, group_limit, same_keys
from tidemill.session import MAX_BROADCAST_ROWS, materialise, setting


# Values of a range sum are added as such decimals.
PREFIX = "decimal(38,12)"
# Copies of one row that are written out together.
COPY_BLOCK = 10_000


def small_enough(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, found without reading more than that many."""
    max_rows = max_rows or setting(df.sparkSession, "maxBroadcastRows", MAX_BROADCAST_ROWS)
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
                max_rows: int | None = None) -> DataFrame:
    """Join a lookup side; hinted for broadcast only when its size is checked, else left to Spark."""
    return big.join(F.broadcast(small) if small_enough(small, max_rows) else small, keys, how)


def keep_matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose whole key tuple occurs in ``other``."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def split_matched(batch: DataFrame, stored: DataFrame, keys: list[str], flag: str = "action") -> DataFrame:
    """Batch rows labelled ``update`` when their key is stored, else ``insert``."""
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    label = F.when(F.col("_known"), "update").otherwise("insert")
    return batch.join(known, keys, "left").withColumn(flag, label).drop("_known")


def missing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` absent from ``right``, counting copies. Both sides are counted per row value
    before the shuffle, so many equal rows never meet in one task."""
    cols = left.columns
    counted = left.groupBy(*cols).agg(F.count(F.lit(1)).alias("_l"))
    other = right.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_r"))
    other = other.select(*[F.col(c).alias("_o_" + c) for c in cols], "_r")
    left_over = F.col("_l") - F.coalesce(F.col("_r"), F.lit(0))
    short = counted.join(other, same_keys(cols, "_o_"), "left").withColumn("_n", left_over).where("_n > 0")
    # copies are made in blocks spread over the tasks, so one much repeated row does not fill a task
    blocks = short.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPY_BLOCK})")))
    blocks = blocks.withColumn("_n", F.least(F.lit(COPY_BLOCK), F.col("_n") - F.col("_block") * COPY_BLOCK))
    blocks = blocks.repartition(*cols, "_block")
    return blocks.withColumn("_i", F.explode(F.expr("sequence(1, cast(_n as int))"))).select(*cols)


def duplicate_key_join_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many rows an inner join on ``key`` yields per key, found without making them."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, key).withColumn("joined_rows", F.col("left_rows") * F.col("right_rows"))


def unequal_pair_counts(df: DataFrame, key: str) -> DataFrame:
    """Per value: its rows, how many ordered pairs it forms with rows of another value, and how many
    unordered pairs lie within it. Worked out from value frequencies, so no pair is made."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    total = df.count()
    return counts.select(key, "members", (F.col("members") * (F.lit(total) - F.col("members"))).alias("unequal_pairs"),
                         (F.expr("members * (members - 1) div 2")).alias("unordered_pairs"))


def expand_to_siblings(keys: DataFrame, hierarchy: DataFrame, parent: str) -> DataFrame:
    """All hierarchy rows that share a parent with one of ``keys``."""
    shared = [c for c in keys.columns if c in hierarchy.columns and c != parent]
    parents = hierarchy.join(keys.select(*shared).distinct(), shared, "left_semi").select(parent).distinct()
    return hierarchy.join(parents, parent, "left_semi").distinct()


def value_range_sum(df: DataFrame, keys: list[str], value: str, around: int, name: str, max_group_rows: int | None = None) -> DataFrame:
    """Sum of ``value`` over rows of the group whose value lies within ``around`` of the row's own.

    Equal values are added up first. The sum is the difference of two prefixes of the group's ordered distinct values, up to v + around and up to just below
    v - around: both places are put among the values and one running sum passes all of them, so however crowded the values, no row is copied to others
    and a big group is cut like any ordered group. Prefixes are added as decimals of twelve places, so their difference is exact to these; a group whose values add up to more than
    26 digits raises. Null values get null."""
    own = F.col(value).cast("double")
    counts = df.where(F.col(value).isNotNull()).withColumn("_v", own).groupBy(*keys, "_v").agg(F.sum(own.cast(PREFIX)).alias("_s"))
    none = F.lit(0).cast(PREFIX)
    # At one place what lies below comes first, then the value, then what includes it.
    places = F.array(*[F.struct((F.col("_v") + F.lit(float(tag * around))).alias("_at"), F.lit(tag).alias("_tag"), (none if tag else F.col("_s").cast(PREFIX)).alias("_add"))
                       for tag in (-1, 0, 1)])
    limit = max_group_rows or group_limit(df.sparkSession, keys)
    fits = fits_one_task(counts, keys, limit // 3, bound_by=df)
    marks = counts.select(*keys, "_v", F.explode(places).alias("_p")).select(*keys, "_v", "_p.*")
    sums = OrderedGroups(marks, keys, ["_at", "_tag", "_v"], max_group_rows=limit, fits=fits).running_sum("_upto", "_add").frame
    sums = sums.where("_tag <> 0").groupBy(*keys, "_v").agg(F.sum(F.when(F.col("_tag") > 0, F.col("_upto")).otherwise(-F.col("_upto"))).cast("double").alias(name))
    sums = sums.select(*[F.col(k).alias("_v_" + k) for k in keys], F.col("_v").alias("_v__v"), name)
    return df.withColumn("_v", own).join(sums, same_keys([*keys, "_v"], "_v_"), "left").drop("_v", "_v__v", *["_v_" + k for k in keys])


def top_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per group, ties kept."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(best, [*keys, "n"], "left_semi")


def total_across(frames: list[DataFrame], keys: list[str], value: str, name: str) -> DataFrame:
    """Total per key over several tables that share the columns."""
    parts = [f.groupBy(*keys).agg(F.sum(value).alias(name)) for f in frames]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(name).alias(name))


# -- greedy allocation ------------------------------------------------------------------------

MAX_FOLD_ROWS = 2_000
# Quantities and limits are added as decimals, so no order of adding changes a flag.
AMOUNT = "decimal(28,6)"


def allocate(df: DataFrame, keys: list[str], order: str, qty: str, limit: str,
             max_fold_rows: int | None = None) -> DataFrame:
    """Walk each group in ``order``; a row is ``ok`` when it still fits under ``limit``, else ``ko``
    and not added. Adds ``computed`` (running total with this row, a double) and ``control``.

    Quantities and limits are taken to six decimals and added exactly; bigger ones than 22 digits raise.
    A null quantity never fits and gets null and ``ko``. Groups up to ``max_fold_rows`` rows are folded
    over a sorted array. Bigger ones are settled in rounds: with capacity c left, rows of at most c/2
    surely fit until they have used up c/2, and only the first row above c/2 that still fits can change
    that. Each round finds that point with a distributed running sum and at least halves c, so about
    log2(limit / smallest qty) rounds do. Both give the same rows."""
    fold_rows = max_fold_rows or setting(df.sparkSession, "maxFoldRows", MAX_FOLD_ROWS)
    sized = beside(df, keys, _rows=F.count(F.lit(1)))
    small = sized.where(F.col("_rows") <= fold_rows).drop("_rows")
    big = sized.where(F.col("_rows") > fold_rows).drop("_rows")
    done = _allocate_by_fold(small, keys, order, qty, limit)
    if fits_one_task(df, keys, fold_rows):
        return done
    return done.unionByName(_allocate_in_rounds(big, keys, order, qty, limit).select(*done.columns))


def _control(computed: Column, limit: Column) -> Column:
    return F.when(computed <= limit, "ok").otherwise("ko")


def _allocate_by_fold(df: DataFrame, keys: list[str], order: str, qty: str, limit: str) -> DataFrame:
    entry = F.struct(F.col(order).alias("_o"), F.col(qty).cast(AMOUNT).alias("_q"), F.col(limit).cast(AMOUNT).alias("_l"),
                     F.struct(*df.columns).alias("_row"))
    groups = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    nothing = F.struct(F.lit(0).cast(AMOUNT).alias("total"), F.array().cast(f"array<{AMOUNT}>").alias("seen"))

    def step(acc, row):
        tried = (acc["total"] + row["_q"]).cast(AMOUNT)
        return F.struct(F.when(tried <= row["_l"], tried).otherwise(acc["total"]).alias("total"),
                        F.concat(acc["seen"], F.array(tried)).alias("seen"))

    seen = groups.withColumn("_seen", F.aggregate("_rows", nothing, step)["seen"])
    pairs = seen.select(F.explode(F.arrays_zip("_rows", "_seen")).alias("_p"))
    return pairs.select("_p._rows._row.*", F.col("_p._seen").cast("double").alias("computed"),
                        _control(F.col("_p._seen"), F.col("_p._rows._l")).alias("control"))


def _allocate_in_rounds(df: DataFrame, keys: list[str], order: str, qty: str, limit: str) -> DataFrame:
    q, room, used = F.col(qty).cast(AMOUNT), F.col("_room"), F.col("_used")
    groups = OrderedGroups(df, keys, [order]).row_number("_seq")
    rows = groups.df.withColumn("_room", F.col(limit).cast(AMOUNT))
    settled = []
    while True:
        small = q + q <= room
        fits_half = F.when(small, q).otherwise(F.lit(0).cast(AMOUNT))
        step = groups._next(rows).running_sum("_used", fits_half, exclusive=True).df
        step = materialise(step.withColumn("_used", used.cast(AMOUNT)))
        used_after = used + fits_half
        turning = (small & (used_after + used_after > room)) | (~small & (q <= room - used))
        left = (room - used - q).cast(AMOUNT)
        events = (step.where(turning).groupBy(*keys)
                  .agg(F.min_by(F.struct(F.col("_seq").alias("seq"), left.alias("room")), "_seq").alias("_event")))
        events = events.select(*[F.col(k).alias("_e_" + k) for k in keys], "_event")
        step = step.join(events, same_keys(keys, "_e_"), "left").drop(*["_e_" + k for k in keys])
        decided = F.col("_event").isNull() | (F.col("_seq") <= F.col("_event.seq"))
        computed = F.col(limit).cast(AMOUNT) - room + used + q
        settled.append(step.where(decided).withColumn("control", _control(computed, F.col(limit).cast(AMOUNT)))
                       .withColumn("computed", computed.cast("double")))
        rows = step.where(~decided).withColumn("_room", F.col("_event.room")).drop("_used", "_event")
        rows = materialise(rows)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, settled)
