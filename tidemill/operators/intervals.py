"""Slots, sessions, range merging and business-day counts, all without loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemill.operators.ordered import OrderedGroups, fits_one_task, group_limit
from tidemill.session import largest_group, materialise, setting

# Rows of one side that a bin of a range join may hold before it is cut, and the parts it is cut into.
MAX_BIN_ROWS = 200_000
EQUAL_PARTS = 64


def epoch_minute(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_timestamp(col) / 60)


def minute_slots(trips: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Quarter-hour slots with one 0/1 flag per covered minute (M1..M15) and their total.

    A trip covers ``start <= minute < end``. Each (trip, slot) becomes a 15-bit mask and overlapping
    trips are combined with ``bit_or``, map-side first."""
    first, last = epoch_minute(start), epoch_minute(end)
    slots = (trips.select(*keys, first.alias("_a"), last.alias("_b")).where("_a < _b")
             .withColumn("_slot", F.explode(F.expr("sequence(cast(floor(_a / 15) as bigint), cast(floor((_b - 1) / 15) as bigint))"))))
    mask = F.expr("shiftleft(1, cast(least(_b - _slot * 15, 15) as int))"
                  " - shiftleft(1, cast(greatest(_a - _slot * 15, 0) as int))")
    merged = slots.groupBy(*keys, "_slot").agg(F.bit_or(mask).alias("_mask"))
    flags = {f"M{i + 1}": F.expr(f"shiftright(_mask, {i}) & 1") for i in range(15)}
    out = merged.withColumns(flags).withColumn("minutes", F.bit_count("_mask"))
    return out.withColumn("slot_start", F.timestamp_seconds(F.col("_slot") * 900)).drop("_slot", "_mask")


def gap_sessions(events: DataFrame, keys: list[str], ts: str, tie: str, gap_minutes: int) -> DataFrame:
    """Number the sessions of each key; a new one starts when the gap exceeds ``gap_minutes``."""
    groups = OrderedGroups(events, keys, [ts, tie]).lag("_prev", ts)
    apart = F.col("_prev").isNull() | (F.unix_micros(F.col(ts).cast("timestamp"))
                                       - F.unix_micros(F.col("_prev").cast("timestamp"))
                                       > gap_minutes * 60_000_000)
    groups = groups.running_sum("session_no", F.when(apart, 1).otherwise(0))
    return groups.frame.drop("_prev")


def capped_sessions(events: DataFrame, key: str, ts: str, gap: int = 45, cap: int = 120) -> DataFrame:
    """Sessions with a gap rule and a length cap, compared on whole minutes.

    The walk in words: extend while the gap is at most ``gap`` and the session at most ``cap`` long;
    past the cap the session closes at start + cap and the next begins one minute later. Because
    ``gap < cap``, the k-th session of a run of close events starts exactly at
    ``run start + k * (cap + 1)``, so an event's session number is a division, not a fold.
    A session of one event is Broken and has no end."""
    minutes = events.select(key, epoch_minute(ts).alias("_m")).distinct()
    runs = OrderedGroups(minutes, [key], ["_m"], bound_by=events).lag("_prev", "_m")
    opens = F.col("_prev").isNull() | (F.col("_m") - F.col("_prev") > gap)
    runs = runs.fill_forward("_run", F.when(opens, F.col("_m"))).frame
    runs = runs.withColumn("_k", F.floor((F.col("_m") - F.col("_run")) / (cap + 1)))
    sessions = runs.groupBy(key, "_run", "_k").agg(F.max("_m").alias("_last"))
    # sessions of one run: at most its length in minutes / (cap + 1)
    w = Window.partitionBy(key, "_run")
    sessions = sessions.withColumn("_max_k", F.max("_k").over(w))
    start = F.col("_run") + F.col("_k") * (cap + 1)
    capped = F.col("_k") < F.col("_max_k")
    end = F.when(capped, start + cap).when(F.col("_last") > start, F.col("_last"))
    return sessions.select(
        key, F.timestamp_seconds(start * 60).alias("session_start"),
        F.timestamp_seconds(end * 60).alias("session_end"),
        F.when(end.isNull(), "Broken").otherwise("Valid").alias("status"))


def merge_adjacent(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Join date ranges where one ends the day before the next starts."""
    groups = OrderedGroups(df.select(*keys, start, end).distinct(), keys, [start, end], bound_by=df).lag("_prev", end)
    new = F.col("_prev").isNull() | (F.date_add("_prev", 1) != F.col(start))
    rows = groups.running_sum("_island", F.when(new, 1).otherwise(0)).frame
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_overlapping(df: DataFrame, keys: list[str], start: str, end: str,
                      step: Column | None = None) -> DataFrame:
    """Join ranges that overlap, touch, or start within ``step`` (default one day) of the reach so far."""
    step = F.expr("interval 1 day") if step is None else step
    ranges = df.select(*keys, start, end, F.lit(1).alias("_n"))
    fits = fits_one_task(ranges, keys, group_limit(df.sparkSession, keys))
    if not fits:  # only the longest range per start matters, and copies of a range would not be cut apart
        ranges = ranges.groupBy(*keys, start).agg(F.max(end).alias(end), F.sum("_n").alias("_n"))
    groups = OrderedGroups(ranges, keys, [start, end], fits=fits).running_max("_reach", end, exclusive=True)
    new = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + step)
    rows = groups.running_sum("_island", F.when(new, 1).otherwise(0)).frame
    return (rows.groupBy(*keys, "_island")
            .agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("ranges")).drop("_island"))


def mark_continuous(df: DataFrame, keys: list[str], start: str, end: str, name: str = "continuous",
                    over_weekend: bool = False) -> DataFrame:
    """Flag rows that the next row of the key follows on the next day (or Friday to Monday)."""
    rows = OrderedGroups(df, keys, [start, end]).lead("_next", start).frame
    follows = F.datediff("_next", end) == 1
    if over_weekend:
        friday = F.dayofweek(end) == 6
        follows = follows | (friday & (F.datediff("_next", end) == 3))
    return rows.withColumn(name, F.coalesce(follows, F.lit(False))).drop("_next")


def weekdays_before(day: Column) -> Column:
    """Weekdays from Monday 1970-01-05 up to but not including ``day``."""
    days = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def day_counts(start: Column, end: Column, holidays: Column) -> Column:
    """Struct of valid weekdays, weekend days and holiday weekdays in ``[start, end)``."""
    days = F.greatest(F.datediff(end, start), F.lit(0))
    weekdays = F.when(days > 0, weekdays_before(end) - weekdays_before(start)).otherwise(0)
    off = F.size(F.filter(F.array_distinct(holidays),
                          lambda h: (h >= start) & (h < end) & (F.weekday(h) < 5)))
    return F.struct((weekdays - off).cast("int").alias("valid_days"),
                    (days - weekdays).cast("int").alias("weekend_days"), off.alias("holiday_days"))


def months_between_dates(df: DataFrame, start: str, end: str, name: str = "period") -> DataFrame:
    """One row per calendar month touched by the range, as ``yyyyMM``."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return df.withColumn(name, F.explode(months)).withColumn(name, F.date_format(name, "yyyyMM"))


def consecutive_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers per key."""
    rows = OrderedGroups(df.select(*keys, value).distinct(), keys, [value], bound_by=df).row_number("_i").frame
    return (rows.groupBy(*keys, (F.col(value) - F.col("_i")).alias("_run"))
            .agg(F.min(value).alias("run_start"), F.max(value).alias("run_end"),
                 F.count(F.lit(1)).alias("run_length")).drop("_run"))


def range_join(rows: DataFrame, refs: DataFrame, keys: list[str], start: str, end: str, point: str,
               bin_days: int = 32, max_bin_rows: int | None = None) -> DataFrame:
    """Pairs with equal keys and ``start < point < end``. Ranges are spread over fixed day bins and
    the point looks into its own bin, so a hot key is cut by time and each pair appears once. Ranges
    are cut to the span of their key's points first, so an open end costs no bins without points.

    A bin of a key with more than ``max_bin_rows`` (``spark.tidemill.maxBinRows``) rows of one side is cut again, at the quantiles of its points, into parts of about equal depth. A part
    that is still too full, as one day may be, is dealt in a grid: its bigger side by a hash into as many pieces as it needs, and the other side to all of them."""
    def bin_of(c):
        return F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bin_days)
    right = refs.withColumn("_bin", bin_of(F.col(point)))
    span = right.groupBy(*keys).agg(F.min("_bin").alias("_low"), F.max("_bin").alias("_high"))
    left = (rows.join(span, keys).withColumn("_low", F.greatest("_low", bin_of(F.col(start))))
            .withColumn("_high", F.least("_high", bin_of(F.col(end))))
            .where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col("_low") <= F.col("_high"))))
    left = left.withColumn("_bin", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    on = [*keys, "_bin"]
    inside = (F.col(point) > F.col(start)) & (F.col(point) < F.col(end))
    limit = max_bin_rows or setting(rows.sparkSession, "maxBinRows", MAX_BIN_ROWS)
    # A bin's rows are at most those of its key: where no key is over the limit, no bin is, and only the keys are counted.
    if largest_group(refs, keys) <= limit and largest_group(rows, keys) <= limit:
        return left.join(right, on).where(inside).drop("_bin")
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l"), F.lit(0).cast("long").alias("_r")).unionByName(
        right.groupBy(*on).agg(F.lit(0).cast("long").alias("_l"), F.count(F.lit(1)).alias("_r")))
    counts = counts.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    full = counts.where(F.greatest("_l", "_r") > limit).select(*on)
    shares = [i / EQUAL_PARTS for i in range(1, EQUAL_PARTS)]
    day = F.unix_micros(F.col(point).cast("timestamp"))
    cuts = materialise(right.join(full, on, "left_semi").groupBy(*on).agg(F.array_distinct(F.percentile_approx(day, shares, 10_000)).alias("_cuts")))

    def part(c):
        return F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.unix_micros(c.cast("timestamp")))), F.lit(0))
    left = left.join(cuts, on, "left").withColumn("_part", F.explode(F.sequence(part(F.col(start)), part(F.col(end))))).drop("_cuts")
    right = right.join(cuts, on, "left").withColumn("_part", part(F.col(point))).drop("_cuts")
    on = [*on, "_part"]
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l"), F.lit(0).cast("long").alias("_r")).unionByName(
        right.groupBy(*on).agg(F.lit(0).cast("long").alias("_l"), F.count(F.lit(1)).alias("_r")))
    counts = counts.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    grid = materialise(counts.where(F.greatest("_l", "_r") > limit).select(
        *on, F.ceil(F.greatest("_l", "_r") / limit).cast("int").alias("_pieces"), (F.col("_l") >= F.col("_r")).alias("_by_left")))

    def dealt(df, mine):
        df = df.join(grid, on, "left")
        own = F.array(F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]), F.col("_pieces")).cast("int"))
        every = F.sequence(F.lit(0), F.col("_pieces") - 1)
        piece = F.when(F.col("_pieces").isNull(), F.array(F.lit(0))).when(F.col("_by_left") == F.lit(mine), own).otherwise(every)
        return df.withColumn("_piece", F.explode(piece)).drop("_pieces", "_by_left")
    return dealt(left, True).join(dealt(right, False), [*on, "_piece"]).where(inside).drop("_bin", "_part", "_piece")


def as_of_lookup(rows: DataFrame, dated: DataFrame, keys: list[str], at: str, start: str,
                 values: list[str], bound_by: DataFrame | None = None) -> DataFrame:
    """Each row with the values of the latest dated entry of its key that started at or before ``at``. ``bound_by`` is a frame cheaper to count than both
    inputs, with at least as many rows per key as they have together.

    Both sides are put in one ordered stream per key and the last entry is carried forward, so no
    pairs are made and a hot key is cut by time like any other ordered group."""
    entry = dated.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"),
                         F.struct(F.col(start), *values).alias("_entry"))
    plain = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_src"))
    both = entry.unionByName(plain, allowMissingColumns=True)
    filled = OrderedGroups(both, keys, ["_at", "_kind"], bound_by=bound_by).fill_forward("_found", "_entry").frame.where("_kind = 1")
    return filled.select("_src.*", *[F.col("_found")[c].alias(c) for c in [start, *values]])
