"""Event-time windows and joins between streams. All of them also run on batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import OrderedGroups


def windowed(df: DataFrame, ts: str, length: str, keys: list[str], slide: str | None = None, late: str | None = None,
             **aggs: Column) -> DataFrame:
    """Tumbling or sliding windows per key; with ``late`` a watermark closes windows and drops later rows."""
    df = df.withWatermark(ts, late) if late else df
    out = df.groupBy(F.window(ts, length, slide), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None, **aggs: Column) -> DataFrame:
    """Sessions per key that close after ``gap`` without an event.

    Streams use the session window. Batch frames number the sessions with ordered groups instead,
    because a session window sorts all rows of a key in one task."""
    if df.isStreaming:
        df = df.withWatermark(ts, late) if late else df
        out = df.groupBy(F.session_window(ts, gap), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
        return out.select(F.col("session_window.start").alias("window_start"),
                          F.col("session_window.end").alias("window_end"), *keys, *aggs)
    length = F.expr(f"interval {gap}")
    groups = OrderedGroups(df, keys, [ts]).lag("_prev", ts)
    opens = F.col("_prev").isNull() | (F.col(ts) >= F.col("_prev") + length)
    rows = groups.running_sum("_session", F.when(opens, 1).otherwise(0)).frame
    out = rows.groupBy(*keys, "_session").agg(F.min(ts).alias("window_start"), (F.max(ts) + length).alias("window_end"),
                                              *[a.alias(n) for n, a in aggs.items()])
    return out.select("window_start", "window_end", *keys, *aggs)


def with_own_windows(df: DataFrame, ts: str, length: str, key: str, late: str, salts: int = 16, **aggs: Column) -> DataFrame:
    """A stream beside the totals of the tumbling window each row falls into.

    Totals are combined map-side and copied to every salt, rows are dealt over the salts by a hash of their values, so that
    a key with most of a window's rows lies in several state partitions."""
    marked = df.withWatermark(ts, late)
    totals = marked.groupBy(F.window(ts, length).alias("_w"), F.col(key).alias("_k")).agg(*[a.alias(n) for n, a in aggs.items()])
    totals = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = marked.withColumn("_window", F.window(ts, length)).withColumn("_salt", F.pmod(F.hash(*df.columns), F.lit(salts)))
    on = (F.col(key) == F.col("_k")) & (F.col("_window") == F.col("_w")) & (F.col("_salt") == F.col("_s"))
    return rows.join(totals, on).drop("_w", "_k", "_window", "_salt", "_s")


def join_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, how: str = "inner",
                late: str = "10 minutes") -> DataFrame:
    """Stream–stream join: equal key and the right row at most ``within`` after the left one. The time
    bound and the watermarks let Spark drop old state and emit unmatched rows of outer joins."""
    l = left.withWatermark(left_ts, late)
    r = right.withWatermark(right_ts, late).withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & (F.col(right_ts) >= F.col(left_ts)) & (
        F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    joined = l.join(r, on, how)
    return joined.withColumn(key, F.coalesce(key, "_key")).drop("_key")
