"""Aggregates that the plain API does not name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_subtotals(df: DataFrame, keys: list[str], detail: str, label: str, **aggs: Column) -> DataFrame:
    """Detail rows plus one ``subTotal`` row per key, in one pass over the data."""
    sets = [[F.col(k) for k in [*keys, detail]], [F.col(k) for k in keys]]
    rows = df.groupingSets(sets, *[F.col(k) for k in [*keys, detail]]).agg(
        F.grouping_id().alias("_level"), *[a.alias(n) for n, a in aggs.items()])
    name = F.when(F.col("_level") > 0, "subTotal").otherwise(F.col(detail).cast("string"))
    return rows.select(*keys, name.alias(label), *aggs)


def speed(distance: Column | str, seconds: Column | str) -> Column:
    """Struct of total distance and distance per hour."""
    d, s = F.sum(distance), F.sum(seconds)
    return F.struct(d.alias("distance"), (d / (s / 3600)).alias("speed"))


def lap_speeds(laps: DataFrame, driver: str, lap: str, sector: str, distance: str, seconds: str) -> DataFrame:
    """Speed per driver, lap and sector; sector 0 is the whole lap, sector -1 the driver's fastest lap."""
    cols = [F.col(c) for c in (driver, lap, sector)]
    levels = laps.groupingSets([cols, cols[:2]], *cols).agg(
        F.grouping_id().alias("_level"), (F.sum(distance) / (F.sum(seconds) / 3600)).alias("speed"))
    speeds = levels.select(driver, lap, F.when(F.col("_level") > 0, 0).otherwise(F.col(sector)).alias(sector), "speed")
    whole = laps.groupBy(driver, lap).agg((F.sum(distance) / (F.sum(seconds) / 3600)).alias("speed"))
    fastest = whole.groupBy(driver).agg(
        F.max_by(F.struct(lap, "speed"), F.struct("speed", -F.col(lap))).alias("_best"))
    best = fastest.select(driver, F.col("_best")[lap].alias(lap), F.lit(-1).alias(sector), "_best.speed")
    return speeds.unionByName(best).withColumn("speed", F.round("speed", 4))
