"""Season standings and the first-to-reach leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import OrderedGroups, ranks
from tidemill.operators.relational import lookup_join
from tidemill.session import materialise


def season_standings(results: DataFrame, points: DataFrame) -> DataFrame:
    """``results`` holds (season, race, driver, position), ``points`` the valid (season, position, point).

    Drivers with points are placed by points and mean position; drivers without any follow them,
    placed by mean position."""
    scored = lookup_join(results, points, ["season", "position"]).na.fill(0, ["point"])
    totals = scored.groupBy("season", "driver").agg(
        F.sum("point").alias("total_points"), (F.sum("position") / F.count("race")).alias("mean_position"))
    totals = totals.withColumn("_zero", F.when(F.col("total_points") == 0, 1).otherwise(0))
    placed = OrderedGroups(materialise(totals), ["season"], ["_zero", "-total_points", "mean_position", "driver"]).row_number("standing")
    return placed.frame.drop("_zero")


def leaderboard(stored: DataFrame, batch: DataFrame, driver: str, points: str, ts: str) -> DataFrame:
    """Add the batch's points; the time moves only when the total changes. Place by points, then by who got there first."""
    news = batch.groupBy(driver).agg(F.sum(points).alias("_add"), F.max(ts).alias("_at"))
    both = stored.join(news, driver, "full")
    changed = F.coalesce(F.col("_add"), F.lit(0)) != 0
    both = both.select(driver, (F.coalesce(points, F.lit(0)) + F.coalesce("_add", F.lit(0))).alias(points),
                       F.when(changed | F.col(ts).isNull(), F.col("_at")).otherwise(F.col(ts)).alias(ts))
    return ranks(materialise(both), [], ["-" + points, ts], rank="place")
