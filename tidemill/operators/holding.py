"""Hold child rows until their parents are known; the held rows live in a table between batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import latest


@dataclass
class Step:
    released: DataFrame
    held: DataFrame


def drop_expired(held: DataFrame, ts: str, now: Column, expiry: str) -> DataFrame:
    """Rows whose age is below the expiry interval."""
    return held.where(F.col(ts) + F.expr(f"interval {expiry}") > now)


def resolve(held: DataFrame, batch: DataFrame, parents: list[tuple[DataFrame, list[str]]], identity: list[str],
            ts: str, now: Column, expiry: str) -> Step:
    """One batch step: expire old held rows, add the batch, keep the latest row per identity, release
    rows whose every parent key is known and hold the rest. Parent keys are deduplicated first, so
    each row is looked up once per parent table, however often a parent key occurs."""
    rows = drop_expired(held, ts, now, expiry).unionByName(batch)
    rows = latest(rows, identity, [ts])
    for i, (parent, keys) in enumerate(parents):
        known = parent.select(*keys).distinct().withColumn(f"_known{i}", F.lit(True))
        rows = rows.join(known, keys, "left")
    flags = [f"_known{i}" for i in range(len(parents))]
    complete = F.lit(True)
    for f in flags:
        complete = complete & F.col(f).isNotNull()
    columns = batch.columns
    return Step(rows.where(complete).select(*columns), rows.where(~complete).select(*columns))
