"""User-defined functions in every shape Spark offers, for rules that expressions cannot say.

Each has an expression twin in this package; use that one where it exists. Scalar functions work on
Arrow batches, group functions get groups that were aggregated before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register(spark: SparkSession, name: str, fn: Callable, returns: str) -> Callable:
    """Register a function of pandas series for use in SQL; returns it for use as a column function."""
    udf = F.pandas_udf(fn, returns)
    spark.udf.register(name, udf)
    return udf


def lookup_category(members: dict[str, list[str]], default: str) -> Callable:
    """Series function giving the label whose member list holds the trimmed lower-case value."""
    labels = {m: label for label, ms in members.items() for m in ms}

    def fn(values: pd.Series) -> pd.Series:
        return values.str.strip().str.lower().map(labels).fillna(default)

    return fn


def day_kinds(start: pd.Series, end: pd.Series) -> pd.Series:
    """Array of weekdays and weekend days in ``[start, end)``: five weekdays to each whole week since a Monday, and those of the week begun."""
    monday = pd.Timestamp("1970-01-05")
    a, b = ((s.dt.normalize() - monday).dt.days for s in (start, end))
    week = sum(sign * (5 * (d // 7) + (d % 7).clip(upper=5)) for sign, d in ((-1, a), (1, b)))
    return pd.Series([list(pair) for pair in zip(week.tolist(), (b - a - week).tolist(), strict=True)])


def weighted_speed(distance: pd.Series, seconds: pd.Series) -> float:
    """Aggregate: distance per hour."""
    return float(distance.sum() / (seconds.sum() / 3600))


def row_to_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], tuple[np.ndarray, list[pa.Array]]], schema: str) -> DataFrame:
    """Rows to several rows each, an Arrow batch at a time: ``fn`` gives the places of the rows to repeat and the new columns beside them; ``schema`` names these."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    out = T.StructType([*df.schema.fields, *T.StructType.fromDDL(schema).fields])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            at, columns = fn(batch)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*batch.schema.names, *names])
    return df.mapInArrow(batches, out)


def slots(first: str, last: str, minutes: int = 15) -> Callable:
    """For ``row_to_rows``: the slots that a range of epoch minutes touches; a row whose range is empty or null gives none."""
    def fn(batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        a, b = (pc.fill_null(batch.column(c), 0).to_numpy() for c in (first, last))
        low = a // minutes
        n = np.where(b > a, (b - 1) // minutes - low + 1, 0)
        at = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, [pa.array((low[at] + within) * minutes, pa.int64())]
    return fn


def per_partition(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a frame function to every Arrow batch of a partition."""
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield fn(pdf)
    return df.mapInPandas(batches, schema)
