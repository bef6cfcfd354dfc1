"""Registry of queries: a Spark function and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from tidemill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the orders table of one scale-factor folder."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str):
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return fn
    return register
