"""Schemas that are known only at run time, and comparing schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_ddl(text: str) -> str:
    """``name:type~name:type`` or ``name type;name type`` as a DDL string."""
    pair, sep = (":", "~") if ":" in text.split("~")[0] and "<" not in text.split(":")[0] else (" ", ";")
    fields = [f.strip().split(pair, 1) for f in text.split(sep) if f.strip()]
    return ", ".join(f"`{name.strip()}` {_type(kind.strip())}" for name, kind in fields)


def _type(kind: str) -> str:
    kind = kind.lower()
    if kind.startswith("array(") and kind.endswith(")"):
        return f"array<{_type(kind[6:-1])}>"
    return {"long": "bigint", "integer": "int", "string": "string"}.get(kind, kind)


def from_dtypes(df: DataFrame) -> str:
    """DDL of an existing frame."""
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON column with a run-time schema text and spread its fields."""
    return df.withColumn("_p", F.from_json(F.col(column).cast("string"), to_ddl(schema))).select("*", "_p.*").drop("_p")


def catalog_columns(df: DataFrame, catalog: str, column: str = "cells") -> DataFrame:
    """Wide rows held as ``map<family:qualifier, text>`` to typed columns, as a JSON catalog maps them:
    ``{"columns": {"name": {"cf": "family", "col": "qualifier", "type": "int"}}}``."""
    columns = json.loads(catalog)["columns"]
    return df.select(*[
        (F.col(c["col"]) if c["cf"] == "rowkey" else F.col(column)[f"{c['cf']}:{c['col']}"]).try_cast(_type(c["type"])).alias(name)
        for name, c in columns.items()])


def schema_diff(spark: SparkSession, source: T.StructType, target: T.StructType) -> DataFrame:
    """Differences by presence, position and type; no rows when an append is safe."""
    rows = []
    a, b = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(source)}, {
        f.name: (i, f.dataType.simpleString()) for i, f in enumerate(target)}
    for name in list(a) + [n for n in b if n not in a]:
        if name not in b:
            rows.append((name, "missing in target", a[name][1], None))
        elif name not in a:
            rows.append((name, "missing in source", None, b[name][1]))
        elif a[name][1] != b[name][1]:
            rows.append((name, "type", a[name][1], b[name][1]))
        elif a[name][0] != b[name][0]:
            rows.append((name, "order", str(a[name][0]), str(b[name][0])))
    return spark.createDataFrame(rows, "name string, difference string, source string, target string")


def clean_names(df: DataFrame) -> DataFrame:
    """Trim column names and put ``_`` for blanks."""
    return df.toDF(*["_".join(c.split()) for c in df.columns])
