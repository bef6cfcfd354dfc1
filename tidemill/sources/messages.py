"""Parsing of message payloads: envelopes, two-layer JSON, delimited text and the order grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("timestampType", T.IntegerType()),
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])))])
OUTER = "messageType string, messageTimestamp timestamp, incomingMessage string"


def two_layer(df: DataFrame, inner: str, message_type: str | None = None, column: str = "value",
              outer: str = OUTER) -> DataFrame:
    """Outer JSON whose payload field is itself JSON; optionally one message type only."""
    parsed = df.withColumn("_outer", F.from_json(F.col(column).cast("string"), outer)).select("*", "_outer.*").drop("_outer")
    if message_type is not None:
        parsed = parsed.where(F.col("messageType") == message_type)
    return parsed.withColumn("payload", F.from_json("incomingMessage", inner)).drop("incomingMessage")


def positional(df: DataFrame, column: str, fields: list[tuple[str, str]], sep: str = "~") -> DataFrame:
    """Delimited text to typed columns; a value that does not fit its type is null."""
    parts = F.split(F.col(column).cast("string"), sep)
    return df.select("*", *[F.get(parts, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def as_json_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as ``(key, value)`` messages with the row as JSON."""
    body = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), body) if key else df.select(body)


def with_header(df: DataFrame, keys: list[str]) -> DataFrame:
    """Messages that carry at least one of the header keys."""
    return df.where(F.exists("headers", lambda h: h["key"].isin(keys)))


def header_map(column: str = "headers") -> Column:
    """Headers as a map of text values; the last one of a repeated key counts."""
    entries = F.transform(column, lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return last


def order_items(df: DataFrame, column: str) -> DataFrame:
    """``VERB||k::v+k::v+orderItems::(a~b~..),(..)`` to one row per item. An INS item is
    id, qty, rebated Y/N, code, rebate, price; an UPD item is id, qty, price, code or NA, rebate."""
    halves = F.split(column, r"\|\|")
    rows = df.select(halves[0].alias("verb"), F.str_to_map(halves[1], F.lit(r"\+"), F.lit("::")).alias("m"))
    items = F.split(F.regexp_replace(F.col("m")["orderItems"], r"^[\(\[,]+|[\)\],]+$", ""), r"\),\(")
    head = [F.col("m")[k].alias(k) for k in ("orderId", "sessionID", "userId", "accountID", "Address")]
    rows = rows.select("verb", *head, F.explode(F.transform(items, lambda i: F.split(i, "~"))).alias("p"))
    ins = F.col("verb") == "INS"

    def number(i):
        return F.get("p", F.lit(i)).try_cast("int")

    code = F.when(ins & (F.col("p")[2] == "Y"), F.get("p", F.lit(3))).when(~ins, F.nullif(F.get("p", F.lit(3)), F.lit("NA")))
    return rows.select("verb", "orderId", "sessionID", "userId", "accountID", "Address", F.col("p")[0].alias("item_id"),
                       number(1).alias("qty"), F.when(ins, number(5)).otherwise(number(2)).alias("price"),
                       code.alias("discount_code"), F.when(code.isNotNull(), number(4)).alias("discount"))
