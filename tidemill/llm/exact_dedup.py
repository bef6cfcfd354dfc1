"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so: after the first sentence mark or line end that follows
512 characters, at 4096 at the latest. Each distinct chunk moves once, to be verified: identifiers
are two 64-bit hashes, and where two different chunks share them the identifiers are SHA-256 instead. A
document is then its ordered list of identifiers, and only these lists meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.tables import without
from tidemill.llm.text import lowered
from tidemill.session import materialise

CHUNK = r"(?s).{512,4095}?[.!?\n]|.{1,4096}"


def short_id(chunk: Column) -> Column:
    return F.concat(F.hex(F.xxhash64(chunk)), F.lit("."), F.hex(F.xxhash64(F.lit(7), chunk)))


def long_id(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(CHUNK), F.lit(0))


def text_sha256(text: Column) -> Column:
    return F.sha2(lowered(text).cast("binary"), 256)


def verified(chunk: DataFrame, identifier=short_id) -> bool:
    """Whether no two different values of the one column of ``chunk`` share an identifier."""
    name = chunk.columns[0]
    shared = chunk.distinct().groupBy(identifier(F.col(name)).alias("id")).count().filter("count > 1")
    return shared.limit(1).count() == 0


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, recipe (ordered identifiers), text_sha256 of each row; written once to the shared folder."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    identifier = short_id if verified(docs.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))) else long_id
    return materialise(docs.select(
        "doc_id", F.transform(chunks_of(F.col("text")), identifier).alias("recipe"),
        text_sha256(F.col("text")).alias("text_sha256")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lowering A-Z; null counts as empty, and empty texts form one group.
    Of equal texts the largest doc_id stays. A row repeated with its id keeps its fate (kept where the id is);
    ids that are null are never kept before others; a group of null ids alone keeps them. An empty table gives an empty table;
    other columns are not read.
    """
    rows = recipes(docs, doc_id, text)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text stays, all columns; of rows that repeat an id and a text one stays."""
    decided = exact_dedup(docs, doc_id, text).select("doc_id", F.col("text_sha256").alias("sign"), "kept")
    rows = without(docs, decided, doc_id, text_sha256(F.col(text)))
    repeated = docs.groupBy(doc_id).count().filter("count > 1").limit(1).count() > 0
    return rows.dropDuplicates([doc_id, text]) if repeated else rows
