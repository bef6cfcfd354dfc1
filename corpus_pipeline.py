"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage keeps the columns of its input, but the last, which returns the mix (doc_id, domain, lang, source, n_tokens, epochs). Labels are
learned from all labelled rows that are not held out for the query ``op10_quality``. The stages lower the session's Arrow batch size, as
all of them run in the same Python workers and whole documents pass through each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, exact_dedup, near_dedup, quality, queries, text
from tidemill.llm.tables import small_batches
from tidemill.session import shared_folder, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels").filter(text.fold(F.col("doc_id"), 3) != 1))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts: the one with the largest id."""
    return exact_dedup.keep_distinct(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    small_batches(spark)
    return near_dedup.keep_one_each(docs, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken to reach the target weights, with the number of epochs of each."""
    return queries.mixed(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("decontamination", clean), ("mixing", mixed)]

# A trained classifier and similarity search are not to be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them stay in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
