"""Batch functions for ``foreachBatch`` that keep tables between batches and survive a replay.

What a batch writes lies in a partition named after its id, so running the batch again writes the
same partition again. A state table also tells apart the queries that wrote it, as a query started
with a new checkpoint counts its batches from 0 again: ``run=<number>-<query id>/batch_id=<id>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import holding
from tidemill.operators.ordered import same_keys
from tidemill.session import file_status, materialise, subfolders
from tidemill.sources import redo
from tidemill.sources.writers import files_of, replace_partitions
from tidemill.streaming.sinks import into_batch_partition


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path`` with the columns of ``like``, empty when there is no such path. A table that lacks a column raises."""
    return like.where("false") if file_status(spark, path) is None else spark.read.parquet(path).select(*like.columns)


def run_name(spark: SparkSession, path: str) -> str:
    """Name of the running query among those that wrote the state table: its place in time and its id, which a restart
    from the same checkpoint keeps. Batch functions called without a query share one name."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    runs = [n.removeprefix("run=") for n in subfolders(spark, path) if n.startswith("run=")]
    own = [n for n in runs if n.partition("-")[2] == query]
    return own[0] if own else f"{max((int(n.partition('-')[0]) for n in runs), default=0) + 1:06d}-{query}"


def _state(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.parquet(folder).select(*like.columns).dropna("all")


def _last_of(spark: SparkSession, path: str, runs: list[str], like: DataFrame) -> DataFrame:
    """State of the last batch of the last of these runs that finished one."""
    for run in reversed(runs):
        ids = [int(n.removeprefix("batch_id=")) for n in subfolders(spark, f"{path}/{run}") if n.startswith("batch_id=")]
        if ids:
            return _state(spark, f"{path}/{run}/batch_id={max(ids)}", like)
    return like.where("false")


def before_batch(spark: SparkSession, path: str, like: DataFrame, batch_id: int) -> DataFrame:
    """State the previous batch wrote. Batch ids are consecutive and every batch writes its partition, so one
    partition is read, however long the table has grown; if it is gone, reading raises. The first batch of a
    query goes on from the last batch of the query before it."""
    run = f"run={run_name(spark, path)}"
    if batch_id:
        return _state(spark, f"{path}/{run}/batch_id={batch_id - 1}", like)
    return _last_of(spark, path, [n for n in subfolders(spark, path) if n.startswith("run=") and n < run], like)


def current_state(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """State of the newest batch, for readers of the table."""
    return _last_of(spark, path, [n for n in subfolders(spark, path) if n.startswith("run=")], like)


def write_state(state: DataFrame, path: str, batch_id: int) -> None:
    """Write the state after a batch. A state without rows still needs its partition, or the next batch would find
    none; a row of nulls marks it and is dropped on reading."""
    spark = state.sparkSession
    marker = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema])
    folder = f"{path}/run={run_name(spark, path)}/batch_id={batch_id}"
    state.unionByName(marker).write.mode("overwrite").parquet(folder)


def _fixed_inputs(spark: SparkSession, folder: str, rows: DataFrame, parents: Callable, now: Callable[[], Column]) -> tuple[list, Column]:
    """What a batch reads besides its rows, read once: the parent keys its rows ask for and the time. A replay finds them where the first run wrote them;
    the time is written last, so inputs that were cut off are read anew, before anything was made from them."""
    if file_status(spark, f"{folder}/clock/_SUCCESS") is None:
        for i, (parent, keys) in enumerate(parents(spark)):
            parent.select(*keys).distinct().join(rows.select(*keys), keys, "left_semi").write.mode("overwrite").parquet(f"{folder}/parents-{i}")
        spark.range(1).select(F.unix_micros(now()).alias("now")).write.mode("overwrite").parquet(f"{folder}/clock")
    fixed = [(spark.read.schema(parent.select(*keys).schema).parquet(f"{folder}/parents-{i}"), keys) for i, (parent, keys) in enumerate(parents(spark))]
    return fixed, F.timestamp_micros(F.lit(spark.read.parquet(f"{folder}/clock").first()["now"]))


def hold_and_release(released: str, held: str, parents: Callable[[SparkSession], list[tuple[DataFrame, list[str]]]],
                     identity: list[str], ts: str, now: Callable[[], Column], expiry: str) -> Callable:
    """Keep unresolved rows in the ``held`` table and write resolved ones to ``released``; the held
    state of a batch is written last. Released rows carry ``run`` and ``batch_id``. The time and the parent keys of a batch are stored with the state, so
    a replay releases the same rows whatever the clock says and whichever parents have come since."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        run = run_name(spark, held)
        waiting = before_batch(spark, held, batch, batch_id)
        known, at = _fixed_inputs(spark, f"{held}/_inputs/{run}/{batch_id}", waiting.unionByName(batch), parents, now)
        step = holding.resolve(waiting, batch, known, identity, ts, at, expiry)
        out = step.released.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id)})
        replace_partitions(out, released, ["run", "batch_id"])
        write_state(step.held, held, batch_id)
        redo.delete_folder(spark, f"{held}/_inputs/{run}/{batch_id - 1}")
        batch.unpersist()
    return write


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``key``, a null key with a null key; the right side's key is ``_key``."""
    right = right.withColumnRenamed("key", "_key")
    return left.join(right, left["key"].eqNullSafe(right["_key"]), how)


def _drop_state(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete the state of a batch that no replay reads any more."""
    redo.delete_folder(spark, f"{path}/run={run_name(spark, path)}/batch_id={batch_id}")


def hold_first(released: str, held: str) -> Callable:
    """``state.hold_first`` without a timeout for any number of keys: (key, message) rows of a batch are counted per key and joined to the ``held`` table, which has
    one row per key, so the work is a few shuffles whatever the number of keys. The state is written before what it lets pass; a replay begins at the
    state before and writes both again. Released rows carry ``run`` and ``batch_id``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("key", "message").persist()
        like = batch.select("key", F.col("message").alias("held"), F.lit(True).alias("passing"))
        waiting = before_batch(spark, held, like, batch_id)
        news = batch.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("message").alias("_one"))
        known = F.col("passing").isNotNull()
        passes = F.coalesce("passing", F.lit(False)) | (F.coalesce("_n", F.lit(0)) + known.cast("long") > 1)
        after = _null_safe(news, waiting, "full").select(
            F.when(known, F.col("_key")).otherwise(F.col("key")).alias("key"),
            F.when(~passes, F.when(known, F.col("held")).otherwise(F.col("_one"))).alias("held"), passes.alias("passing"))
        write_state(after, held, batch_id)
        run = run_name(spark, held)
        open_keys = _state(spark, f"{held}/run={run}/batch_id={batch_id}", like).where("passing").select("key")
        first = waiting.where("not passing").select("key", F.col("held").alias("message"))
        out = _null_safe(batch.unionByName(first), open_keys, "left_semi")
        replace_partitions(out.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id)}), released, ["run", "batch_id"])
        _drop_state(spark, held, batch_id - 2)
        batch.unpersist()
    return write


def release_with_parent(released: str, held: str, parents: Callable[[SparkSession], DataFrame] | None, expiry_ms: int, delay_ms: int = 0,
                        order: tuple[str, ...] = ("ts",)) -> Callable:
    """``state.release_with_parent`` for any number of keys: a batch of (key, kind, ts, message) rows is reduced to its latest parent and child per key and joined to the
    ``held`` table. The latest is the greatest by ``order``, which begins with ``ts``, then by message. Rows expire by the newest time of the batches before, less
    ``delay_ms``; a late row counts as long as it has not expired. Released rows carry ``run`` and ``batch_id``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = before_batch(spark, f"{held}/_clock", batch.select(F.unix_millis("ts").alias("newest")), batch_id)
        newest = clock.agg(F.max("newest")).first()[0]
        now = 0 if newest is None else max(0, newest - delay_ms)

        def live(at):
            return F.unix_micros(at) + expiry_ms * 1000 > now * 1000

        row = F.struct(*order, "message")
        waiting = before_batch(spark, held, batch.select("key", F.col("ts").alias("parent_at"), row.alias("child")), batch_id)
        news = batch.groupBy("key").agg(*[F.max(F.when((F.col("kind") == kind) & live("ts"), row)).alias(f"_{kind}") for kind in ("parent", "child")],
                                        F.max("ts").alias("_newest"), F.lit(True).alias("_news"))
        if parents is None:
            news = news.withColumn("_known", F.lit(False))
        else:
            news = news.join(parents(spark).select("key").distinct().withColumn("_known", F.lit(True)), "key", "left")
        parent_at, child = F.greatest("_parent.ts", "parent_at"), F.greatest("_child", F.when(live("child.ts"), F.col("child")))
        step = _null_safe(news, waiting, "full").select(
            F.when(F.col("_news"), F.col("key")).otherwise(F.col("_key")).alias("key"), "_parent", "_newest", F.when(live(parent_at), parent_at).alias("parent_at"),
            child.alias("child"), F.coalesce("_known", F.lit(False)).alias("_known"), F.coalesce("_news", F.lit(False)).alias("_news"))
        step = step.withColumn("_out", F.col("_news") & F.col("child").isNotNull() & (F.col("_known") | F.col("parent_at").isNotNull())).persist()
        rows = F.array(*[F.when(there, F.struct(F.lit(kind).alias("kind"), F.col(column)["ts"].alias("ts"), F.col(column)["message"].alias("message")))
                         for kind, column, there in (("parent", "_parent", F.col("_parent").isNotNull()), ("child", "child", F.col("_out")))])
        run = run_name(spark, held)
        out = step.select("key", F.explode(F.array_compact(rows)).alias("_row")).select("key", "_row.*", F.lit(run).alias("run"), F.lit(batch_id).alias("batch_id"))
        replace_partitions(out, released, ["run", "batch_id"])
        write_state(step.agg(F.greatest(F.unix_millis(F.max("_newest")), F.lit(newest).cast("long")).alias("newest")), f"{held}/_clock", batch_id)
        stays = step.select("key", "parent_at", F.when(~F.col("_out"), F.col("child")).alias("child"))
        write_state(stays.where("parent_at is not null or child is not null"), held, batch_id)
        _drop_state(spark, held, batch_id - 2)
        _drop_state(spark, f"{held}/_clock", batch_id - 2)
        step.unpersist()
    return write


def count_into(path: str, keys: list[str], total: str = "hits") -> Callable:
    """Counters as one partition of partial counts per batch; ``counter_totals`` adds them up."""
    def write(batch: DataFrame, batch_id: int) -> None:
        into_batch_partition(path)(batch.groupBy(*keys).agg(F.count(F.lit(1)).alias(total)), batch_id)
    return write


def counter_totals(spark: SparkSession, path: str, keys: list[str], total: str = "hits") -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum(total).alias(total))


def merge_into_versions(path: str, apply: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame) -> Callable:
    """Keep a table as one state per batch: ``apply(stored, batch)`` gives the next state. Of a big table that a batch
    changes in few places, merge into the touched partitions instead: ``writers.merge_into_path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        stored = before_batch(batch.sparkSession, path, empty, batch_id)
        write_state(apply(stored, batch), path, batch_id)
    return write


def drop_old_states(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Delete all but the newest ``keep`` batches of every run of a state table."""
    for run in subfolders(spark, path):
        batches = sorted((n for n in subfolders(spark, f"{path}/{run}") if n.startswith("batch_id=")), key=lambda n: int(n.partition("=")[2]))
        for name in batches[:-keep]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{run}/{name}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def recompute_affected(source: Callable[[SparkSession], DataFrame], keys: list[str],
                       compute: Callable[[DataFrame], DataFrame], path: str) -> Callable:
    """Triggered job: recompute only the key values named in the trigger batch and replace their partitions. The
    partition of a named value for which nothing is computed any more is deleted. A table that is there changes through a redo record."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, named = batch.sparkSession, batch.select(*keys).distinct()
        computed = compute(source(spark).join(named, keys, "left_semi"))
        if file_status(spark, path) is None:
            replace_partitions(computed, path, keys)
            return
        name = redo.begin(spark, path, None)
        computed = materialise(computed)
        gone = named.unionByName(computed.select(*keys)).select(*[F.col(k).alias("_t_" + k) for k in keys]).distinct()
        stored = spark.read.parquet(path).select(*keys, "_metadata").join(gone, same_keys(keys, "_t_"), "left_semi")
        redo.change(spark, path, name, computed, files_of(stored), keys)
    return write


def append_with_own_schema(path: str, writer: str) -> Callable:
    """Two writers with different columns may append to one table; read it with ``mergeSchema``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id)}), path, ["writer", "batch_id"])
    return write
