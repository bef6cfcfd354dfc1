"""Ordered computations per group that stay balanced when one group holds most of the rows.

A window ``partitionBy(key)`` sends a whole group to one task. ``OrderedGroups`` counts the
biggest group first. If a task can sort it, the plain window is used: one hash shuffle. If not,
rows are range-partitioned by (keys, order), the window runs inside each (chunk, group) piece, and
what earlier chunks contribute is added from a broadcast table. Only groups that span chunks need
such a row, and a chunk holds at most two of them (its first and its last group), so that table
has at most two rows per chunk.

Orders are column names; a leading ``-`` means descending. They must be total per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tidemill.session import MAX_GROUP_ROWS, MAX_TABLE_ROWS, group_sizes, materialise, setting, shuffle_partitions, spread

CHUNK = "_chunk"
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def ordering(order: list[str], backwards: bool = False) -> list[Column]:
    cols = []
    for name in order:
        down = name.startswith("-")
        col = F.col(name.lstrip("-"))
        cols.append(col.desc() if down != backwards else col.asc())
    return cols


def same_keys(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of each key with its prefixed twin."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys], F.lit(True))


def group_limit(spark: SparkSession, keys: list[str]) -> int:
    """Rows of a group that one task may sort. Without keys that task would be the only one at work, so far fewer."""
    if not keys:
        return setting(spark, "maxTableRows", MAX_TABLE_ROWS)
    return setting(spark, "maxGroupRows", MAX_GROUP_ROWS)


def fits_one_task(df: DataFrame, keys: list[str], limit: int, bound_by: DataFrame | None = None) -> bool:
    """Whether every group has at most ``limit`` rows. ``bound_by`` is a frame that is cheaper to
    count and has at least as many rows per key, such as the scan an aggregate was made from; only
    when it is over the limit is ``df`` itself counted."""
    return bounded_sizes(df, keys, limit, bound_by)[0] <= limit


def bounded_sizes(df: DataFrame, keys: list[str], limit: int, bound_by: DataFrame | None = None) -> tuple[int, int]:
    """At most how many rows the biggest group and all of ``df`` have, by ``bound_by`` if that is within the limit."""
    if bound_by is not None:
        sizes = group_sizes(bound_by, keys)
        if sizes[0] <= limit:
            return sizes
    return group_sizes(df, keys)


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order``; methods add one column each.

    The rows are counted before they are used: pass ``bound_by``, or write an expensive small frame
    out with ``materialise`` first, to not compute it twice."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], max_group_rows: int | None = None,
                 chunks: int | None = None, bound_by: DataFrame | None = None, fits: bool | None = None):
        spark = df.sparkSession
        self.keys, self.order = list(keys), list(order)
        self.limit = max_group_rows or group_limit(spark, self.keys)
        largest, rows = bounded_sizes(df, self.keys, self.limit, bound_by) if fits is None else (0 if fits else self.limit + 1, 0)
        self.split = largest > self.limit
        if not self.split and self.keys:
            df = spread(df, self.keys, rows)
        elif self.split:
            n = chunks or shuffle_partitions(spark)
            # rows with equal order are told apart by a hash of their values, so they can be cut as well
            plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
            ranged = df.repartitionByRange(n, *[F.col(k) for k in self.keys], *ordering(self.order), F.xxhash64(*plain))
            df = materialise(ranged.withColumn(CHUNK, F.spark_partition_id()))
        self.df = df

    # -- plumbing ---------------------------------------------------------------------------

    def _next(self, df: DataFrame) -> "OrderedGroups":
        twin = object.__new__(OrderedGroups)
        twin.__dict__.update(self.__dict__)
        twin.df = df
        return twin

    def _window(self, backwards: bool = False) -> WindowSpec:
        part = ([CHUNK] if self.split else []) + self.keys
        return Window.partitionBy(*part).orderBy(*ordering(self.order, backwards))

    def _spanning(self, per_chunk: DataFrame) -> DataFrame:
        """Pieces of the groups that lie in more than one chunk."""
        pieces = Window.partitionBy(*self.keys)
        return per_chunk.withColumn("_pieces", F.count(F.lit(1)).over(pieces)).where("_pieces > 1")

    def _add_carry(self, df: DataFrame, carry: DataFrame, columns: list[str]) -> DataFrame:
        """Join the at most two carry rows per chunk back to the rows. They are written out first, so
        that a chain of steps does not read its own beginnings again and again."""
        small = materialise(carry.select(F.col(CHUNK).alias("_c_chunk"),
                                         *[F.col(k).alias("_c_" + k) for k in self.keys], *columns))
        on = (F.col(CHUNK) == F.col("_c_chunk")) & same_keys(self.keys, "_c_")
        return df.join(F.broadcast(small), on, "left").drop("_c_chunk", *["_c_" + k for k in self.keys])

    def _running(self, name: str, local: Column, inclusive: Column, merge_chunks, combine) -> "OrderedGroups":
        """``inclusive`` on a piece's last row is what the piece hands on to later pieces."""
        if not self.split:
            return self._next(self.df.withColumn(name, combine(local, None)))
        df = (self.df.withColumn("_local", local).withColumn("_handed", inclusive)
              .withColumn("_more", F.lead(F.lit(1)).over(self._window())))
        closing = df.where(F.col("_more").isNull()).select(CHUNK, *self.keys, "_handed")
        earlier = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(*_BEFORE)
        carry = self._spanning(closing).withColumn("_carry", merge_chunks(F.col("_handed"), earlier))
        df = self._add_carry(df, carry, ["_carry"])
        df = df.withColumn(name, combine(F.col("_local"), F.col("_carry")))
        return self._next(df.drop("_local", "_handed", "_more", "_carry"))

    # -- running values ---------------------------------------------------------------------

    def running_sum(self, name: str, value: Column | str, exclusive: bool = False) -> "OrderedGroups":
        """Running total, 0 before the first value."""
        value = F.col(value) if isinstance(value, str) else value
        w = self._window()
        zero = F.lit(0)

        def combine(local, carry):
            local = F.coalesce(local, zero)
            return local if carry is None else local + F.coalesce(carry, zero)

        upto = F.sum(value).over(w.rowsBetween(*_UPTO))
        local = F.sum(value).over(w.rowsBetween(*_BEFORE)) if exclusive else upto
        return self._running(name, local, upto, lambda c, e: F.sum(c).over(e), combine)

    def _extreme(self, name, value, exclusive, agg, pick) -> "OrderedGroups":
        value = F.col(value) if isinstance(value, str) else value
        w = self._window()
        upto = agg(value).over(w.rowsBetween(*_UPTO))
        local = agg(value).over(w.rowsBetween(*_BEFORE)) if exclusive else upto
        return self._running(name, local, upto, lambda c, e: agg(c).over(e),
                             lambda local, carry: local if carry is None else pick(local, carry))

    def running_max(self, name, value, exclusive=False):
        return self._extreme(name, value, exclusive, F.max, F.greatest)

    def running_min(self, name, value, exclusive=False):
        return self._extreme(name, value, exclusive, F.min, F.least)

    def row_number(self, name: str) -> "OrderedGroups":
        return self.running_sum(name, F.lit(1))

    def fill_forward(self, name: str, value: Column | str) -> "OrderedGroups":
        """Last non-null value up to and including the row."""
        value = F.col(value) if isinstance(value, str) else value
        upto = F.last(value, True).over(self._window().rowsBetween(*_UPTO))
        return self._running(name, upto, upto, lambda c, e: F.last(c, True).over(e),
                             lambda local, carry: local if carry is None else F.coalesce(local, carry))

    # -- neighbours -------------------------------------------------------------------------

    def lag(self, name, value, offset=1, default=None):
        return self._shift(name, value, offset, default, backwards=False)

    def lead(self, name, value, offset=1, default=None):
        return self._shift(name, value, offset, default, backwards=True)

    def _shift(self, name, value, offset, default, backwards) -> "OrderedGroups":
        value = F.col(value) if isinstance(value, str) else value
        default = F.lit(default)
        if not self.split:
            w, shift = self._window(), F.lead if backwards else F.lag  # one sort serves both directions
            present = shift(F.lit(1), offset).over(w)
            return self._next(self.df.withColumn(
                name, F.when(present.isNotNull(), shift(value, offset).over(w)).otherwise(default)))
        w = self._window(backwards)
        df = (self.df.withColumn("_pos", F.row_number().over(w))
              .withColumn("_rest", F.row_number().over(self._window(not backwards)))
              .withColumn("_inside", F.lag(value, offset).over(w))
              .withColumn("_value", value))
        # the last `offset` values of each piece, oldest first
        tails = (df.where(F.col("_rest") <= offset).groupBy(CHUNK, *self.keys)
                 .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rest")).alias("o"),
                                                           F.col("_value").alias("v")))).alias("_tail")))
        order = F.col(CHUNK).desc() if backwards else F.col(CHUNK).asc()
        earlier = Window.partitionBy(*self.keys).orderBy(order).rowsBetween(*_BEFORE)
        carry = self._spanning(tails).withColumn("_carry", F.flatten(F.collect_list("_tail").over(earlier)))
        carry = carry.withColumn("_carry", F.expr(f"slice(_carry, greatest(size(_carry) - {offset - 1}, 1), {offset})"))
        df = self._add_carry(df, carry, ["_carry"])
        back = F.lit(offset) - F.col("_pos") + 1  # how far from the end of the carried values
        carried = F.when(F.size("_carry") >= back,
                         F.try_element_at("_carry", F.size("_carry") - back + 1)["v"]).otherwise(default)
        df = df.withColumn(name, F.when(F.col("_pos") > offset, F.col("_inside")).otherwise(carried))
        return self._next(df.drop("_pos", "_rest", "_inside", "_value", "_carry"))

    # -- sliding row frames -----------------------------------------------------------------

    def sliding(self, columns: dict, preceding: int, following: int = 0) -> "OrderedGroups":
        """Aggregates over a fixed number of rows around each row, e.g. ``{"avg7": F.avg("x")}``."""
        if not self.split:
            w = self._window().rowsBetween(-preceding, following)
            return self._next(self.df.withColumns({n: a.over(w) for n, a in columns.items()}))
        # number the rows, cut them into equal blocks and copy the edge rows to the neighbour block
        rows = max(self.limit, preceding + following + 1)
        df = self.row_number("_row").df
        df = df.withColumn("_at", (F.col("_row") - 1) % rows).withColumn(
            "_block", F.floor((F.col("_row") - 1) / rows))
        targets = F.array(F.col("_block"),
                          F.when(F.col("_at") >= rows - preceding, F.col("_block") + 1),
                          F.when(F.col("_at") < following, F.col("_block") - 1))
        df = df.withColumn("_target", F.explode(F.array_compact(targets)))
        w = Window.partitionBy("_target", *self.keys).orderBy("_row").rowsBetween(-preceding, following)
        df = df.withColumns({n: a.over(w) for n, a in columns.items()})
        df = df.where(F.col("_target") == F.col("_block"))
        return self._next(df.drop("_row", "_at", "_block", "_target"))

    @property
    def frame(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.split else self.df


def beside(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Group aggregates next to each row. Aggregated map-side and joined back, so a hot group is
    never gathered; the join is broadcast by size or split by the adaptive skew join."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    totals = totals.select(*[F.col(k).alias("_t_" + k) for k in keys], *aggs)
    return df.join(totals, same_keys(keys, "_t_"), "left").drop(*["_t_" + k for k in keys])


def ranks(df: DataFrame, keys: list[str], order: list[str], rank: str | None = None,
          dense_rank: str | None = None, percent_rank: str | None = None,
          cume_dist: str | None = None, max_group_rows: int | None = None) -> DataFrame:
    """Rank columns per group (or over the whole table when ``keys`` is empty).

    Ranks depend only on how often each order value occurs. Groups too big for one task are
    therefore counted per value first and only these counts are accumulated in order."""
    limit = max_group_rows or group_limit(df.sparkSession, keys)
    wanted = {n: k for n, k in ((rank, "rank"), (dense_rank, "dense"), (percent_rank, "percent"),
                                (cume_dist, "cume")) if n}
    if fits_one_task(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*ordering(order))
        native = {"rank": F.rank, "dense": F.dense_rank, "percent": F.percent_rank, "cume": F.cume_dist}
        return df.withColumns({n: native[k]().over(w) for n, k in wanted.items()})
    columns = [o.lstrip("-") for o in order]
    counts = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n"))
    steps = (OrderedGroups(counts, keys, order, max_group_rows=limit)
             .row_number("_dense").running_sum("_upto", "_n").frame)
    if percent_rank or cume_dist:
        totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
        totals = totals.select(*[F.col(k).alias("_g_" + k) for k in keys], "_total")
        steps = steps.join(totals, same_keys(keys, "_g_"), "left").drop(*["_g_" + k for k in keys])
    first = F.col("_upto") - F.col("_n")
    forms = {"rank": lambda: (first + 1).cast("int"),
             "dense": lambda: F.col("_dense").cast("int"),
             "percent": lambda: F.when(F.col("_total") > 1, first / (F.col("_total") - 1)).otherwise(0.0),
             "cume": lambda: F.col("_upto") / F.col("_total")}
    steps = steps.select(*[F.col(c).alias("_s_" + c) for c in keys + columns],
                         *[forms[k]().alias(n) for n, k in wanted.items()])
    return df.join(steps, same_keys(keys + columns, "_s_"), "left").drop(
        *["_s_" + c for c in keys + columns])


def top_n(df: DataFrame, keys: list[str], order: list[str], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group. Up to a thousand, Spark limits each map task to ``n`` rows per group before
    the shuffle, so a group's size does not matter; beyond, big groups are numbered in pieces."""
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        numbered = OrderedGroups(df, keys, order).row_number(name).frame
        return numbered.withColumn(name, F.col(name).cast("int")).where(F.col(name) <= n)
    w = Window.partitionBy(*keys).orderBy(*ordering(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def nth_distinct(df: DataFrame, keys: list[str], value: str, n: int, descending: bool = True) -> DataFrame:
    """Rows holding the n-th distinct value of their group; values are deduplicated map-side first."""
    distinct = df.select(*keys, value).distinct()
    nth = top_n(distinct, keys, [("-" if descending else "") + value], n, "_r").where(F.col("_r") == n)
    nth = nth.select(*[F.col(c).alias("_v_" + c) for c in keys + [value]])
    return df.join(nth, same_keys(keys + [value], "_v_"), "left_semi")


def latest(df: DataFrame, keys: list[str], order: list[str], newest: bool = True) -> DataFrame:
    """One row per key, the greatest (or least) by ``order``: a map-side combined ``max_by``."""
    pick = F.max_by if newest else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")
