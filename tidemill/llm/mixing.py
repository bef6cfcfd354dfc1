"""Mixing sources to target weights by hierarchical budgeting.

Weights stand on a tree (by default domain, language, source). A token budget flows down from the root: the
children of a node get shares in proportion to their weights, none more than its leaves can give
(their tokens times ``max_epochs``; leaves whose weight, or that of a node above, is 0 or null give nothing). What a child cannot take goes to its siblings first; only what all
of them together cannot take has already been given to the node's own siblings. All of this runs on
the table of leaves, in whole numbers.

A leaf spends its budget in seeded epochs: whole passes first, then the longest prefix, in a seeded order, that fits
into the rest. The prefix is found by token sums of 4096 ranges of the order; only the rows of
the one range that holds the cut are sorted, so a hot leaf is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import materialise

WHOLE = "decimal(38,0)"
RANGE_ROWS = 4096


def shares(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes`` (parent columns, child, weight, capacity, budget of the parent) with ``share``: the child's budget.

    Filled up in order of capacity per weight: a child is full if its capacity is at most its share of what is
    left. Shares are rounded down, so up to one token per child may stay unspent. Weight 0 or null gets nothing.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0)).cast("long")
    nodes = nodes.withColumn("weight", weight)
    ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight"))
    node = Window.partitionBy(*parent)
    before = node.orderBy(ratio.asc_nulls_last(), F.col(child).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.withColumns({
        "_w": F.sum("weight").over(node).cast("long"),
        "_wb": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "_cb": F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(before), F.lit(0))})
    fits = (F.col("weight") > 0) & (F.col("capacity").cast(WHOLE) * (F.col("_w") - F.col("_wb")).cast("decimal(18,0)")
                                    <= F.col("weight").cast("decimal(18,0)") * (F.col("budget") - F.col("_cb")).cast(WHOLE))
    full = sums.withColumn("_full", fits)
    taken = F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(node)
    left = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(node)
    full = full.withColumns({"_taken": taken, "_left": left})
    part = F.expr("cast(weight as decimal(18,0)) * cast(budget - _taken as decimal(38,0)) div _left")
    share = F.when(F.col("_full"), F.col("capacity")).when((F.col("weight") > 0) & (F.col("_left") > 0), part).otherwise(0)
    return full.withColumn("share", F.greatest(F.least(share.cast("long"), F.col("capacity")), F.lit(0))).drop("_w", "_wb", "_cb", "_full", "_taken", "_left")


def on_levels(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Join on ``names``, null equal to null; the columns of ``names`` appear once."""
    right = right.select(*(F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns))
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, on).drop(*(f"_r_{c}" for c in names))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: Column | int, max_epochs: int) -> DataFrame:
    """Token budget of each leaf: ``levels``, tokens, leaf_budget. ``leaves`` has the levels and their tokens."""
    top = materialise(leaves.groupBy(*levels).agg(F.sum("tokens").cast("long").alias("tokens")))
    total = top.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")).first()[0]
    budget = budget(total) if callable(budget) else budget
    open_ = F.lit(True)
    for level in levels:
        open_ = open_ & (F.coalesce(weights[level].cast("long"), F.lit(0)) > 0)
    top = materialise(top.withColumn("_usable", F.when(open_, F.col("tokens")).otherwise(0)))
    given = None
    for depth in range(len(levels)):
        path = levels[:depth + 1]
        nodes = top.groupBy(*path).agg((F.sum("_usable") * max_epochs).cast("long").alias("capacity"))
        nodes = nodes.withColumn("weight", weights[levels[depth]])
        if given is None:
            nodes = nodes.withColumns({"budget": F.lit(int(budget)).cast("long"), "_root": F.lit(0)})
            given = shares(nodes, ["_root"], levels[depth]).select(*path, "share")
        else:
            nodes = on_levels(nodes, given.withColumnRenamed("share", "budget"), levels[:depth])
            given = shares(nodes, levels[:depth], levels[depth]).select(*path, "share")
    return on_levels(top.drop("_usable"), given.withColumnRenamed("share", "leaf_budget"), levels)


def mix(docs: DataFrame, levels: list[str], weights: dict[str, Column], budget, max_epochs: int = 4, seed: int = 7,
        doc_id: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """doc_id, levels, n_tokens, epochs (how often the document is taken, at least once) of the documents taken.

    ``weights`` gives for each level a whole-number column over the path down to it. ``budget`` is a number of tokens, or a
    function of the total. Null levels are leaves of their own. A document without tokens costs nothing and is taken in every
    epoch that reaches it; a leaf without budget gives nothing. Rows that repeat an id count by themselves and, having the same place in the
    order, are taken together or, at the cut, by how many fit. An empty table gives an empty table. Only the columns named are read.
    """
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), *levels, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n_tokens")))
    leaves = materialise(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("_rows")))
    plan = materialise(budgets(leaves.drop("_rows"), levels, weights, budget, max_epochs))
    # Digits of the key that cut a leaf into ranges of about RANGE_ROWS rows, whatever its size.
    digits = F.greatest(F.ceil(F.log(16.0, F.col("_rows") / RANGE_ROWS)), F.lit(1)).cast("int")
    plan = on_levels(plan, leaves.select(*levels, digits.alias("_digits")), levels)
    plan = plan.withColumn("_whole", F.when(F.col("tokens") > 0, F.floor(F.col("leaf_budget") / F.col("tokens"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_whole", F.least("_whole", F.lit(max_epochs)))
    plan = plan.withColumn("_rest", F.when(F.col("_whole") < max_epochs, F.col("leaf_budget") - F.col("_whole") * F.col("tokens")).otherwise(0))

    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_whole").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ordered = (on_levels(rows, plan.drop("tokens"), levels).filter("leaf_budget > 0")
               .withColumn("_key", key).withColumn("_range", F.substring("_key", F.lit(1), F.col("_digits"))))
    sums = ordered.groupBy(*levels, "_range").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.partitionBy(*levels).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_tokens").over(before), F.lit(0)))
    placed = on_levels(ordered, starts, [*levels, "_range"])
    whole = placed.filter("_start + _tokens <= _rest").withColumn("_in", F.lit(1))
    beyond = placed.filter("_start > _rest").withColumn("_in", F.lit(0))
    cut = placed.filter("_start <= _rest and _start + _tokens > _rest")
    running = Window.partitionBy(*levels).orderBy("_key", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("_in", F.when(F.col("_start") + F.sum("n_tokens").over(running) <= F.col("_rest"), 1).otherwise(0))
    taken = whole.unionByName(beyond).unionByName(cut)
    return taken.withColumn("epochs", (F.col("_whole") + F.col("_in")).cast("long")).filter("epochs > 0").select("doc_id", *levels, "n_tokens", "epochs")
