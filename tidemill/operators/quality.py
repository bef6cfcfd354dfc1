"""Column metrics, constraint checks, layer reconciliation and audit queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(row: DataFrame, names: list[tuple]) -> DataFrame:
    """One wide row of values to (entity, instance, name, value) rows."""
    entries = [F.struct(F.lit(e).alias("entity"), F.lit(i).alias("instance"), F.lit(n).alias("name"),
                        F.col(f"`{c}`").cast("double").alias("value")) for c, e, i, n in names]
    return row.select(F.inline(F.array(*entries)))


def metrics(df: DataFrame, complete: list[str] = (), distinct: list[str] = (), mean: list[str] = (),
            compliance: dict[str, Column] | None = None, correlation: list[tuple[str, str]] = ()) -> DataFrame:
    """Size, completeness, approximate distinct, mean, compliance and correlation in one aggregation."""
    aggs, names = [F.count(F.lit(1)).alias("size")], [("size", "Dataset", "*", "Size")]

    def add(value, entity, instance, name):
        key = f"m{len(aggs)}"
        aggs.append(value.alias(key))
        names.append((key, entity, instance, name))

    for c in complete:
        add(F.count(c) / F.count(F.lit(1)), "Column", c, "Completeness")
    for c in distinct:
        add(F.approx_count_distinct(c), "Column", c, "ApproxCountDistinct")
    for c in mean:
        add(F.avg(c), "Column", c, "Mean")
    for label, predicate in (compliance or {}).items():
        add(F.count_if(predicate) / F.count(F.lit(1)), "Column", label, "Compliance")
    for a, b in correlation:
        add(F.corr(a, b), "Multicolumn", f"{a},{b}", "Correlation")
    return _long(df.agg(*aggs), names)


def checks(df: DataFrame, constraints: dict[str, Column], unique: list[str] = ()) -> DataFrame:
    """One row per constraint with its status. A constraint is an aggregate yielding a boolean;
    uniqueness is checked through per-value counts, so a repeated value never gathers in one task."""
    names = list(constraints)
    row = df.agg(*[constraints[n].alias(f"c{i}") for i, n in enumerate(names)])
    entries = [F.struct(F.lit(n).alias("constraint_name"), F.coalesce(F.col(f"c{i}"), F.lit(False)).alias("_ok"))
               for i, n in enumerate(names)]
    out = row.select(F.inline(F.array(*entries)))
    for c in unique:
        repeated = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("_r"))
        out = out.unionByName(repeated.select(F.lit(f"unique {c}").alias("constraint_name"), (F.col("_r") == 0).alias("_ok")))
    return out.select("constraint_name", F.when(F.col("_ok"), "Success").otherwise("Failure").alias("status"))


def layer_counts(upper: DataFrame, lower: DataFrame, day: str) -> DataFrame:
    """Rows per day in two layers, their difference, and the change against the day before."""
    a = upper.groupBy(day).agg(F.count(F.lit(1)).alias("upper_rows"))
    b = lower.groupBy(day).agg(F.count(F.lit(1)).alias("lower_rows"))
    both = a.join(b, day, "full").na.fill(0, ["upper_rows", "lower_rows"])
    # one row per day: the previous day is found by an equal join, not by an ordered scan
    before = both.select(F.date_add(day, 1).alias(day), F.col("upper_rows").alias("_before"))
    both = both.join(before, day, "left").withColumn("diff", F.col("upper_rows") - F.col("lower_rows"))
    return both.withColumn("diff_to_day_before", F.col("upper_rows") - F.coalesce("_before", F.lit(0))).drop("_before")


def reload_days(stats: DataFrame, run: str, day: str, mode: str = "fix", today: str | None = None) -> DataFrame:
    """Days whose layers differ in the newest statistics run; ``daily`` looks at one day only."""
    last = stats.agg(F.max(run).alias(run))
    rows = stats.join(F.broadcast(last), run, "left_semi").where("diff <> 0")
    return rows.where(F.col(day) == today).select(day) if mode == "daily" else rows.select(day)


def last_status(audit: DataFrame, run: str, step: str, status: str, time: str) -> DataFrame:
    """Newest status of every step of every run."""
    return audit.groupBy(run, step).agg(F.max_by(status, time).alias(status), F.max(time).alias(time))


def restart_point(audit: DataFrame, steps: list[str], run: str, step: str, status: str, time: str) -> DataFrame:
    """First of the ordered ``steps`` of each run whose newest status is not ``success``."""
    last = last_status(audit, run, step, status, time)
    done = last.where(F.col(status) == "success").groupBy(run).agg(F.collect_set(step).alias("_done"))
    state = audit.select(run).distinct().join(done, run, "left")
    todo = F.filter(F.array(*[F.lit(s) for s in steps]),
                    lambda s: ~F.array_contains(F.coalesce("_done", F.array().cast("array<string>")), s))
    return state.withColumn("restart_at", F.get(todo, F.lit(0))).where("restart_at is not null").drop("_done")
