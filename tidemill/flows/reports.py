"""Survey counts and the commerce report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import spread

# Month names used as report columns.
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER",
          "NOVEMBER", "DECEMBER"]


def yes_no_counts(rows: DataFrame, category: Column, answer: Column) -> DataFrame:
    """Yes and no answers per category; both counts come from one pass."""
    said = F.lower(F.trim(answer))
    counts = rows.groupBy(category.alias("category")).agg(
        F.count_if(said == "yes").alias("all_yes"), F.count_if(said == "no").alias("all_no"))
    return counts.where("all_yes > 0 and all_no > 0")


def store_report(sales: DataFrame, store: str, order: str, day: str, amount: str, rows: int | None = None) -> DataFrame:
    """Revenue per store and year with one column per month, total and number of orders. A task groups its rows by order, with all these columns, so ``rows`` (or a
    count of the sales, if it is not given) decides how many tasks they are dealt to."""
    sales = spread(sales, [store, order], sales.count() if rows is None else rows)
    month = F.month(day)
    columns = [F.round(F.coalesce(F.sum(F.when(month == i + 1, F.col(amount))), F.lit(0.0)), 2).alias(name)
               for i, name in enumerate(MONTHS)]
    return sales.groupBy(store, F.year(day).alias("order_year")).agg(
        *columns, F.round(F.sum(amount), 2).alias("total_revenue"), F.count_distinct(order).alias("number_of_orders"))


def buyers_report(orders: DataFrame, people: DataFrame, key: str, mail: Column) -> DataFrame:
    """Orders placed per person, with the digest of the address instead of the address."""
    placed = orders.groupBy(key).agg(F.count(F.lit(1)).alias("orders_placed"))
    return people.join(placed, key).withColumn("mail_digest", F.md5(mail))
