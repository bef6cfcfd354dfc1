"""Exam marks: per-exam results with sub-totals, and the semester result.

Marks are decimals of three places. Every share and weighted mark is rounded half up to three places before it is added, so sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.operators.ordered import beside

MARK, TOTAL = "decimal(6,3)", "decimal(16,3)"


def exam_results(marks: DataFrame) -> DataFrame:
    """(exam, student, kind, subject, marks) to one row per subject plus a ``subTotal`` row per exam.

    A subject is passed with at least the pass percentage of its maximum; the sub-total fails when
    any subject failed and names them."""
    kind = F.col("kind")
    full = rules.by_type(rules.MAX_MARKS, kind).cast(MARK)
    percent = rules.by_type(rules.PASS_PERCENT, kind)
    rows = marks.withColumns({"marks": F.col("marks").cast(MARK), "max_marks": full}).withColumn("pass_mark", F.round(full * percent / 100, 3).cast(MARK))
    rows = rows.withColumn("failed", F.col("marks") < F.col("pass_mark"))
    detail = rows.select("exam", "student", "kind", F.col("subject").cast("string").alias("subject"), "marks", "max_marks",
                         "pass_mark", F.when(F.col("failed"), "FAIL").otherwise("PASS").alias("result"),
                         F.lit("").alias("comment"))
    total = rows.groupBy("exam", "student", "kind").agg(
        F.sum("marks").alias("marks"), F.sum("max_marks").alias("max_marks"), F.sum("pass_mark").alias("pass_mark"),
        F.sort_array(F.collect_set(F.when(F.col("failed"), F.col("subject").cast("string")))).alias("_failed"))
    some = F.size("_failed") > 0
    total = total.select("exam", "student", "kind", F.lit("subTotal").alias("subject"), "marks", "max_marks", "pass_mark",
                         F.when(some, "FAIL").otherwise("PASS").alias("result"),
                         F.when(some, F.concat(F.lit("Failed in "), F.array_join("_failed", ","))).otherwise("").alias("comment"))
    both = detail.unionByName(total).withColumns({c: F.col(c).cast(TOTAL) for c in ("marks", "max_marks", "pass_mark")})
    return both.withColumn("grade", rules.grade_by_type(F.col("marks"), F.col("max_marks"), kind))


def semester_results(planned: DataFrame, marks: DataFrame) -> DataFrame:
    """``planned`` holds (student, subject, kind, exam); ``marks`` the attended ones with marks and max_marks.

    The share of an exam, in percent of its maximum, is weighted with the weight of its kind divided by the number of planned exams; shares and weighted marks are
    rounded half up to three places. A subject is passed with half of the SA weight and 60 in total; the sub-total says ALL-CLEAR or RE-APPEAR."""
    keys = ["student", "subject", "kind", "exam"]
    rows = planned.join(marks.withColumns({c: F.col(c).cast(MARK) for c in ("marks", "max_marks")}), keys, "left")
    kind = F.col("kind")
    rows = beside(rows, ["student", "subject", "kind"], planned=F.count(F.lit(1)))
    share = F.round(F.col("marks") * 100 / F.col("max_marks"), 3).cast(MARK)
    point = F.round(share * rules.by_type(rules.FINAL_WEIGHT, kind).cast(MARK) / (F.col("planned").cast("decimal(9,0)") * 100), 3).cast(MARK)
    per_kind = rows.groupBy("student", "subject", "kind").agg(
        F.sum(F.coalesce(point, F.lit(0).cast(MARK))).alias("points"),
        F.sort_array(F.collect_set(F.when(F.col("marks").isNull(), F.col("exam").cast("string")))).alias("_missed"))

    def of(k, column, missing):
        return F.coalesce(F.max(F.when(kind == k, F.col(column))), F.lit(missing))

    missed = F.flatten(F.array(*[F.coalesce(F.max(F.when(kind == k, F.col("_missed"))), F.array().cast("array<string>"))
                                 for k in ("CA", "SA")]))
    subjects = per_kind.groupBy("student", "subject").agg(
        of("SA", "points", 0).cast(TOTAL).alias("sa_marks"), of("CA", "points", 0).cast(TOTAL).alias("ca_marks"), missed.alias("_missed"))
    sa_pass = rules.FINAL_WEIGHT["SA"] * rules.PASS_PERCENT["SA"] // 100
    ca_pass = rules.FINAL_WEIGHT["CA"] * rules.PASS_PERCENT["CA"] // 100
    subjects = subjects.withColumn("total", (F.col("sa_marks") + F.col("ca_marks")).cast(TOTAL))
    subjects = subjects.withColumn("passed", (F.col("sa_marks") >= sa_pass) & (F.col("total") >= 60))
    comment = (F.when(F.col("sa_marks") < sa_pass, "FAIL in SA").when(F.col("total") < 60, "Failed to achieve total pass")
               .when(F.col("ca_marks") >= ca_pass, "PASS in SA and CA").otherwise("PASS in SA and total, but fail in CA"))
    absent = F.when(F.size("_missed") > 0, F.concat(F.lit("Did not attend "), F.array_join("_missed", ","))).otherwise("")
    detail = subjects.select("student", F.col("subject").cast("string").alias("subject"), "sa_marks", "ca_marks", "total", F.lit(100).alias("out_of"),
                             F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("result"), comment.alias("comment"),
                             absent.alias("attendance"))
    sums = subjects.groupBy("student").agg(
        *[F.sum(c).cast(TOTAL).alias(c) for c in ("sa_marks", "ca_marks", "total")], (F.count(F.lit(1)) * 100).cast("int").alias("out_of"),
        F.when(F.bool_and("passed"), "ALL-CLEAR").otherwise("RE-APPEAR").alias("result"))
    sums = sums.select("student", F.lit("subTotal").alias("subject"), "sa_marks", "ca_marks", "total", "out_of", "result",
                       F.lit("").alias("comment"), F.lit("").alias("attendance"))
    both = detail.unionByName(sums)
    return both.withColumn("grade", rules.grade(F.col("total"), F.col("out_of"), "final"))
