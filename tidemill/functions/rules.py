"""Decision tables kept as data: grade bands, marks rules, buy-back percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percentage above which a letter is given, high to low; the last band includes its bound.
GRADE_BANDS = {
    "CA": [(95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C+"), (70, "C"), (65, "D+"), (60, "D"),
           (50, "E+"), (45, "E")],
    "SA": [(95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C+"), (70, "C"), (65, "D+"), (60, "D"),
           (50, "E")],
    "final": [(95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C"), (70, "D"), (60, "E")],
}
# Full marks, pass percentage and weight in the semester of each kind of exam.
MAX_MARKS = {"SA": 100, "CA": 60}
PASS_PERCENT = {"SA": 50, "CA": 45}
FINAL_WEIGHT = {"SA": 60, "CA": 40}
# Full years since the build year -> [(months up to, percentage)], then the rest.
BUY_BACK = {0: ([(6, 90), (9, 80)], 75), 1: ([(6, 75)], 70), 2: ([(6, 65)], 60), 3: ([(6, 55)], 50)}
BUY_BACK_OLDER = 50


def by_type(table: dict, kind: Column) -> Column:
    """Look a value up in a small table by type."""
    out = F
    for key, value in table.items():
        out = out.when(kind == key, value)
    return out


def grade(marks: Column, max_marks: Column, kind: str) -> Column:
    percent = marks * 100 / max_marks
    bands = GRADE_BANDS[kind]
    out = F
    for low, letter in bands[:-1]:
        out = out.when(percent > low, letter)
    out = out.when(percent >= bands[-1][0], bands[-1][1])
    if kind == "final":
        out = out.when(percent == 0, "F-")
    return out.otherwise("F")


def grade_by_type(marks: Column, max_marks: Column, kind: Column) -> Column:
    return (F.when(kind == "CA", grade(marks, max_marks, "CA"))
            .when(kind == "SA", grade(marks, max_marks, "SA")))


def buy_back_percent(year: Column, month: Column, ref_year: int, ref_month: int) -> Column:
    """Buy-back percentage of a vehicle by its calendar years and whole months at a reference month (1 to 12)."""
    years = F.lit(ref_year) - year
    months = F.lit(12 * ref_year + ref_month) - (12 * year + month)
    out = F
    for age, (steps, rest) in BUY_BACK.items():
        for upto, percent in steps:
            out = out.when((years == age) & (months <= upto), percent)
        out = out.when(years == age, rest)
    return out.otherwise(BUY_BACK_OLDER)
