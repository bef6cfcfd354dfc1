"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def occurrences(col: Column | str, word: str) -> Column:
    """How often a literal text occurs, not overlapping."""
    text = _c(col)
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def nth_index(col: Column | str, needle: str, n: int) -> Column:
    """1-based position of the n-th occurrence of a text, 0 when there are fewer."""
    text = _c(col)
    found = occurrences(text, needle) >= n
    before = F.substring_index(text, needle, n)
    return F.when(found, F.length(before) + 1).otherwise(0)


def tags(col: Column | str, pattern: str = r"#(\w+)") -> Column:
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(1))


def camel_case(col: Column | str) -> Column:
    """Words joined without blanks, each but the first capitalised."""
    joined = F.replace(F.initcap(F.trim(F.regexp_replace(_c(col), r"[_\s]+", " "))), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), joined.substr(F.lit(2), F.length(joined)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks; empty when there are fewer than n."""
    length = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), length)
    for shift in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(shift + 1), length), lambda a, b: F.concat_ws(" ", a, b))
    return out


def all_match(col: Column | str, pattern: str, sep: str = ",") -> Column:
    """Whether every element of a delimited list contains the pattern."""
    return F.forall(F.split(_c(col), sep), lambda x: F.instr(x, pattern) > 0)


def categorise(col: Column | str, groups: dict[str, list[str]], default: str) -> Column:
    """Label of the group that holds the trimmed lower-case value."""
    value, out = F.lower(F.trim(_c(col))), F
    for label, members in groups.items():
        out = out.when(value.isin(members), label)
    return out.otherwise(default)
