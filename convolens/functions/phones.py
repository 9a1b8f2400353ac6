"""Phone-number normalisers P2-P6 (four different rules, all exposed by name)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def phone_first10(col: Column | str) -> Column:
    """P2 (rule A): first run of ten digits in the trimmed text, else null."""
    return F.nullif(F.regexp_extract(F.trim(_c(col)), "([0-9]{10})", 1), F.lit(""))


def _digits(col: Column | str) -> Column:
    return F.regexp_replace(_c(col).cast("string"), "[^0-9]", "")


def phone_last10(col: Column | str) -> Column:
    """P3 (rule B): digits only, last ten; shorter kept as is; null/'' -> ''."""
    d = _digits(col)
    return F.when(_c(col).isNull() | (_c(col).cast("string") == ""), F.lit("")).otherwise(F.right(d, F.lit(10)))


def phone_last10_strict(col: Column | str) -> Column:
    """P4 (rule C): as B, but fewer than ten digits (or null) -> ''."""
    d = _digits(col)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise(F.lit(""))


def phone_right10(col: Column | str) -> Column:
    """P5 (rule D): SQL RIGHT(x, 10), no digit check."""
    return F.right(_c(col).cast("string"), F.lit(10))


def is_strict_phone(col: Column | str) -> Column:
    """Trimmed text is exactly ten digits."""
    return F.coalesce(F.trim(_c(col)).rlike("^[0-9]{10}$"), F.lit(False))
