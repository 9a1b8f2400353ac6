"""Scalar text functions as Spark Column expressions (JVM-side, codegen'd)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolens.functions import patterns as P

# Java regex flags that make Spark's `rlike` behave like Python `re` on str:
# d = only "\n" ends a line, U = Unicode \s \w \b classes, u = Unicode case folding.
PY_FLAGS = "(?dU)"
PY_FLAGS_I = "(?dUiu)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_accents(col: Column | str) -> Column:
    """map the 14 precomposed Spanish accented letters to plain ones."""
    return F.translate(_c(col), P.ACCENTED, P.UNACCENTED)


def strip_accents_py(text: str) -> str:
    """Python twin of :func:`strip_accents` (for patterns and tests)."""
    return text.translate(str.maketrans(P.ACCENTED, P.UNACCENTED))


def contains_any(col: Column | str, phrases: list[str]) -> Column:
    """true when the text contains any literal phrase."""
    c = _c(col)
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def any_regex(patterns: list[str]) -> str:
    """One alternation of the given patterns (each kept as a group)."""
    return "|".join(f"(?:{p})" for p in patterns)


def rlike_any(col: Column | str, patterns: list[str], ignore_case: bool = False) -> Column:
    """true when any regex matches somewhere in the text (Python `re.search`)."""
    flags = PY_FLAGS_I if ignore_case else PY_FLAGS
    return _c(col).rlike(flags + any_regex(patterns))


def literal_regex(phrases: list[str]) -> list[str]:
    """Escape literal phrases so they can be used as regex alternatives."""
    return [re.escape(p) for p in phrases]


def redact_pii(col: Column | str) -> Column:
    """phone runs of 10+ digits first, then e-mail addresses."""
    phone = F.regexp_replace(_c(col), "(?U)" + P.PII_PHONE.replace(r"\d", "[0-9]"), P.PII_PHONE_TOKEN)
    return F.regexp_replace(phone, "(?U)" + P.PII_EMAIL, P.PII_EMAIL_TOKEN)


def normalize_ws(col: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim (Python `" ".join(s.split())`)."""
    return F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def text_digest(col: Column | str) -> Column:
    """F6 on one string: md5 hex of the whitespace-normalised text; null -> ''."""
    return F.md5(normalize_ws(F.coalesce(_c(col), F.lit(""))))


def truncate_text(col: Column | str, max_len: int, marker: str = "...") -> Column:
    """Cut text longer than ``max_len`` characters and append ``marker``."""
    c = _c(col)
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, max_len), F.lit(marker))).otherwise(c)


def blank_sentinels(col: Column | str) -> Column:
    """cast to string, null and the texts nan/None/NaN become ''."""
    s = _c(col).cast("string")
    return F.when(s.isNull() | s.isin(*P.SENTINELS), F.lit("")).otherwise(s)


def mask_sensitive(df, names: list[str] | None = None):
    """replace values of columns whose name mentions a sensitive word."""
    words = [w.lower() for w in (names or P.SENSITIVE_NAMES)]
    cols = []
    for name in df.columns:
        if any(w in name.lower() for w in words):
            cols.append(F.lit("[REDACTED]").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def lead_name(col: Column | str) -> Column:
    """the name between asterisks in a 'Hola *name*!' greeting, else null."""
    return F.nullif(F.regexp_extract(_c(col), P.LEAD_NAME_GREETING, 1), F.lit(""))
