"""Time functions: zone conversion to ISO text, duration texts, lenient parsing.

All arithmetic is on microseconds since the epoch, so results do not depend on
the session time zone except where a zone is named explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def as_ts(col: Column | str) -> Column:
    """Any timestamp-like column as a (session-zone) TIMESTAMP."""
    return _c(col).cast("timestamp")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds as a double: (micros(later) - micros(earlier)) / 1e6."""
    return (F.unix_micros(as_ts(later)) - F.unix_micros(as_ts(earlier))).cast("double") / F.lit(1e6)


def hours_minutes(seconds: Column) -> Column:
    """T4/T5: '{h}h {m}m' from double hours, both parts truncated toward zero."""
    hours = seconds / F.lit(3600.0)
    h = hours.cast("bigint")
    m = ((hours - h) * F.lit(60)).cast("bigint")
    return F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))


def _two_product(a: Column, b: float) -> tuple[Column, Column]:
    """Dekker's exact product: ``a * b == p + err`` exactly (IEEE doubles)."""
    split = 134217729.0  # 2**27 + 1
    p = a * F.lit(b)
    t = a * F.lit(split)
    ah = t - (t - a)
    al = a - ah
    tb = b * split
    bh = tb - (tb - b)
    bl = b - bh
    err = ((ah * F.lit(bh) - p) + ah * F.lit(bl) + al * F.lit(bh)) + al * F.lit(bl)
    return p, err


def py_fixed(x: Column, digits: int) -> Column:
    """Python's ``format(x, f'.{digits}f')`` for a double column: round half to
    even on the *exact* binary value (Java's formatter rounds the shortest
    decimal text half-up, which differs on near-ties such as 1.15)."""
    scale = float(10**digits)
    mag = F.abs(x)
    p, err = _two_product(mag, scale)
    fl = F.floor(p)
    frac = p - fl
    up = (
        F.when(frac > 0.5, 1)
        .when(frac < 0.5, 0)
        .when(err > 0, 1)
        .when(err < 0, 0)
        .when(F.pmod(fl, F.lit(2)) == 1, 1)
        .otherwise(0)
    )
    n = (fl + up).cast("decimal(38,0)")
    if digits == 0:
        body = n.cast("string")
    else:
        body = F.concat(
            F.floor(n / F.lit(int(scale))).cast("string"),
            F.lit("."),
            F.lpad(F.pmod(n, F.lit(int(scale))).cast("bigint").cast("string"), digits, "0"),
        )
    sign = F.when((x < 0) | x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, body)


def age_text(seconds: Column) -> Column:
    """under 1 h '{m:.0f} min', under 48 h '{h:.1f} h', else '{d:.1f} días'; null -> 'N/A'."""
    minutes = seconds / F.lit(60.0)
    hours = minutes / F.lit(60.0)
    return (
        F.when(seconds.isNull(), F.lit("N/A"))
        .when(hours < 1.0, F.concat(py_fixed(minutes, 0), F.lit(" min")))
        .when(hours < 48.0, F.concat(py_fixed(hours, 1), F.lit(" h")))
        .otherwise(F.concat(py_fixed(hours / F.lit(24.0), 1), F.lit(" días")))
    )


def iso_in_zone(col: Column | str, tz: str) -> Column:
    """The instant shown in zone ``tz`` as ISO-8601 with offset,
    fraction only when non-zero (Python ``isoformat``)."""
    t = as_ts(col)
    local = F.from_utc_timestamp(t, tz)
    offset = (F.unix_micros(local) - F.unix_micros(t)) / F.lit(1_000_000)
    off = offset.cast("bigint")
    sign = F.when(off < 0, F.lit("-")).otherwise(F.lit("+"))
    a = F.abs(off)
    off_txt = F.concat(
        sign,
        F.lpad((a / 3600).cast("bigint").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(((a % 3600) / 60).cast("bigint").cast("string"), 2, "0"),
    )
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    frac = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.when(
        t.isNotNull(),
        F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), frac, off_txt),
    )


def ts_text19(col: Column | str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' — the first 19 characters of an ISO timestamp."""
    return F.date_format(as_ts(col), "yyyy-MM-dd HH:mm:ss")


def parse_ts(col: Column | str) -> Column:
    """parse ISO-like text (fraction, 'T', '+00:00', ' UTC' suffix) or null.
    The shape of the text says which format to try, so each is parsed once."""
    c = F.regexp_replace(F.trim(_c(col).cast("string")), r"\s*UTC$", "")
    return (
        F.when(c.rlike(r"^\d{4}-\d\d-\d\d "), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]")))
        .when(c.rlike(r"^\d{4}-\d\d-\d\dT"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]")))
        .when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    )


def parse_ts_month_first(col: Column | str) -> Column:
    """Lenient sheet dates, month first (M/d/yyyy[ H:mm[:ss]]) or ISO."""
    c = F.trim(_c(col).cast("string"))
    shape = r"^\d{1,2}/\d{1,2}/\d{4}"
    return (
        F.when(c.rlike(shape + r" \d{1,2}:\d\d:\d\d$"), F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm:ss")))
        .when(c.rlike(shape + r" \d{1,2}:\d\d$"), F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm")))
        .when(c.rlike(shape + "$"), F.try_to_timestamp(c, F.lit("M/d/yyyy")))
        .otherwise(parse_ts(c))
    )
