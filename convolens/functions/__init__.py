"""Scalar functions (Column expressions) and the fixed pattern sets."""

from convolens.functions.emails import clean_email, clean_email_sql
from convolens.functions.phones import (
    is_strict_phone,
    phone_first10,
    phone_last10,
    phone_last10_strict,
    phone_right10,
)
from convolens.functions.text import (
    blank_sentinels,
    contains_any,
    lead_name,
    mask_sensitive,
    normalize_ws,
    redact_pii,
    rlike_any,
    strip_accents,
    text_digest,
    truncate_text,
)
from convolens.functions.timefmt import (
    age_text,
    hours_minutes,
    iso_in_zone,
    parse_ts,
    parse_ts_month_first,
    seconds_between,
    ts_text19,
)

__all__ = [
    "age_text", "blank_sentinels", "clean_email", "clean_email_sql", "contains_any",
    "hours_minutes", "is_strict_phone", "iso_in_zone", "lead_name", "mask_sensitive",
    "normalize_ws", "parse_ts", "parse_ts_month_first", "phone_first10", "phone_last10",
    "phone_last10_strict", "phone_right10", "redact_pii", "rlike_any", "seconds_between",
    "strip_accents", "text_digest", "truncate_text", "ts_text19",
]
