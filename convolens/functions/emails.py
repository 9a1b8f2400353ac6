"""E-mail canonicalisers P9 (application rule) and P10 (warehouse SQL rule)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def clean_email(col: Column | str) -> Column:
    """Lower-case; cut a '+alias' from the local part; no '@' (or nothing
    after it) -> lower of the whole text; null or '' -> ''."""
    c = _c(col)
    has_at = F.locate("@", c) > 0
    local = F.substring_index(c, "@", 1)
    # domain = everything after the first '@'
    domain = F.substring(c, F.locate("@", c) + 1, F.lit(1 << 30))
    local_cut = F.substring_index(local, "+", 1)
    with_domain = F.concat(F.lower(local_cut), F.lit("@"), F.lower(domain))
    out = F.when(has_at & (F.length(domain) > 0), with_domain).otherwise(F.lower(c))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(out)


def clean_email_sql(col: Column | str) -> Column:
    """P10: if the text has a '+', the part before the first '+' followed by the
    part from the first '@'; lower-cased; null stays null."""
    c = _c(col)
    plus = F.locate("+", c)
    at = F.locate("@", c)
    before_plus = F.substring(c, F.lit(1), plus - 1)
    # SQL SUBSTRING(x FROM 0) is the whole text, as is Spark's substring at 0
    from_at = F.substring(c, at, F.lit(1 << 30))
    return F.lower(F.when(plus > 0, F.concat(before_plus, from_at)).otherwise(c))
