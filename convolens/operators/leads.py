"""Lead selection: eligibility, hand-off anti-join, latest row per key, contacts.

Top-1-per-group is written as an aggregation — ``max_by(struct(row),
struct(order keys))`` — rather than ``row_number() over (partition by ...)``:
it aggregates map-side, so one e-mail owning a large share of all rows is
reduced before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.functions.emails import clean_email_sql
from convolens.functions.phones import phone_right10


def latest_per_key(df: DataFrame, keys: list[str], order_desc: list[str]) -> DataFrame:
    """The row with the greatest ``order_desc`` tuple per ``keys`` group
    (``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order_desc DESC) = 1``)."""
    cols = df.columns
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order_desc]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*[F.col(f"__best.{c}").alias(c) for c in cols])


def eligible_status(status_col: str = "profiling_status", excluded_suffix: str = "R"):
    """Status missing, or its last character is not the excluded one."""
    s = F.col(status_col)
    return s.isNull() | (F.right(s, F.lit(1)) != F.lit(excluded_suffix))


def entered_handoff(audit: DataFrame, distinct: bool = True) -> DataFrame:
    """A4: lead ids whose offer status became ENTERED (distinct on request: an
    anti-join does not need it, and skipping it saves an exchange)."""
    ids = audit.where((F.col("field") == "OFFER_STATUS") & (F.col("new_value") == "ENTERED")).select("lead_id")
    return ids.distinct() if distinct else ids


def lead_data(
    financing_leads: DataFrame,
    product: str | None = None,
    as_of: str | None = None,
    lookback_days: int | None = None,
) -> DataFrame:
    """Lead source rows with the warehouse e-mail rule (P10), product filter
    (P13) and relative look-back (P12)."""
    df = financing_leads
    if product is not None:
        df = df.where(F.col("product") == product)
    if lookback_days is not None and as_of is not None:
        start = F.date_sub(F.to_date(F.lit(as_of)), lookback_days)
        df = df.where(F.col("create_date") >= start)
    return df.select(
        F.col("id").alias("lead_id"),
        "user_id",
        clean_email_sql("user_email").alias("clean_email"),
        F.col("create_date").alias("lead_created_at"),
        "profiling_status",
    )


def eligible_leads(
    financing_leads: DataFrame,
    audit: DataFrame,
    excluded_suffix: str = "R",
    product: str | None = None,
    as_of: str | None = None,
    lookback_days: int | None = None,
) -> DataFrame:
    """P13 + J3 + W1: leads not yet in hand-off, latest per clean e-mail."""
    ld = lead_data(financing_leads, product, as_of, lookback_days)
    eligible = ld.join(entered_handoff(audit, distinct=False), "lead_id", "left_anti").where(
        eligible_status("profiling_status", excluded_suffix)
    )
    latest = latest_per_key(eligible, ["clean_email"], ["lead_created_at", "lead_id"])
    return latest.select("lead_id", "user_id", "clean_email", "lead_created_at")


def clean_intents(intents: DataFrame) -> DataFrame:
    """Contact intents with the warehouse e-mail rule (P10) and RIGHT(phone,10) (P5)."""
    return intents.select(
        "id",
        clean_email_sql("email").alias("cleaned_email"),
        "name",
        "last_name",
        phone_right10("phone_number").alias("cleaned_phone_number"),
        "updated_at",
    )


def leads_with_contact(latest_leads: DataFrame, intents: DataFrame) -> DataFrame:
    """J2 + W2 + J4: each lead's latest intent by e-mail; leads without a phone
    in it are dropped.  The leads meet the intents once: the join is the
    semi-join, and the latest intent per lead is a partial aggregation over
    its result.  Sort (O2) where the result is written."""
    ic = clean_intents(intents)
    met = latest_leads.join(ic, latest_leads["clean_email"] == ic["cleaned_email"])
    keys = ["lead_id", "user_id", "clean_email", "lead_created_at"]
    newest = latest_per_key(
        met.select(*keys, "name", "last_name", "cleaned_phone_number", "updated_at", "id"), keys, ["updated_at", "id"]
    )
    return newest.where(F.col("cleaned_phone_number").isNotNull()).select(
        "lead_id", "user_id", "clean_email", "name", "last_name", "cleaned_phone_number", "lead_created_at"
    )
