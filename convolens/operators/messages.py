"""Message selection: session join, target semi-join, time bounds, phase start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions.phones import phone_right10
from convolens.operators.features import order_key
from convolens.operators.keyed import keyed_aggregate
from convolens.operators.prefix import PLACE, with_prefix


def target_keys(leads: DataFrame, key: str = "cleaned_phone") -> DataFrame:
    """J2 key list: distinct, non-blank keys.  Grouped so that a join on the key
    does not take over its partitioning (``operators/keyed.py``)."""
    k = F.col(key)
    return keyed_aggregate(leads.select(k.alias(key)).where(k.isNotNull() & (F.trim(k) != "")), key).select(key)


def messages_with_sessions(message_metrics: DataFrame, sessions: DataFrame) -> DataFrame:
    """J1 + P5: messages joined to their session; key = RIGHT(contact id, 10)."""
    j = message_metrics.join(sessions, "session_id")
    cols = [phone_right10("user_platform_contact_id").alias("cleaned_phone_number")]
    cols += [c for c in ["src_ord", "creation_time", "msg_from", "operator_alias", "message"] if c in message_metrics.columns]
    return j.select(*cols)


def for_targets(messages: DataFrame, targets: DataFrame, key: str = "cleaned_phone") -> DataFrame:
    """Keep messages whose key is a target (semi-join; AQE broadcasts the
    key list only when its measured size is under the broadcast threshold)."""
    return messages.join(target_keys(targets, key), key, "left_semi")


def time_bounds(
    df: DataFrame,
    time_col: str = "creation_time",
    start: str | None = None,
    end: str | None = None,
    as_of: str | None = None,
    lookback_days: int | None = None,
) -> DataFrame:
    """Absolute ``>= start`` / ``<= end`` and relative look-back from
    ``as_of``; all become pushed-down filters."""
    t = F.col(time_col)
    if start is not None:
        df = df.where(t >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.where(t <= F.to_timestamp(F.lit(end)))
    if lookback_days is not None:
        if as_of is None:
            raise ValueError("a look-back needs an as_of time")
        df = df.where(t >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    return df


def from_phase_start(
    df: DataFrame, is_start: Column, key: str = "cleaned_phone", time_col: str = "creation_time"
) -> DataFrame:
    """Rows at or after their key's phase start (keys without one drop out).

    The start table has one row per key; a hot key on the message side is
    split by AQE's skew-join handling rather than sent to one task."""
    starts = keyed_aggregate(df.where(is_start), key, F.min(time_col).alias("phase_start"))
    return df.join(starts, key).where(F.col(time_col) >= F.col("phase_start"))


def content_filter(messages: DataFrame, predicate: Column, key: str = "cleaned_phone") -> DataFrame:
    """Keep whole conversations that contain at least one matching message."""
    keys = keyed_aggregate(messages, key, F.bool_or(predicate).alias("__hit")).where("__hit").select(key)
    return messages.join(keys, key, "left_semi")


def limit_conversations(messages: DataFrame, n: int, key: str = "cleaned_phone") -> DataFrame:
    """The first ``n`` conversation keys in key order (a deliberate limit:
    the feature *is* a bounded run) and all of their messages."""
    keys = messages.select(key).distinct().orderBy(key).limit(n)
    return messages.join(keys, key, "left_semi")


def with_ordinal(messages: DataFrame, key: str = "cleaned_phone") -> DataFrame:
    """``msg_idx``, the dense place of a message in its conversation: the
    count of earlier messages, as a running sum over stretches of the sorted
    table (``operators/prefix.py``), so a hot conversation or day is no task."""
    one = {"msg_idx": F.lit(1).cast("long")}
    return with_prefix(messages, key, order_key(messages.columns), one)[0].drop(PLACE)
