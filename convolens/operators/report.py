"""Merge and report shaping: J6, J7, J10, P1, P6-P8, P14-P18, P20, K6, K8, K9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolens.functions import patterns as P
from convolens.functions.phones import is_strict_phone, phone_first10
from convolens.functions.text import blank_sentinels
from convolens.operators.keyed import keyed_aggregate

KEY = "cleaned_phone"


def rename_key(df: DataFrame, source: str = "cleaned_phone_number", target: str = KEY) -> DataFrame:
    """Canonical key name, only when the target name is absent."""
    if source in df.columns and target not in df.columns:
        return df.withColumnRenamed(source, target)
    return df


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> DataFrame:
    """Plan-time check that the columns exist."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def drop_null_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows without a key cannot be joined."""
    return df.na.drop(subset=[key])


def normalise_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """P1 + P2 + P7: canonical key name, its first run of ten digits, and no
    row without one.  Leads, messages and labels pass the same rule."""
    df = rename_key(df)
    df = df.withColumn(key, phone_first10(F.col(key).cast("string")))
    return drop_null_keys(df, key)


def normalise_lead_keys(leads: DataFrame, key: str = KEY) -> DataFrame:
    """The key rules with the check that the lead table has a key."""
    require_columns(rename_key(leads), [key], "lead table")
    return normalise_keys(leads, key)


#: Columns that say which of a key's rows is the newest, in this order, where a table has them.
NEWEST = ("scored_at", "turn")


def one_per_key(df: DataFrame, key: str = KEY, newest: tuple[str, ...] = NEWEST) -> DataFrame:
    """One row per key, as a result holds one per phone: the newest by the
    columns of ``newest`` that exist (null the oldest), of equally new ones the
    greatest by its other columns.  A partial aggregate: a hot key is combined
    map-side."""
    rest = [c for c in df.columns if c != key]
    order = [F.col(c) for c in newest if c in rest] + [F.col(c).cast("string") for c in rest if c not in newest]
    if not order:
        return keyed_aggregate(df, key).select(key)
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return keyed_aggregate(df, key, row).select(key, "__row.*")


def strict_phone_filter(df: DataFrame, col: str = KEY, observation: Observation | None = None) -> DataFrame:
    """Keep rows whose trimmed phone is exactly ten digits; kept/skipped
    counts are collected by an ``Observation`` while the job runs (no extra job)."""
    ok = is_strict_phone(col)
    if observation is not None:
        df = df.observe(observation, F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))
    return df.where(ok).withColumn(col, F.trim(F.col(col)))


def ordered_projection(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Requested columns that exist, in request order, first occurrence
    kept; when none exists (or none requested) every column."""
    if not columns:
        return df
    seen, keep = set(), []
    for c in columns:
        if c in df.columns and c not in seen:
            keep.append(c)
            seen.add(c)
    return df.select(*keep) if keep else df


def include_exclude(
    df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, key: str = KEY
) -> DataFrame:
    """Include list (key kept and put first when missing) / exclude list
    (key never dropped)."""
    if include:
        cols = [c for c in include if c in df.columns]
        if key not in cols and key in df.columns:
            cols.insert(0, key)
        df = df.select(*cols)
    if exclude:
        df = df.drop(*[c for c in exclude if c != key])
    return df


def backfill_columns(df: DataFrame, columns: list[str] | None, value: str = "") -> DataFrame:
    """Add declared output columns missing from the result."""
    missing = {c: F.lit(value) for c in (columns or []) if c not in df.columns}
    return df.withColumns(missing) if missing else df


def as_text(df: DataFrame, name: str) -> Column:
    """A column as report text: booleans as True/False (as the reference's
    writer prints them), everything else cast; null -> ''."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def export_prep(df: DataFrame, columns: list[str] | None = None, drop: tuple[str, ...] = ("timing_reasoning",)) -> DataFrame:
    """Drop internal columns, project, nulls -> '' with every column as text."""
    df = df.drop(*[c for c in drop if c in df.columns])
    df = ordered_projection(df, columns)
    if not df.columns:
        raise ValueError("nothing to export: the frame has no columns")
    return df.select(*[as_text(df, c).alias(c) for c in df.columns])


def curated_projection(df: DataFrame, columns: list[str] = P.CURATED_COLUMNS) -> DataFrame:
    """Fixed columns in order, missing ones as '', all text, sentinels blanked."""
    cols = []
    for c in columns:
        src = F.col(c) if c in df.columns else F.lit("")
        cols.append(blank_sentinels(src).alias(c))
    return df.select(*cols)


def publish_frame(df: DataFrame, stamp: str) -> DataFrame:
    """K8: nulls -> '', every column as text, plus a 'last updated' stamp column."""
    out = df.select(*[as_text(df, c).alias(c) for c in df.columns])
    return out.withColumn("last_updated", F.lit(stamp))


def _rename_overlaps(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    overlap = [c for c in right.columns if c in left.columns and c != key]
    if overlap:
        left = left.withColumnsRenamed({c: f"{c}_x" for c in overlap})
        right = right.withColumnsRenamed({c: f"{c}_y" for c in overlap})
    return left, right


def merge_results(
    leads: DataFrame,
    results: DataFrame | None,
    errors: DataFrame | None = None,
    key: str = KEY,
    as_of: str | None = None,
) -> DataFrame:
    """J6 + J7 + P20: results and errors left-joined onto the leads (a lead
    listed twice gets the row twice; overlapping names get ``_x``/``_y``),
    then the missing-value defaults."""
    out = leads
    if results is not None:
        out, results = _rename_overlaps(out, results, key)
        out = out.join(results, key, "left")
    if errors is not None:
        out, errors = _rename_overlaps(out, errors, key)
        out = out.join(errors, key, "left")
    defaults: dict[str, Column] = {}
    summary = F.lit(P.NO_CONVERSATION_SUMMARY)
    defaults["summary"] = F.coalesce(F.col("summary"), summary) if "summary" in out.columns else summary
    digest = F.lit(P.NO_CONVERSATION_DIGEST)
    defaults["conversation_digest"] = (
        F.coalesce(F.col("conversation_digest"), digest) if "conversation_digest" in out.columns else digest
    )
    now = F.lit((as_of or "")[:19]) if as_of else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    defaults["last_message_ts"] = F.coalesce(F.col("last_message_ts"), now) if "last_message_ts" in out.columns else now
    return out.withColumns(defaults)


def no_conversation_rows(leads: DataFrame, conversations: DataFrame, key: str = KEY, **defaults) -> DataFrame:
    """Leads with no conversation, each with a default result row."""
    keys = conversations.select(key).distinct()
    rows = leads.join(keys, key, "left_anti")
    return rows.withColumns({k: F.lit(v) for k, v in defaults.items()}) if defaults else rows


def error_rows(results: DataFrame, key: str = KEY) -> DataFrame:
    """K6: the error side-output ``(key, error, cache_status='ERROR')``."""
    return results.where(F.col("error").isNotNull()).select(key, "error", F.lit("ERROR").alias("cache_status"))


def run_summary(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """K9: the row count of a stage, observed while the stage runs; read it with
    ``observation.get`` after the action."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def key_counts(df: DataFrame, key: str = KEY) -> DataFrame:
    """K9: exact counts of rows and of distinct keys, as one row."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("keys"))


def no_messages_result(leads: DataFrame) -> DataFrame:
    """When there is no message at all, the leads with one constant summary."""
    return leads.withColumn("summary", F.lit(P.NO_CONVERSATION_AVAILABLE))


def scored_and_unscored(scored: DataFrame, leads: DataFrame, defaults: dict, key: str = KEY) -> DataFrame:
    """Scored rows and, for every lead without one, a default row."""
    rest = no_conversation_rows(leads.select(key).distinct(), scored, key, **defaults)
    return scored.unionByName(rest, allowMissingColumns=True)
