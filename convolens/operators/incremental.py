"""Incrementality: result cache by digest (C2, C3, J8), completion tracking
(C4-C6), campaign statistics (A6, A7).

The cache is a maintained table (:class:`ResultCache`), the completion log an
append-only one; "latest per key" is a partial aggregation (see
:func:`convolens.operators.leads.latest_per_key`), so nothing is rewritten in
place and a re-run after a lost executor reads the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolens.operators.features import order_key
from convolens.operators.leads import latest_per_key
from convolens.operators.transcript import digest_of, digest_parts, line_parts
from convolens.sources.versioned import VersionedTable

KEY = "cleaned_phone"


def latest_cache(cache: DataFrame, key: str = KEY) -> DataFrame:
    """The newest usable entry per digest (a null payload is a corrupt
    entry and counts as a miss).  Identical conversations share a digest; a
    tie on time is broken by the key so the choice is deterministic."""
    ok = cache.where(F.col("payload").isNotNull())
    return latest_per_key(ok, ["conversation_digest"], ["scored_at", key])


def score_needed(current: DataFrame, cache: DataFrame, key: str = KEY) -> DataFrame:
    """Conversations whose (key, digest) pair has no cache entry."""
    hits = cache.where(F.col("payload").isNotNull()).select(key, "conversation_digest")
    return current.join(hits, [key, "conversation_digest"], "left_anti")


def cache_hits(current: DataFrame, cache: DataFrame, key: str = KEY) -> DataFrame:
    """Cached results joined on the same key *and* the same digest."""
    return current.join(latest_cache(cache), [key, "conversation_digest"])


def completion_status(current: DataFrame, log: DataFrame, key: str = KEY) -> DataFrame:
    """C4 + C6: ACTIVE (never completed), COMPLETED (completed with the same
    digest) or REACTIVATED (completed, but the conversation changed since);
    only COMPLETED leads are skipped."""
    latest = latest_per_key(log, [key, "recipe"], ["completed_at"]).select(
        key, "recipe", F.col("digest").alias("completed_digest"), "completed_by", "completed_at"
    )
    j = current.join(latest, [key, "recipe"], "left")
    status = (
        F.when(F.col("completed_digest").isNull(), F.lit("ACTIVE"))
        .when(F.col("completed_digest") == F.col("conversation_digest"), F.lit("COMPLETED"))
        .otherwise(F.lit("REACTIVATED"))
    )
    return j.withColumn("status", status).withColumn("needs_processing", F.col("status") != "COMPLETED")


def completion_stats(status: DataFrame) -> DataFrame:
    """A6 + A7: per campaign, tracked leads, counts by status, completion rate,
    processed / skipped / reactivated."""
    tracked = F.count_if(F.col("status") != "ACTIVE")
    completed = F.count_if(F.col("status") == "COMPLETED")
    return status.groupBy("recipe").agg(
        tracked.alias("total_tracked"),
        completed.alias("completed"),
        F.count_if(F.col("status") == "REACTIVATED").alias("reactivated"),
        F.count_if(F.col("status") == "ACTIVE").alias("active"),
        F.count_if(F.col("needs_processing")).alias("processed"),
        F.count_if(~F.col("needs_processing")).alias("skipped"),
        F.round(F.when(tracked > 0, completed / tracked).otherwise(F.lit(0.0)), 6).alias("completion_rate"),
    )


def overall_completion(status: DataFrame) -> DataFrame:
    """Completed leads over all campaigns, as one row."""
    return status.agg(F.count_if(F.col("status") == "COMPLETED").alias("total_completed"))


def completed_leads(log: DataFrame, recipe: str) -> DataFrame:
    """The completion records of one campaign."""
    return log.where(F.col("recipe") == recipe)


def recent_completions(log: DataFrame, n: int = 3, key: str = KEY) -> DataFrame:
    """The last ``n`` completions per campaign (Spark keeps the first ``n``
    per campaign in every task before the exchange)."""
    newest = Window.partitionBy("recipe").orderBy(F.desc("completed_at"), F.desc(key))
    return log.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def mark_complete(rows: DataFrame, path: str) -> None:
    """Append completion records (idempotent per task attempt: Spark's
    commit protocol publishes each task's file once)."""
    rows.write.mode("append").parquet(path)


class ResultCache:
    """C3 + K7: the results of handled conversations as a maintained table, one
    row per (key, digest): a snapshot plus the runs since (``VersionedTable``).
    Looking results up reads this table and no earlier messages."""

    def __init__(self, spark: SparkSession, path: str, key: str = KEY) -> None:
        self.key = key
        self.table = VersionedTable(spark, path, [key, "conversation_digest"])

    def add(self, results: DataFrame, run: str | None = None) -> None:
        """Store a run's results: rows with a digest and a payload (a corrupt
        entry must not hide an older good one), the newest of equal keys.  A
        run that is stored twice under its name is there once."""
        usable = results.where(F.col("conversation_digest").isNotNull() & F.col("payload").isNotNull())
        self.table.add(latest_per_key(usable, [self.key, "conversation_digest"], ["scored_at", "payload"]), run)

    def rows(self, like: DataFrame) -> DataFrame:
        """All entries; ``like`` gives the key's type while there are none."""
        found = self.table.read()
        if found is None:
            kind = like.schema[self.key].dataType.simpleString()
            found = like.sparkSession.createDataFrame([], f"{self.key} {kind}, conversation_digest string, payload string, scored_at timestamp")
        return found

    def needed(self, current: DataFrame) -> DataFrame:
        """The conversations without a stored result."""
        return score_needed(current, self.rows(current), self.key)

    def hits(self, current: DataFrame) -> DataFrame:
        """The conversations with one, and it."""
        return cache_hits(current, self.rows(current), self.key)


def version_digests(messages: DataFrame, drop_when: Column, key: str = KEY) -> DataFrame:
    """The digest of every conversation now and before its last message (where
    ``drop_when`` held then, else now): ``key, conversation_digest, n_messages,
    old_digest, old_messages``, in one aggregation.  A digest is made of sums,
    so the last message's part is taken off them."""
    parts = digest_parts()
    own = line_parts()
    last = F.max_by(F.struct(*[own[n].alias(n) for n in parts], drop_when.alias("__drop")), order_key(messages.columns))
    sums = messages.groupBy(key).agg(*[c.alias(f"__{n}") for n, c in parts.items()], last.alias("__last"))
    less = {n: F.col(f"__{n}") - F.when(F.col("__last.__drop"), F.col(f"__last.{n}")).otherwise(F.lit(0)) for n in parts}
    same = lambda n: less[n].cast(sums.schema[f"__{n}"].dataType)
    return sums.select(
        key, digest_of(*[F.col(f"__{n}") for n in parts]).alias("conversation_digest"), F.col("__n").alias("n_messages"),
        digest_of(*map(same, parts)).alias("old_digest"), same("n").alias("old_messages"),
    )
