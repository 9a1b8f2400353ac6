"""G1: incremental feature refresh with Structured Streaming.

New message files are read as a stream.  What is kept between batches is not
features but mergeable states (``operators/segments.py``), one per conversation
and day and one per conversation:

* ``messages``  the history, partitioned by day and epoch;
* ``days``      the state of each (conversation, day) ever touched;
* ``running``   per conversation the state of its last day and, merged, of all
  days before it.

A micro-batch appends its messages, recomputes the states of the days it
touches (only these days of only these conversations are read back, so rows
that arrive late within a day fall into place), and merges them with the running state.
A conversation whose batch reaches back before its last day is merged again
from its day states, of which there is one a day.  What a batch reads is thus
its own days and one state per conversation it touches, however long the
history.

The state tables and the features are versioned tables (``sources/versioned.py``)
written under the epoch as token, and the messages replace their epoch's
partitions, so a replayed epoch leaves one copy of everything.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from convolens.operators import features as FT
from convolens.operators.segments import SEGMENT, cuts_of, merge_states, split_states
from convolens.session import AS_OF_DEFAULT, checkpoint_dir
from convolens.sources.tables import MESSAGE_SCHEMA
from convolens.sources.versioned import VersionedTable

KEY, DAY = "cleaned_phone", "day"
_BEFORE = -(1 << 31)  # the place of a running state before all days
_CUTS_A_DAY = 1_000  # more than segments.CUTS


class FeatureStates:
    """The tables of a refresh under ``path``, and the merge of a batch into them."""

    def __init__(
        self, spark: SparkSession, path: str, features_path: str, specs: list[FT.Feature], as_of: str, least: int = 1_000_000
    ) -> None:
        self.spark, self.specs, self.as_of, self.least = spark, specs, as_of, least
        self.merges = FT.state_merges(specs)
        if self.merges is None:
            raise ValueError("every feature of an incremental chain must declare how its aggregates merge")
        self.messages_path = f"{path}/messages"
        self.days = VersionedTable(spark, f"{path}/days", [KEY, DAY])
        self.running = VersionedTable(spark, f"{path}/running", [KEY])
        self.features = VersionedTable(spark, features_path, [KEY])

    def update(self, batch: DataFrame, epoch: int) -> None:
        """Merge the messages of one epoch; an epoch that was merged before changes nothing."""
        token = f"epoch-{epoch}"
        if self.features.has(token):
            return
        batch = batch.withColumn(DAY, F.coalesce(F.unix_date(F.to_date("creation_time")), F.lit(_BEFORE + 1))).persist()
        try:
            days = [r[0] for r in batch.select(DAY).distinct().collect()]  # a number a day
            if not days:
                return
            (batch.withColumn("epoch", F.lit(int(epoch))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "epoch").parquet(self.messages_path))
            touched = batch.groupBy(KEY, DAY).agg(F.count(F.lit(1)).alias("n")).select(KEY, DAY)
            read = {}
            seen, known = Observation("messages"), Observation("states")
            if not self.days.has(token):  # else the epoch died after this step
                self.days.add(self._day_states(touched, days, seen), token)
                read["messages_read"] = seen.get["rows"]
            fresh = self.days.read().join(touched, [KEY, DAY], "left_semi")  # as written
            if not self.running.has(token):
                self.running.add(self._running(fresh, known), token)
                read["states_read"] = known.get["rows"]
            whole = self.running.read().join(touched.select(KEY).distinct(), KEY, "left_semi").select(KEY, "whole.*")
            self.features.add(FT.feature_outputs(whole, self.specs, self.as_of), token, epoch=epoch, **read)
        finally:
            batch.unpersist()

    def history(self, days: list[int]) -> DataFrame:
        """The messages of some days (only their partitions are read)."""
        return self.spark.read.parquet(self.messages_path).where(F.col(DAY).isin(days)).drop("epoch")

    def _day_states(self, touched: DataFrame, days: list[int], seen: Observation) -> DataFrame:
        messages = self.history(days).join(touched, [KEY, DAY], "left_semi")
        cuts = cuts_of(messages, KEY, least=self.least, rows=max(2, self.least // 4))
        observed = messages.observe(seen, F.count(F.lit(1)).alias("rows"))
        placed = cuts.assign(observed, KEY).withColumn(SEGMENT, F.col(DAY).cast("long") * _CUTS_A_DAY + F.col(SEGMENT))
        states = FT.segment_states(placed, self.specs, KEY).withColumn(DAY, F.floor(F.col(SEGMENT) / _CUTS_A_DAY).cast("int"))
        return merge_states(states, self.merges, [KEY, DAY], SEGMENT) if cuts.rows else states.drop(SEGMENT)

    def _running(self, fresh: DataFrame, known: Observation) -> DataFrame:
        """The running states of the touched conversations."""
        state = list(self.merges)
        first = fresh.groupBy(KEY).agg(F.min(DAY).alias("first"))
        held = self.running.read()
        if held is None:
            # the first batch: nothing to read, but the observation wants a row count
            return split_states(fresh.observe(known, F.lit(0).cast("long").alias("rows")), self.merges, KEY, DAY)
        prior = held.join(first, KEY).observe(known, F.count(F.lit(1)).alias("rows")).withColumn("late", F.col("first") < F.col(DAY))
        on_time = prior.where(~F.col("late"))
        earlier = on_time.where("before is not null").select(KEY, F.lit(_BEFORE).alias(DAY), "before.*")
        latest = on_time.where(F.col("first") != F.col(DAY)).select(KEY, DAY, "last.*")
        late = prior.where("late").select(KEY)
        again = self.days.read().join(late, KEY, "left_semi").select(KEY, DAY, *state)
        new = fresh.join(late, KEY, "left_anti").select(KEY, DAY, *state)
        return split_states(earlier.unionByName(latest).unionByName(new).unionByName(again), self.merges, KEY, DAY)


def refresh_features(
    spark: SparkSession,
    source_dir: str,
    history_path: str,
    features_path: str,
    specs: list[FT.Feature] | None = None,
    as_of: str = AS_OF_DEFAULT,
    name: str = "feature_refresh",
    available_now: bool = True,
):
    """Start the refresh query; with ``available_now`` it processes every file
    present at start, then stops (``trigger(availableNow=True)``)."""
    states = FeatureStates(spark, history_path, features_path, specs or FT.chain(FT.DEFAULT_CHAIN), as_of)
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    stream = spark.readStream.schema(MESSAGE_SCHEMA).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(states.update).option("checkpointLocation", ckpt).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_features(spark: SparkSession, features_path: str) -> DataFrame:
    """The current feature row per conversation (newest epoch wins)."""
    rows = VersionedTable(spark, features_path, [KEY]).read()
    if rows is None:
        raise ValueError(f"no features were written to {features_path}")
    return rows
