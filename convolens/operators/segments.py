"""Segments: a conversation as a sequence of pieces whose states are merged.

Order-dependent features (first reply after an invitation, trailing run of
templates) are folded per *segment*: a stretch of a conversation that holds
every message between its ends.  A segment's state is a row of aggregates, and
the states of neighbouring segments merge associatively (:data:`MERGES`), so a
conversation may be cut anywhere in time and in any number of pieces.

Most conversations are one segment.  One that holds a large share of all
messages is found by a mergeable frequency sketch (``approx_top_k``, one pass
over the key column) and cut at quantiles of its times, so that no task gets
more than a bounded share of it.  What the sketch misses or overstates changes
the cuts only, never a result.

The same merge serves incremental work: a stored state is merged with the
state of newer messages without reading the older ones again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "__segment"
#: Keys the sketch tracks and reports at most, and the most cuts of one key.
TRACKED, HOT_KEYS, CUTS = 10_000, 1_000, 256

State = Callable[[str], Column]
Merge = Callable[[State, State, str], Column]


def _both(pick: Callable[[Column, Column], Column]) -> Merge:
    return lambda left, right, name: pick(left(name), right(name))


#: How a state column of two neighbouring segments becomes one.  ``first`` and
#: ``last`` take null as "nothing there": wrap values that may be null in a struct.
MERGES: dict[str, Merge] = {
    "max": _both(F.greatest),
    "min": _both(F.least),
    "sum": _both(lambda a, b: F.coalesce(a + b, a, b)),
    "any": _both(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))),
    "first": _both(F.coalesce),
    "last": _both(lambda a, b: F.coalesce(b, a)),
}


@dataclass(frozen=True)
class Cuts:
    """The times at which hot conversations are cut: ``(key, cuts)``, at most
    ``HOT_KEYS`` rows of at most ``CUTS`` times, or none."""

    rows: tuple[tuple[str, list], ...] = ()

    def assign(self, messages: DataFrame, key: str, time_col: str = "creation_time") -> DataFrame:
        """``messages`` with their segment, ascending in time within a key."""
        if not self.rows:
            return messages.withColumn(SEGMENT, F.lit(0))
        spark = messages.sparkSession
        cuts = spark.createDataFrame(list(self.rows), f"__cut_key string, __cuts array<{messages.schema[time_col].dataType.simpleString()}>")
        met = messages.join(F.broadcast(cuts), F.col(key).cast("string") == F.col("__cut_key"), "left")
        passed = F.size(F.filter("__cuts", lambda c: c <= F.col(time_col)))
        return met.withColumn(SEGMENT, F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(passed)).drop("__cut_key", "__cuts")


def hot_keys(df: DataFrame, key: str, least: int) -> list[tuple[str, int]]:
    """Keys with about ``least`` rows or more, by a frequency sketch of the key
    column.  A key with over ``4 / TRACKED`` of all rows is never missed."""
    found = df.select(F.expr(f"approx_top_k(cast(`{key}` as string), {HOT_KEYS}, {TRACKED})").alias("top")).first()["top"]
    return [(r["item"], r["count"]) for r in found or [] if r["item"] is not None and r["count"] >= least]


def cuts_of(
    df: DataFrame, key: str = "cleaned_phone", time_col: str = "creation_time", least: int = 1_000_000, rows: int = 250_000
) -> Cuts:
    """Cuts for the keys with ``least`` rows or more, a segment of about ``rows`` each."""
    hot = dict(hot_keys(df, key, least))
    if not hot:
        return Cuts()
    steps = {k: min(CUTS, max(2, -(-n // rows))) for k, n in hot.items()}
    most = max(steps.values())
    quantiles = [i / most for i in range(1, most)]
    of_hot = df.where(F.col(key).cast("string").isin(list(hot)))
    times = of_hot.groupBy(F.col(key).cast("string").alias("k")).agg(
        F.percentile_approx(time_col, quantiles, 10 * most).alias("cuts")
    )
    return Cuts(tuple((r["k"], sorted({t for t in r["cuts"] or [] if t is not None})) for r in times.collect()))  # one row per hot key


def _merged(merges: dict[str, Merge], states: DataFrame) -> Callable[[Column, Column], Column]:
    """The merge of two state structs, in the types of the ``states`` columns."""
    at = lambda s: lambda name: s[name]
    kinds = {n: states.schema[n].dataType for n in merges}
    return lambda left, right: F.struct(*[m(at(left), at(right), n).cast(kinds[n]).alias(n) for n, m in merges.items()])


def _ordered(states: DataFrame, merges: dict[str, Merge], by: list[str], order: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct(order, F.struct(*merges).alias("state"))))
    return states.groupBy(*by).agg(held.alias("__states"))


def merge_states(states: DataFrame, merges: dict[str, Merge], by: list[str], order: str) -> DataFrame:
    """One row per ``by`` from states that follow each other in ``order``."""
    grouped = _ordered(states, merges, by, order).withColumn("__states", F.transform("__states", lambda s: s["state"]))
    first, rest = F.get("__states", F.lit(0)), F.slice("__states", 2, F.size("__states"))
    one = F.when(F.size("__states") == 1, first).otherwise(F.reduce(rest, first, _merged(merges, states)))
    return grouped.select(*by, one.alias("__state")).select(*by, "__state.*")


def split_states(states: DataFrame, merges: dict[str, Merge], by: str, order: str) -> DataFrame:
    """Like :func:`merge_states`, with the last state apart: ``by``, the last
    state's ``order``, ``before`` (the merged earlier states, null if none),
    ``last`` and ``whole`` as structs."""
    grouped = _ordered(states, merges, [by], order)
    merged = _merged(merges, states)
    n = F.size("__states")
    earlier = F.transform(F.slice("__states", 1, n - 1), lambda s: s["state"])
    before = F.when(n > 1, F.reduce(F.slice(earlier, 2, n), F.get(earlier, F.lit(0)), merged))
    out = grouped.select(by, F.get("__states", n - 1).alias("__last"), before.alias("before"))
    out = out.select(by, F.col("__last")[order].alias(order), "before", F.col("__last")["state"].alias("last"))
    return out.withColumn("whole", F.when(F.col("before").isNull(), F.col("last")).otherwise(merged(F.col("before"), F.col("last"))))
