"""Running sums along conversations, without a task per conversation.

The messages are range-partitioned by (key, order) and sorted, so a partition
is a stretch of the sorted table and a long conversation lies in several.  The
stretches are written once with their number; a running sum is then a window
over (stretch, key), at most one partition's rows, plus the totals of the
conversation's earlier stretches, one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolens.sources.stage import staged

PLACE = "__place"
_ROWS = 33  # bits of monotonically_increasing_id that number the rows of a partition


def with_prefix(
    messages: DataFrame, key: str, order: Column, measures: dict[str, Column], partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``messages`` with ``PLACE`` (ascending in key and order) and, for every
    measure, its sum over the earlier rows of the conversation; and the sums of
    whole conversations, one row per key.  Measures are never null."""
    ranged = [F.col(key), F.col("__order")]
    rows = messages.withColumns({"__order": order, **{f"__m_{n}": c for n, c in measures.items()}})
    rows = rows.repartitionByRange(partitions, *ranged) if partitions else rows.repartitionByRange(*ranged)
    rows = staged(rows.sortWithinPartitions(*ranged).withColumn(PLACE, F.monotonically_increasing_id()).drop("__order"), "ranged")
    rows = rows.withColumn("__stretch", F.shiftright(F.col(PLACE), _ROWS))

    totals = rows.groupBy(F.col(key).alias("__key"), F.col("__stretch").alias("__s")).agg(
        *[F.sum(f"__m_{n}").alias(f"__t_{n}") for n in measures]
    )
    earlier = Window.partitionBy("__key").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"__b_{n}": F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)) for n in measures}
    offsets = totals.withColumns(before).drop(*[f"__t_{n}" for n in measures])

    within = Window.partitionBy("__stretch", key).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumns({n: F.coalesce(F.sum(f"__m_{n}").over(within), F.lit(0)) for n in measures})
    met = running.join(offsets, (running["__stretch"] == offsets["__s"]) & running[key].eqNullSafe(offsets["__key"]))
    whole = met.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in measures})
    sums = totals.groupBy(F.col("__key").alias(key)).agg(*[F.sum(f"__t_{n}").alias(n) for n in measures])
    return whole.select(*messages.columns, PLACE, *measures), sums
