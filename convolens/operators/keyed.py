"""Per-key aggregates that are joined back to their rows.

``keyed_aggregate`` groups by ``(xxhash64(key), key)`` rather than ``key``.
The result is the same table, but it is partitioned differently from the join
on ``key``, so the planner adds an ordinary requirements shuffle of this
small table (one row per key).  That keeps the following join in the shape
(shuffle on both sides) that AQE's skew handling can split when one key holds
a large share of the rows; grouping by ``key`` alone would let the join reuse
the aggregate's partitioning and rule the split out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_aggregate(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    bucket = F.xxhash64(F.col(key)).alias("__bucket")
    aggs = aggs or (F.count(F.lit(1)).alias("__n"),)
    return df.groupBy(bucket, F.col(key)).agg(*aggs).drop("__bucket")
