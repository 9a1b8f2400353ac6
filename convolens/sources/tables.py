"""Reading the driver's parquet tables and the package's own input schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Canonical message table (one row per message).  ``src_ord`` is the source
# order, used only to break ties between equal creation times.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("cleaned_phone", T.StringType(), False),
    T.StructField("src_ord", T.IntegerType(), True),
    T.StructField("creation_time", T.TimestampType(), True),
    T.StructField("msg_from", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (parquet: pushdown and pruning apply)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
