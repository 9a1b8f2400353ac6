"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from convolens.session import checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: what
    follows reads the table, also after executors were lost, and every use of
    it sees the same rows in the same partitions."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
