"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.session import checkpoint_dir, ship_package

#: Characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove a query's shuffle files as soon as its result is written."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: a later stage re-reads the table instead of recomputing
    it, also after executors were lost.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` only: other columns, whatever their names, stay out
    of an operator's work.  The package is made importable on executors."""
    ship_package(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def id_type(df: DataFrame, id_col: str = "doc_id") -> str:
    return df.schema[id_col].dataType.simpleString()


def keyed(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` written once as ``row``, its columns, and ``key``, a struct of its
    own for every row: by id (null ids last), then by text, then any order."""
    ship_package(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.struct(
        F.col(id_col).isNull().alias("missing"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_of(text_col)).alias("text"),
        F.monotonically_increasing_id().alias("n"),
    )
    return staged(docs.select(whole.alias("row"), key.alias("key")), name)


def rows_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a ``keyed`` table, as they were, whose key is the ``doc_id`` of ``keys``."""
    kept = keys.select(F.col("doc_id.n").alias("n"))
    return rows.join(kept, rows["key.n"] == kept["n"], "left_semi").select("row.*")


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes of text, or one row."""
    first, held = 0, 0
    for i, own in enumerate(pc.binary_length(texts).to_pylist()):
        if i > first and held + (own or 0) > size:
            yield first, i
            first, held = i, 0
        held += own or 0
    if first < len(texts):
        yield first, len(texts)


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept.  ``judge`` makes
    the decision function, once per task; null texts count as empty.  Rows are
    judged where they are read, one by one: nothing is shuffled."""
    ship_package(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            mask = pa.array([keep(t.as_py()) for t in batch.column(0)], pa.bool_())
            yield pa.RecordBatch.from_struct_array(batch.column(1).filter(mask))

    return docs.select(text_of(text_col).alias("text"), whole).mapInArrow(run, docs.schema)
