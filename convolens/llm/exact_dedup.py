"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  Winners are combined in three stages, each grouping
by the digest *and* the whole normalised text, so that full content is
compared wherever rows meet:

1. locally, by map-side aggregation inside each input partition;
2. per salted group ``(digest, text, salt)``, the salt being the input
   partition modulo ``salts``: however many copies a text has, a task receives
   one row per input partition and salt;
3. globally per ``(digest, text)``, one row per salt.

The text-free winners are written once and joined back to the documents on
the digest (a hot digest is split by the adaptive skew join).  Should two
different texts share a digest, the join is on digest and whole text instead.

Defined cases: null text counts as empty, all empty texts are equal; of equal
texts the one with most code points stays, then the smallest id (null ids
last); rows that repeat both id and text share one flag; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_and_text, keyed, rows_of, staged


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _judged(
    docs: DataFrame, id_col: str, text_col: str, salts: int = 16, digest: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per document: ``doc_id, chars, text_sha256`` and its group's ``keep_id, keep_chars, group_size``."""
    base = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.char_length("text").alias("chars"),
        normalised(F.col("text")).alias("norm"),
    )
    base = base.withColumn("text_sha256", F.sha2("norm", 256))
    base = base.withColumn("digest", digest(F.col("norm")) if digest else F.col("text_sha256"))

    rank = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"))
    salted = (
        base.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "norm", "salt")
        .agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    )
    groups = salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    winner = [F.col("best.id").alias("keep_id"), (-F.col("best.c")).alias("keep_chars"), "group_size"]
    winners = staged(groups.select("digest", *winner), "exact-winners")

    shared = winners.groupBy("digest").count().filter("count > 1").select("digest")
    if shared.isEmpty():
        return base.drop("norm").join(winners, "digest")
    # different texts share a digest
    return base.join(groups.select("digest", "norm", *winner), ["digest", "norm"])


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return _judged(docs, id_col, text_col, salts, digest).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, each judged by
    itself whatever other rows share its id.  Rows that repeat both the id and
    the length of the row that stays all stay, or with ``repeats=False`` one of
    them: then every group of equal texts leaves exactly one row."""
    rows = keyed(docs, id_col, text_col, "exact-rows")
    judged = _judged(rows.select("key", F.col(f"row.`{text_col}`").alias("text")), "key", "text")
    alike = F.lit(True)
    for field in ("missing", "id") if repeats else ("n",):
        alike &= F.col(f"doc_id.{field}").eqNullSafe(F.col(f"keep_id.{field}"))
    return rows_of(rows, judged.filter(alike & (F.col("chars") == F.col("keep_chars"))))
