"""Line deduplication across documents, returned as keep bitmaps.

A text is split at ``\\n``; a line's key is the line with every character of
``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased.  A key of at
least ``min_chars`` code points that at least ``min_docs`` documents hold loses
all its lines except in the document with the largest id that holds it.

Method, in DataFrame functions only:

1. every line becomes a 128-bit hash of its key with document and position;
   these rows are range-partitioned by (hash, document) and sorted by (hash,
   document, position).  The document is part of the range, so a line that a
   third of all documents share is spread over many partitions;
2. the sorted rows are streamed: a window over (hash, document) marks the first
   occurrence in a document.  First occurrences are summed per hash, map-side
   first, into the number of documents and the largest id;
3. the rows of repeated hashes, by a join that the adaptive skew join can
   split, give the dropped positions, and these a bitmap per document.

What moves is hashes, ids, positions and bitmaps.  A bitmap is stored by its
64-line words, in order; words of which nothing is dropped are left out, so a
document without repeated lines has an empty one.  ``kept_lines`` applies a
bitmap to a text.

Defined cases: a null or empty text is one empty line, which is too short to
be dropped; every row is a document of its own, rows that share an id all keep
a line whose largest id is theirs; a null id is the least of all, and where
only null ids hold a key its lines stay; a repeated line in the keeping
document stays each time; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, staged, text_of

WORD = 64  # lines of a bitmap word


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t1, t2, text``: rows of equal id and text have equal bitmaps,
    so the id and a 128-bit hash of the text name a row well enough."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """A row per line that is long enough, ``first`` at its first occurrence in a document."""
    lines = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "t1", "t2", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    keys = lines.filter(F.char_length(F.btrim("line", F.lit(SPACES))) >= min_chars).withColumn("key", line_key(F.col("line")))
    hashed = keys.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "t1", "t2", "pos"
    )
    order = ["h1", "h2", "doc_id", "row"]
    streamed = hashed.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    nth = F.row_number().over(Window.partitionBy(*order).orderBy("pos"))
    return streamed.select("h1", "h2", "doc_id", "t1", "t2", "pos", (nth == 1).alias("first"))


def line_bitmaps(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, t1, t2, dropped`` for each document that loses a line: ``t1``
    and ``t2`` hash its text, ``dropped`` is an array of ``(word, bits)``,
    ascending, where bit ``b`` of word ``w`` stands for line ``64 w + b``."""
    lines = staged(_lines(_named(docs, id_col, text_col), min_chars), "lines")
    repeated = staged(
        lines.filter("first")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper"),
        "repeated-lines",
    )
    lost = lines.join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = (
        lost.withColumn("word", F.shiftright("pos", 6))
        .groupBy("doc_id", "t1", "t2", "word")
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    )
    return staged(
        words.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped")),
        "line-bitmaps",
    )


def dropped_lines(bitmap: Column) -> Column:
    """The line numbers of a bitmap, ascending."""
    of_word = lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(w["bits"], b) == 1), lambda b: w["word"] * WORD + b
    )
    return F.flatten(F.transform(bitmap, of_word))


def kept_lines(text: Column, bitmap: Column) -> Column:
    """The text without the lines of the bitmap (null or empty: the whole text).

    The kept lines are the stretches between dropped ones, so the work is
    proportional to the lines, however many are dropped."""
    lines, lost = F.split(text, "\n"), dropped_lines(bitmap)
    state = F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), lost, F.array(F.size(lines))).alias("cuts"))

    def joined(s: Column) -> Column:
        stretch = lambda i: F.slice(
            s["lines"], F.get(s["cuts"], i) + 2, F.get(s["cuts"], i + 1) - F.get(s["cuts"], i) - 1
        )
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["cuts"]) - 2), stretch)), "\n")

    # one element: the split and the cuts are computed once per text
    return F.when(F.size(bitmap) > 0, F.transform(F.array(state), joined)[0]).otherwise(text)


def line_dedup(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, text, dropped`` with the bitmap (null: every line stays)."""
    rows, bitmaps = _named(docs, id_col, text_col), line_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    of = bitmaps.select(F.col("doc_id").alias("id"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "dropped")
    same = rows["doc_id"].eqNullSafe(of["id"]) & (rows["t1"] == of["u1"]) & (rows["t2"] == of["u2"])
    return rows.join(of, same, "left").select("doc_id", "text", "dropped")


def line_counts(judged: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of ``line_dedup`` rows."""
    dropped = F.aggregate("dropped", F.lit(0), lambda n, w: n + F.bit_count(w["bits"]))
    return judged.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_lines(F.col("text"), F.col("dropped")), 256).alias("kept_sha256"),
    )
