"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is 64 bits: a bit is 1 if it is set in over half of the XXH64
values (seed 42) of the text's word shingles, repeats included.  Two
fingerprints link at ``max_bits`` or fewer differing bits; documents are
grouped by what is reachable over links.

Search works on distinct fingerprints.  The 64 bits are cut into ``segments``
parts; of two fingerprints within ``max_bits``, some part differs by at most
``floor(max_bits / segments)`` bits.  Every fingerprint stores its parts in a
table keyed by part and value, and probes the table with the small Hamming
ball around each of its own parts; matches are verified on all 64 bits.  The
numbers of table rows and probes per fingerprint are fixed, so the work does
not grow with the size of a group of copies; a hot table key is split by the
adaptive skew join.  Reachability is found by random contraction
(``components``).  Tables with a row or more per fingerprint are joined by
sort-merge, whatever size they are taken for: Spark sizes a Parquet table by its
compressed files and an exploded one no larger for its probes, and would send
them whole through the driver.

Defined cases: null and empty texts have fingerprint 0, which links like any
other; a text with fewer words than the shingle length has one shingle, the
whole sequence; repeated ids give repeated rows, ``component_id`` is the
smallest non-null id of the group; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_type, keyed, rows_of, staged
from .components import components

_ROWS = 200_000  # shingles hashed at a time; bounds memory on very long texts
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """Unsigned fingerprint of a UTF-8 text (A-Z are lower-cased here)."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()  # bytes.split() cuts at \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - words_per_shingle + 1
    if n < 1:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[words_per_shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _ROWS):
        spans = zip(starts[k : k + _ROWS].tolist(), ends[k : k + _ROWS].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a (signed) long."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, fp long")


def links(fps: DataFrame, max_bits: int, segments: int = 2) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints within ``max_bits`` bits."""
    edges = [64 * k // segments for k in range(segments + 1)]
    parts = [
        F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        if high - low < 64
        else F.col("fp")
        for low, high in zip(edges, edges[1:])
    ]
    radius = max_bits // segments

    def ball(k: int) -> Column:
        """Part ``k`` and every value within ``radius`` bits of it."""
        width = range(edges[k + 1] - edges[k])
        masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(width, r)]
        return F.transform(
            F.array(*[F.lit(m).cast("long") for m in masks]),
            lambda mask: F.struct(F.lit(k).alias("part"), parts[k].bitwiseXOR(mask).alias("value")),
        )

    own = [F.struct(F.lit(k).alias("part"), p.alias("value")) for k, p in enumerate(parts)]
    near = [ball(k) for k in range(segments)]
    table = fps.select(F.col("fp").alias("u"), F.explode(F.array(*own)).alias("key")).select("u", "key.part", "key.value")
    probes = fps.select(F.col("fp").alias("v"), F.explode(F.concat(*near)).alias("key")).select("v", "key.part", "key.value")
    within = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    return table.join(probes.hint("merge"), ["part", "value"]).filter((F.col("u") < F.col("v")) & within).select("u", "v")


def near_groups(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 3,
    segments: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    by_doc = staged(fingerprints(docs, shingle, id_col, text_col), "simhash")
    fps = staged(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    label = components(links(fps, max_bits, segments))
    labelled = staged(
        fps.join(label.hint("merge"), fps["fp"] == label["node"], "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("component")
        ),
        "simhash-labels",
    )
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = labelled.join(smallest.hint("merge"), "component").select("fp", "component_id")
    return by_doc.join(of_fp.hint("merge"), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` per group: of its smallest id (of none, if no
    row has an id); of several such rows the one whose text hash is smallest."""
    rows = keyed(docs, id_col, text_col, "near-rows")
    groups = near_groups(rows.select("key", F.col(f"row.`{text_col}`").alias("text")), shingle, max_bits, id_col="key")
    return rows_of(rows, groups.filter(F.col("doc_id.n") == F.col("component_id.n")))
