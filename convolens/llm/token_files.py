"""Token-id files with bit-plane shuffling.

Layout.  Documents are range-partitioned and sorted by id; each partition is
one run of ids, cut into blocks of ``block`` ids (the last one shorter).  A
block is one chunk row of a Parquet table (so commit, listing and remote
stores are Spark's):

``part, chunk``       place of the block: partition, then block number
``offset, n_ids``     ids of the partition before the block, ids in the block
``first_doc``         ordinal, inside the partition, of the first document
``doc_ids, lengths``  the documents with ids in the block, and how many; a
                      document that crosses a border is in both blocks
``payload``           header (magic, version, plane kind, id width, id count,
                      plane sizes), then the planes, each a zstd frame

The block's ids are transposed: plane ``k`` holds byte (or bit) ``k`` of every
id.  Reading needs no order: a block decodes on its own, and the place of a
document follows from the chunk index alone.

Defined cases: a null text counts as empty and still gets its end id; a null
id sorts first; repeated ids stay separate documents, ordered by text; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolens.session import checkpoint_dir, ship_package

from .common import id_and_text, id_type
from .vocab import encoder

MAGIC, VERSION = b"TPLN", 1
_HEAD = struct.Struct("<4sBBBxII")  # magic, version, kind, id width, ids, planes
KINDS = {"byte": 0, "bit": 1}


def pack_block(ids: np.ndarray, kind: str = "byte", level: int = 3) -> bytes:
    """One block of unsigned ids as header and compressed planes."""
    import zstandard

    width = ids.dtype.itemsize
    planes = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(planes, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = planes.T
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    head = _HEAD.pack(MAGIC, VERSION, KINDS[kind], width, len(ids), len(frames))
    return head + struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def unpack_block(payload: bytes) -> np.ndarray:
    """The ids of a block."""
    import zstandard

    magic, version, kind, width, n, count = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token block of this version")
    sizes = struct.unpack_from(f"<{count}I", payload, _HEAD.size)
    at = _HEAD.size + 4 * count
    press = zstandard.ZstdDecompressor()
    planes = []
    for size in sizes:
        planes.append(np.frombuffer(press.decompress(payload[at : at + size]), np.uint8))
        at += size
    if not n:
        return np.zeros(0, f"<u{width}")
    rows = np.stack(planes)
    if kind == KINDS["bit"]:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).reshape(-1).view(f"<u{width}")


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    path: str | None = None,
    block: int = 1 << 16,
    kind: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode, append ``end_id`` to each document and write the files; returns
    their folder (one of its own under the shared folder if none is given)."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/llm/tokens-{uuid.uuid4().hex}"
    rows = id_and_text(docs, id_col, text_col)
    of_id = id_type(rows)
    # a hot id is cut at its texts, and equal rows anywhere: a task gets a share of the rows
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("doc_id", F.substring("text", 1, 32), "n")
    ordered = ranged.sortWithinPartitions("doc_id", "text", "n").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        held, held_ids, held_lengths = [], [], []
        n = chunk = doc = first = 0

        def flush(kind_of_id: pa.DataType) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), enc.dtype)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([chunk], pa.int64()),
                    pa.array([chunk * block], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([first], pa.int64()),
                    pa.array([held_ids], pa.list_(kind_of_id)),
                    pa.array([held_lengths], pa.list_(pa.int64())),
                    pa.array([pack_block(ids, kind)], pa.binary()),
                ],
                ["part", "chunk", "offset", "n_ids", "first_doc", "doc_ids", "lengths", "payload"],
            )

        kind_of_id = None
        for batch in batches:
            kind_of_id = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                data, key = enc.packed(text.as_py()) + end, key.as_py()
                at, size = 0, len(data) // width
                while at < size:
                    take = min(block - n, size - at)
                    if not held:
                        first = doc
                    held.append(data[at * width : (at + take) * width])
                    held_ids.append(key)
                    held_lengths.append(take)
                    n, at = n + take, at + take
                    if n == block:
                        yield flush(kind_of_id)
                        held, held_ids, held_lengths = [], [], []
                        n, chunk = 0, chunk + 1
                doc += 1
        if held:
            yield flush(kind_of_id)

    chunks = ordered.mapInArrow(
        run,
        f"part int, chunk long, offset long, n_ids long, first_doc long, doc_ids array<{of_id}>, "
        "lengths array<long>, payload binary",
    )
    chunks.write.option("compression", "uncompressed").parquet(path)
    return path


def _pieces(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """One row per document and block, decoded from the files."""
    ship_package(spark)
    files = spark.read.parquet(path)
    of_id = files.schema["doc_ids"].dataType.elementType.simpleString()
    rows = files.select("part", "chunk", "offset", "first_doc", "doc_ids", "lengths", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, chunk, offset, first = (batch.column(c)[i].as_py() for c in range(4))
                keys = batch.column(4)[i].values
                lengths = np.array(batch.column(5)[i].as_py(), np.int64)
                data = unpack_block(batch.column(6)[i].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                cuts = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                k = len(cuts)
                columns = [
                    pa.array(np.full(k, part, np.int32)),
                    pa.array(np.full(k, chunk, np.int64)),
                    pa.array(first + np.arange(k, dtype=np.int64)),
                    keys,
                    pa.array(offset + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                ]
                names = ["part", "chunk", "doc", "doc_id", "at", "n", "crc"]
                if with_ids:
                    columns.append(pa.array(cuts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, chunk long, doc long, doc_id {of_id}, at long, n long, crc long"
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def _part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids in all partitions before each one: a running sum over one row per
    partition of the files."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("part_start"))


# crc32(a + b) from crc32(a), crc32(b) and len(b): multiply by x^(8 len b) in
# the ring of polynomials modulo the reflected CRC-32 polynomial.
_POLY = 0xEDB88320  # fixed value


def _times(a: int, b: int) -> int:
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc_join(first: int, second: int, second_bytes: int) -> int:
    power, square, n = 1 << 31, 1 << 23, second_bytes  # x^0, x^8
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, in the files' order of ``start``: ``doc_id, start,
    n_tokens, ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned
    32-bit)."""
    pieces = _pieces(spark, path, with_ids)
    fields = ["chunk", "n", "crc"] + (["ids"] if with_ids else [])
    docs = pieces.groupBy("part", "doc").agg(
        F.min("doc_id").alias("doc_id"),
        F.min("at").alias("start"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"),
    )

    @F.pandas_udf("long")
    def joined(sizes, crcs):  # null but for documents that cross a border
        import pandas as pd

        out = []
        for n, c in zip(sizes, crcs):
            crc = 0
            for size, piece in zip(n, c) if n is not None else ():
                crc = crc_join(crc, int(piece), 4 * int(size))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    crosses = F.size("pieces") > 1
    pieced = joined(F.when(crosses, F.col("pieces.n")), F.when(crosses, F.col("pieces.crc")))
    columns = [
        "doc_id",
        (F.col("part_start") + F.col("start")).alias("start"),
        "n_tokens",
        F.when(crosses, pieced).otherwise(F.col("pieces.crc")[0]).alias("ids_crc32"),
    ]
    if with_ids:
        columns.append(F.aggregate("pieces.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
    return docs.join(_part_starts(spark, path), "part").select(*columns)
