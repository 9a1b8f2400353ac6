"""Encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash over the last 32 bytes meets a
condition, so equal passages give equal chunks wherever they stand.

1. Every chunk is named by a 128-bit BLAKE2b digest of its bytes; names are
   counted (text does not move).
2. Of each name seen more than once the text is fetched once and encoded once;
   these ids form a table keyed by digest.
3. Documents meet the ids of their shared chunks in one exchange.  Rows are
   sorted by document and position and read as a stream: chunks without an
   entry are encoded on the spot, the others take the table's ids.
4. Chunk joins are repaired: what stands between the last white space of one
   chunk and the first of the next is encoded again as a whole and replaces
   the outer ids of both.  The replaced ids must agree with the encoding of
   the outer text alone; where they do not, the whole document is encoded.

Tokenizers whose words are not independent of their neighbours are never cut:
their documents are encoded whole.

Defined cases: null text counts as empty and gives no ids; rows that repeat
an id and a text give the same result each; repeated ids with other texts are
documents of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_and_text, id_type, staged
from .vocab import Encoder, encoder

#: Smallest, mean (a power of two) and largest chunk in bytes.
SMALLEST, MEAN, LARGEST = 128, 512, 8192
_OUT_BYTES = 8 << 20  # per Arrow batch that leaves a task
_GEAR = np.array([int.from_bytes(blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)
_SPACE = re.compile(f"[{SPACES}]")


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text, all at code point borders."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    rolling = _GEAR[raw]
    for shift in (1, 2, 4, 8, 16):  # the hash of 2w bytes from two of w bytes
        grown = rolling.copy()
        grown[shift:] += rolling[:-shift] << np.uint32(shift)
        rolling = grown
    # Only the top bits depend on all 32 bytes.
    hits = np.flatnonzero(rolling >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + 1
    out, start = [], 0

    def border(at: int) -> int:
        while at < n and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    for hit in [*hits.tolist(), n]:
        while hit - start > LARGEST:
            start = border(start + LARGEST)
            out.append(start)
        end = border(hit)
        if end > start and (end - start >= SMALLEST or end == n):
            out.append(end)
            start = end
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _name(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


class _Out:
    """Rows collected into Arrow batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]) -> None:
        self._schema = pa.schema(list(zip(names, types)))
        self._columns: list[list] = [[] for _ in names]
        self._bytes = 0

    def add(self, *values) -> None:
        for column, v in zip(self._columns, values):
            column.append(v)
            self._bytes += 16 + (len(v) if isinstance(v, (bytes, str)) else 0)

    def full(self) -> bool:
        return self._bytes >= _OUT_BYTES

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(self._columns, self._schema.types)]
        self._columns, self._bytes = [[] for _ in arrays], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self._schema)


def assemble(enc: Encoder, data: bytes, shared: dict[int, bytes]) -> bytes:
    """Packed ids of a whole text from its chunks; ``shared`` holds packed ids
    by chunk position."""
    if not enc.by_words:
        return enc.packed(data.decode())
    out: list[bytes] = []
    joint: list[str] = []  # text since the last white space
    for k, chunk in enumerate(chunks(data)):
        text = chunk.decode()
        first = _SPACE.search(text)
        if first is None:
            joint.append(text)
            continue
        head, tail = text[: first.start()], text[max(map(text.rfind, SPACES)) + 1 :]
        ids = shared.get(k)
        if ids is None:
            ids = enc.packed(text)
        left, right = enc.packed(head), enc.packed(tail)
        if not (ids.startswith(left) and ids.endswith(right) and len(ids) >= len(left) + len(right)):
            return enc.packed(data.decode())
        out.append(enc.packed("".join(joint) + head))
        out.append(ids[len(left) : len(ids) - len(right)])
        joint = [tail]
    out.append(enc.packed("".join(joint)))
    return b"".join(out)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) ``, decoded`` per row."""
    rows = id_and_text(docs, id_col, text_col)
    of_id = id_type(rows)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Out(["doc_id", "text_name", "pos", "name"], [batch.schema.field(0).type, pa.binary(), pa.int32(), pa.binary()])
            met: set = set()  # equal rows have equal places: once a batch
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().encode()
                whole = _name(data)
                if (key, whole) in met:
                    continue
                met.add((key, whole))
                for k, chunk in enumerate(chunks(data)):
                    out.add(key, whole, k, _name(chunk))
                if out.full():
                    yield out.take()
            yield out.take()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()  # local reuse first: copies in one batch leave once
            out = _Out(["name", "chunk"], [pa.binary(), pa.binary()])
            for text in batch.column(0):
                for chunk in chunks(text.as_py().encode()):
                    name = _name(chunk)
                    if name not in seen:
                        seen.add(name)
                        out.add(name, chunk)
                if out.full():
                    yield out.take()
            yield out.take()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids = [enc.packed(c.as_py().decode()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["name", "ids"])

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows: dict[tuple, list] = {}  # equal rows leave once, with their number
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().encode()
                row = rows.setdefault((key, _name(data)), [0, data])
                row[0] += 1
            keys, held = list(rows), list(rows.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in keys], batch.schema.field(0).type),
                    pa.array([name for _, name in keys], pa.binary()),
                    pa.array([-copies for copies, _ in held], pa.int32()),
                    pa.array([small.compress(data) for _, data in held], pa.binary()),
                ],
                ["doc_id", "text_name", "pos", "payload"],
            )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer)
        large = zstandard.ZstdDecompressor()
        key, copies, data, shared, out = None, 0, b"", {}, None

        def close() -> Iterator[pa.RecordBatch]:
            if copies:
                ids = np.frombuffer(assemble(enc, data, shared), enc.dtype)
                row = (key[0], ids.astype("<u4").tobytes(), enc.decode(ids))
                for _ in range(copies):
                    out.add(*row)
                    if out.full():
                        yield out.take()

        for batch in batches:
            out = out or _Out(["doc_id", "ids", "decoded"], [batch.schema.field(0).type, pa.binary(), pa.string()])
            ids, marks, positions, payloads = batch.columns
            for own, mark, pos, payload in zip(ids.to_pylist(), marks.to_pylist(), positions.to_pylist(), payloads):
                if (own, mark) != key:
                    yield from close()
                    key, copies, data, shared = (own, mark), 0, b"", {}
                if pos < 0:
                    if not copies:
                        data = large.decompress(payload.as_py())
                    copies -= pos
                else:
                    shared[pos] = payload.as_py()
        if out is not None:
            yield from close()
            yield out.take()

    # ``pos``: a chunk's place, or minus the number of equal rows whose text this is
    places = staged(
        rows.mapInArrow(names, f"doc_id {of_id}, text_name binary, pos int, name binary"), "chunk-places"
    )
    shared_names = staged(places.groupBy("name").count().filter("count > 1").select("name"), "chunk-shared")
    fetched = (
        rows.select("text")
        .mapInArrow(texts, "name binary, chunk binary")
        .join(shared_names, "name", "left_semi")
        .groupBy("name")
        .agg(F.first("chunk").alias("chunk"))
    )
    table = staged(fetched.mapInArrow(encode, "name binary, ids binary"), "chunk-ids")
    met = places.join(table, "name").select("doc_id", "text_name", "pos", F.col("ids").alias("payload"))
    texts_out = rows.mapInArrow(press, f"doc_id {of_id}, text_name binary, pos int, payload binary")
    return (
        texts_out.unionByName(met)
        .repartition("text_name", "doc_id")
        .sortWithinPartitions("text_name", "doc_id", "pos")
        .mapInArrow(finish, f"doc_id {of_id}, ids binary, decoded string")
    )


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of ``encode_decode``'s rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
