"""Benchmark decontamination by winnowing.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased.  A window is ``span`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window.  A document word is hit if
it lies inside an occurrence of a window.

Winnowing keeps, of every ``span - k + 1`` consecutive k-gram hashes, the
least, in the benchmark and in the documents alike.  A window that occurs in
a document therefore shares its kept k-gram with it: no window is missed.
Kept k-grams of a document that the benchmark also keeps are extended to the
windows around them, whose hashes are looked up and whose words are then
compared one by one.  Shorter items are winnowed likewise with their own
length as the span.

The windows of the benchmark, with their kept k-gram, are a table that a Spark
job builds and writes; nothing of the benchmark is read on the driver.  If the
table is at most ``broadcast_windows`` rows and ``broadcast_bytes`` of text, it
is sent to the tasks, and the documents are judged where they are read, without
a shuffle.  Otherwise it is joined: documents' kept k-grams meet the table's,
the documents that share one are extended around it, and the windows found there
are joined with the table by hash and words.  The number of passes over the
documents does not depend on the benchmark.

Defined cases: null and empty texts have no words; items without a word are
ignored; rows that repeat an item id are one item; null item ids count under
the id ``null``; repeated document ids give one row each; an empty benchmark
hits nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.session import ship_package

from .common import id_and_text, id_type, keep_rows, staged, text_of

_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MEMO = 500_000
_WINDOWS = 20_000  # of an item or a document that are handled at a time
#: The words of a text, as a pattern.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Hashes(dict):
    """64-bit hash of a word, remembered; the newer half goes when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            for w in list(self)[_MEMO // 2 :]:
                del self[w]
        out = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


_HASHES = _Hashes()


def word_hashes(text: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, text), np.uint64, len(text))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : i + n]
    out ^= out >> np.uint64(31)
    return out * _BASE


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Least hash of each run of ``width`` k-gram hashes (of all, if fewer)."""
    n = len(g) - width + 1
    if n <= 0:
        return g[:0]
    out = g[:n].copy()
    for i in range(1, width):
        np.minimum(out, g[i : i + n], out=out)
    return out


def _shape(span: int, gram: int) -> tuple[int, int]:
    k = min(gram, span)
    return k, span - k + 1


def item_windows(text: bytes, span: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """``(length, kept k-grams, hashes, windows)`` of an item, some windows at a time."""
    w = words(text)
    length = min(span, len(w))
    if not length:
        return
    k, width = _shape(length, gram)
    for first in range(0, len(w) - length + 1, _WINDOWS):
        own = w[first : first + _WINDOWS + length - 1]
        h = word_hashes(own)
        windows = [b" ".join(own[i : i + length]) for i in range(len(own) - length + 1)]
        yield length, winnow(grams(h, k), width), grams(h, length), windows


class Index:
    """Winnowed k-grams and windows of a bounded benchmark, by window length,
    from rows ``length, kept, whole, window, item`` (hashes unsigned)."""

    def __init__(self, rows: list[tuple[int, int, int, bytes, str]], gram: int) -> None:
        self.by_span: dict[int, tuple] = {}
        self.gram = gram
        found: dict[int, dict[bytes, tuple]] = {}
        for length, kept, whole, window, item in rows:
            found.setdefault(length, {}).setdefault(window, (kept, whole, set()))[2].add(item)
        for length, windows in found.items():
            keys = np.array([whole for _, whole, _ in windows.values()], np.uint64)
            kept = np.array([least for least, _, _ in windows.values()], np.uint64)
            order = np.argsort(keys, kind="stable")
            listed = [(tuple(w.split(b" ")), owners) for w, (_, _, owners) in windows.items()]
            self.by_span[length] = (np.unique(kept), keys[order], [listed[i] for i in order])

    def hits(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, their hit flags, and the items that occur."""
        w = words(text)
        hit = np.zeros(len(w), bool)
        items: set[str] = set()
        if not w or not self.by_span:
            return len(w), hit, items
        h = word_hashes(w)
        for length, (kept, keys, windows) in self.by_span.items():
            k, width = _shape(length, self.gram)
            least = winnow(grams(h, k), width)  # of the windows that start at each word
            at = np.searchsorted(kept, least)
            starts = np.flatnonzero(kept[np.minimum(at, len(kept) - 1)] == least)
            if not len(starts):
                continue
            whole = np.zeros(len(starts), np.uint64)
            for i in range(length):
                whole = whole * _BASE + h[starts + i]
            whole ^= whole >> np.uint64(31)
            whole *= _BASE
            low, high = np.searchsorted(keys, whole, "left"), np.searchsorted(keys, whole, "right")
            for s, a, b in zip(starts[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                here = tuple(w[s : s + length])
                for window, owners in windows[a:b]:
                    if window == here:
                        hit[s : s + length] = True
                        items |= owners
        return len(w), hit, items


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def benchmark_windows(benchmark: DataFrame, span: int, gram: int, item_col: str, text_col: str) -> DataFrame:
    """The written table ``length, kept, whole, window, item``: a row per window of an item."""
    ship_package(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for length, kept, whole, windows in item_windows(text.as_py().encode(), span, gram):
                    n = len(windows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, length, np.int32)), _signed(kept), _signed(whole), pa.array(windows, pa.binary()),
                         pa.array([item] * n, pa.string())],
                        ["length", "kept", "whole", "window", "item"],
                    )

    return staged(rows.mapInArrow(run, "length int, kept long, whole long, window binary, item string"), "windows")


def _bounded_index(windows: DataFrame, gram: int, most: int, most_bytes: int) -> Index | None:
    """The index of a table that is small enough to be sent, else None."""
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0)).alias("b")).first()
    if size["n"] > most or size["b"] > most_bytes:
        return None
    unsigned = lambda h: h & 0xFFFFFFFFFFFFFFFF
    return Index([(r.length, unsigned(r.kept), unsigned(r.whole), bytes(r.window), r.item) for r in windows.collect()], gram)


def _named(text: str) -> list[Column]:
    """A 128-bit name of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _found(rows: DataFrame, windows: DataFrame, gram: int) -> DataFrame:
    """``t1, t2, start, length, whole, window`` of the benchmark windows that
    occur in the texts of ``rows(t1, t2, text)``, by joining fingerprints."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``span``

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                h = word_hashes(words(text.as_py().encode()))
                own = [(n, np.unique(winnow(grams(h, _shape(n, gram)[0]), _shape(n, gram)[1]))) for n in lengths]
                kept = np.concatenate([k for _, k in own])
                at = pa.array(np.full(len(kept), i))
                sizes = pa.array(np.repeat(np.array([n for n, _ in own], np.int32), [len(k) for _, k in own]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), sizes, _signed(kept)], ["t1", "t2", "length", "kept"]
                )

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text, shared in zip(*(batch.column(c).to_pylist() for c in range(4))):
                w = words(text.encode())
                h, rows = word_hashes(w), []
                for n in sorted({s["length"] for s in shared}):
                    kept = np.array([s["kept"] for s in shared if s["length"] == n], np.int64).view(np.uint64)
                    k, width = _shape(n, gram)
                    whole = grams(h, n).view(np.int64).tolist()
                    starts = np.flatnonzero(np.isin(winnow(grams(h, k), width), kept)).tolist()
                    rows += [(t1, t2, i, n, whole[i], b" ".join(w[i : i + n])) for i in starts]
                for first in range(0, len(rows), _WINDOWS):
                    columns = list(zip(*rows[first : first + _WINDOWS]))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds)], ["t1", "t2", "start", "length", "whole", "window"]
                    )

    ours = rows.mapInArrow(prints, "t1 long, t2 long, length int, kept long")
    met = ours.join(windows.select("length", "kept").distinct(), ["length", "kept"], "left_semi")
    shared = staged(met.groupBy("t1", "t2").agg(F.collect_set(F.struct("length", "kept")).alias("shared")), "shared-grams")
    near = rows.join(shared, ["t1", "t2"]).select("t1", "t2", "text", "shared")
    schema = "t1 long, t2 long, start long, length int, whole long, window binary"
    whole = windows.select("length", "whole", "window").distinct()
    return staged(near.mapInArrow(extended, schema).join(whole, ["length", "whole", "window"], "left_semi").distinct(), "found-windows")


def _merged(spans: Column) -> Column:
    """Spans in ascending order as disjoint ones."""

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))[1] >= s[0]), grown).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<array<long>>"), step)


def _joined_spans(rows: DataFrame, windows: DataFrame, gram: int) -> DataFrame:
    """``hit_spans`` by joins."""
    named = rows.select("doc_id", *_named("text"), "text")
    found = _found(named.select("t1", "t2", "text"), windows, gram)
    spans = found.groupBy("t1", "t2").agg(
        F.array_sort(F.collect_set(F.array(F.col("start"), F.col("start") + F.col("length")))).alias("spans")
    )
    owners = found.select("t1", "t2", "length", "whole", "window").distinct().join(windows, ["length", "whole", "window"])
    items = owners.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = staged(spans.join(items, ["t1", "t2"]).withColumn("spans", _merged(F.col("spans"))), "text-hits")
    counted = named.select("doc_id", "t1", "t2", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    return counted.join(hits, ["t1", "t2"], "left").select(
        "doc_id", "n_words",
        F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hit_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 10,
    gram: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = 100_000,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document: ``doc_id, n_words``, ``spans`` (array of start,
    end in words, disjoint, ascending) and ``items`` (sorted ids as strings)."""
    rows = id_and_text(docs, id_col, text_col)
    windows = benchmark_windows(benchmark, span, gram, item_col, item_text_col)
    bounded = _bounded_index(windows, gram, broadcast_windows, broadcast_bytes)
    if bounded is None:
        return _joined_spans(rows, windows, gram)
    index = docs.sparkSession.sparkContext.broadcast(bounded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, owners = [], [], []
            for text in batch.column(1):
                n, hit, found = index.value.hits(text.as_py().encode())
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                counts.append(n)
                spans.append(edges.reshape(-1, 2).tolist())
                owners.append(sorted(found))
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array(owners, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, n_words long, spans array<array<long>>, items array<string>")


def contamination(spans: DataFrame) -> DataFrame:
    """The per-document figures of ``hit_spans``' rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return spans.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 10,
    gram: int = 5,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = 100_000,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their own columns."""
    windows = benchmark_windows(benchmark, span, gram, item_col, item_text_col)
    bounded = _bounded_index(windows, gram, broadcast_windows, broadcast_bytes)
    if bounded is not None:
        index = docs.sparkSession.sparkContext.broadcast(bounded)
        return keep_rows(docs, text_col, lambda: lambda text: not index.value.hits(text.encode())[1].any())
    ship_package(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, text_of(text_col).alias("text")).select("row", *_named("text"), "text")
    hit = _found(rows.select("t1", "t2", "text"), windows, gram).select("t1", "t2").distinct()
    return rows.join(hit, ["t1", "t2"], "left_anti").select("row.*")
