"""How far the sources of a language differ in their words.

For every language the terms held by at least ``min_docs`` of its documents
are kept.  A group is a language with one source.  With ``c`` occurrences of a
term, ``N`` occurrences of all kept terms and ``V`` kept terms, a term has
``p = 1 + floor(10^9 (c + 1) / (N + V))`` in a group, and likewise in the whole
language; ``f(p, q) = floor((p - q)^2 / q)``.  A group's divergence from another
source is the sum of ``f`` over all kept terms; its own terms are those that
stand above the language, by ``f``.

Method: single-pass in-memory indexing.

1. A task fills a block of postings (group and term to occurrences and
   documents) until ``block`` entries are held, then spills a run sorted by
   term, cut by hash shard into pieces (compressed, with their first term).
2. Pieces go to their shard, ordered by first term.  The shard's task merges
   them with a heap of the open pieces; a piece is opened when the merge
   reaches its first term.  A term comes out once, whole.
3. Sums over all kept terms are not formed pair by pair.  A pair of groups is
   first charged as if no term had both: a sum over the distinct counts of each
   group.  The terms that several groups hold are then streamed in term order,
   and each pair of holders gets the difference
   ``f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)`` (index 0: count zero) added in a
   bounded accumulator, whose partial sums Spark adds up.

Everything is integer: products in decimals, partial sums modulo 2^64 (the true
sums are below 2^63 for fewer than 10^8 kept terms a language).

Defined cases: null text, language and source count as ``''``; a group without
kept terms takes part with counts of zero; a language without kept terms gives
divergences of 0 and no terms; repeated rows and ids count each time; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolens.session import ship_package

from .common import slices, staged, text_of

SCALE = 1_000_000_000
_CHUNK = 1 << 20  # bytes of a text that are split into terms at a time
_PIECE = 20_000  # entries of a piece
_PAIRS = 1_000_000  # pairs of holders computed at a time
_SALTS = 16

#: A byte of a term as it is (A-Z lower-cased), any other byte as a space.
_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a long UTF-8 text, in lists of bounded length."""
    at = 0
    while at < len(text):
        end = at + _CHUNK
        data = text[at:end].translate(_TERM_BYTES)
        if end < len(text):
            cut = data.rfind(b" ") + 1
            while not cut and end < len(text):  # a long term
                more = text[end : end + _CHUNK].translate(_TERM_BYTES)
                end += _CHUNK
                cut = len(data) + more.rfind(b" ") + 1 if b" " in more else 0
                data += more
            data = data[:cut] if cut else data
        yield data.split()
        at += len(data)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of each term occurrence in some texts: the text's number; the term."""
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(_TERM_BYTES))
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, plain, offset=texts.offset))
    text, words = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy()), lists.flatten()
    found = pc.greater(pc.binary_length(words), 0)
    return text[found.to_numpy(zero_copy_only=False)], words.filter(found)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], *[np.add.reduceat(v[order], first) if len(key) else v for v in values]


class Block:
    """Postings ``(group, term, occurrences, documents)`` of the texts read since the last spill."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.entries = 0

    def _hold(self, terms: pa.Array, *entries: np.ndarray) -> None:
        self.held.append((terms, *entries))
        self.entries += len(entries[0])

    def add(self, groups: list[tuple[str, str]], texts: pa.Array) -> None:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        text, words = _words(texts)
        coded = words.dictionary_encode()
        n = len(coded.dictionary)
        own, times = _summed(text * n + coded.indices.to_numpy(), np.ones(len(text), np.int64))
        key, count, docs = _summed(group[own // n] * n + own % n, times, np.ones(len(own), np.int64)) if n else (own, times, times)
        if n:
            self._hold(coded.dictionary, key // n, key % n, count, docs)

    def add_long(self, group: tuple[str, str], text: bytes) -> None:
        counts: Counter = Counter()
        for terms in terms_of(text):
            counts.update(terms)
        code = np.full(len(counts), self.groups.setdefault(group, len(self.groups)), np.int64)
        terms = pa.array([t.decode() for t in counts], pa.string())
        number = np.arange(len(counts))
        self._hold(terms, code, number, np.array(list(counts.values()), np.int64), np.ones(len(counts), np.int64))

    def run(self, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
        """``(shard, first term, piece)`` of the block in term order, and an empty block."""
        coded = pa.concat_arrays([h[0] for h in self.held]).dictionary_encode()
        code, at = coded.indices.to_numpy(), 0
        terms = []
        for known, _, number, _, _ in self.held:
            terms.append(code[at + number])
            at += len(known)
        order = pc.sort_indices(coded.dictionary)
        vocabulary = coded.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        shard = np.array([shard_of(t, shards) for t in vocabulary.cast(pa.binary()).to_pylist()], np.int64)
        group, count, docs = (np.concatenate([h[i] for h in self.held]) for i in (1, 3, 4))
        term, n = rank[np.concatenate(terms)], len(self.groups)
        key, count, docs = _summed((shard[term] * len(order) + term) * n + group, count, docs)
        group, term = key % n, key // n % len(order)
        of_shard = key // n // len(order)
        names = pickle.dumps(list(self.groups))
        cuts = np.flatnonzero(np.diff(of_shard, prepend=-1))
        for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
            for at in range(start, end, _PIECE):
                own = slice(at, min(at + _PIECE, end))
                entries = pa.RecordBatch.from_arrays(
                    [vocabulary.take(pa.array(term[own])), *(pa.array(v[own]) for v in (group, count, docs))],
                    schema=pa.schema(
                        [("term", pa.string()), ("group", pa.int64()), ("count", pa.int64()), ("docs", pa.int64())],
                        {b"groups": names},
                    ),
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, entries.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(entries)
                yield int(of_shard[at]), vocabulary[int(term[at])].as_py().encode(), sink.getvalue().to_pybytes()
        self.__init__()


def shard_of(term: bytes, shards: int) -> int:
    return zlib.crc32(term) % shards


class _Piece:
    """A piece of a run that is being merged."""

    def __init__(self, piece: bytes, groups: dict[tuple[str, str], int]) -> None:
        table = pa.ipc.open_stream(piece).read_all()
        code = np.array([groups.setdefault(g, len(groups)) for g in pickle.loads(table.schema.metadata[b"groups"])], np.int64)
        self.table = table.set_column(1, "group", pa.array(code[table["group"].to_numpy()])).combine_chunks()
        self.at = 0

    def head(self) -> bytes:
        return self.table["term"][self.at].as_py().encode()

    def until(self, term: bytes | None) -> pa.Table:
        """The entries from here to a term, which are passed."""
        low, high = self.at, len(self.table)
        while term is not None and low < high:
            mid = (low + high) // 2
            if self.table["term"][mid].as_py().encode() < term:
                low = mid + 1
            else:
                high = mid
        out = self.table.slice(self.at, high - self.at)
        self.at = high
        return out


def merged(pieces: Iterator[tuple[bytes, bytes]], rows: int = 300_000) -> Iterator[pa.Table]:
    """Each ``(term, lang, source)`` once with its ``count`` and ``docs``, whole terms in every table.

    Pieces come as ``(first term, piece)`` ordered by first term.  A heap holds
    the open pieces by their next term; what lies before the next piece's first
    term is complete, and comes off the heap when there are ``rows`` of it or
    more open."""
    groups: dict[tuple[str, str], int] = {}
    heap: list[tuple[bytes, int, _Piece]] = []

    def taken(until: bytes | None) -> Iterator[pa.Table]:
        parts = []
        while heap and (until is None or heap[0][0] < until):
            _, n, piece = heapq.heappop(heap)
            parts.append(piece.until(until))
            if piece.at < len(piece.table):
                heapq.heappush(heap, (piece.head(), n, piece))
        if parts:
            sums = pa.concat_tables(parts).group_by(["term", "group"]).aggregate([("count", "sum"), ("docs", "sum")])
            code, names = sums["group"].combine_chunks(), list(groups)
            yield pa.table(
                {
                    "lang": pa.array([la for la, _ in names], pa.string()).take(code),
                    "source": pa.array([so for _, so in names], pa.string()).take(code),
                    "term": sums["term"], "count": sums["count_sum"], "docs": sums["docs_sum"],
                }
            )

    held = 0
    for n, (first, piece) in enumerate(pieces):
        if held >= rows:
            yield from taken(first)
            held = sum(len(p.table) - p.at for _, _, p in heap)
        opened = _Piece(piece, groups)
        heapq.heappush(heap, (opened.head(), n, opened))
        held += len(opened.table)
    yield from taken(None)


def _kept(sums: pa.Table, min_docs: int) -> Iterator[pa.RecordBatch]:
    """``lang, term, total, holders`` of the terms with enough documents."""
    terms = sums.group_by(["lang", "term"]).aggregate([("docs", "sum"), ("count", "sum")])
    terms = terms.filter(pc.greater_equal(terms["docs_sum"], min_docs))
    held = sums.join(terms, ["lang", "term"], join_type="inner").sort_by([("lang", "ascending"), ("term", "ascending")])
    held = held.combine_chunks()
    if not len(held):
        return
    lang, term = (held[c].combine_chunks().dictionary_encode() for c in ("lang", "term"))
    key = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    columns = [held[c].combine_chunks() for c in ("source", "count")]
    holders = pa.StructArray.from_arrays(columns, ["source", "count"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), holders)
    at = pa.array(first)
    out = pa.table(
        {"lang": held["lang"].take(at), "term": held["term"].take(at), "total": held["count_sum"].take(at), "holders": lists}
    )
    yield from out.to_batches(max_chunksize=10_000)


def postings(docs: DataFrame, min_docs: int, block: int, shards: int) -> DataFrame:
    """``lang, term, total, holders`` of the kept terms, ``holders`` an array of ``(source, count)``."""

    def spilled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block()
        names, kinds = ["shard", "first", "piece"], (pa.int32(), pa.binary(), pa.binary())

        def run() -> Iterator[pa.RecordBatch]:
            for piece in held.run(shards) if held.entries else ():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(piece, kinds)], names)

        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for first, after in slices(batch.column(2), _CHUNK):
                texts = batch.column(2).slice(first, after - first)
                if after - first == 1 and pc.binary_length(texts)[0].as_py() > _CHUNK:
                    held.add_long(groups[first], texts[0].as_buffer().to_pybytes())
                else:
                    held.add(groups[first:after], texts)
                if held.entries >= block:
                    yield from run()
        yield from run()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in merged((f.as_py(), p.as_py()) for batch in batches for f, p in zip(batch["first"], batch["piece"])):
            yield from _kept(sums, min_docs)

    runs = docs.mapInArrow(spilled, "shard int, first binary, piece binary")
    at_shard = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("first")
    schema = "lang string, term string, total long, holders array<struct<source: string, count: long>>"
    return at_shard.mapInArrow(frequencies, schema)


def probability(count: Column, n: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (n + terms))``, exact."""
    parts = (count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.greatest(n + terms, F.lit(1)).cast("decimal(28,0)")
    return (F.call_function("div", parts, whole) + 1).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial corrections ``lang, source, item, value`` (modulo 2^64) of the
    holders ``lang, term, source, p, p0``, which come term by term."""
    sums: dict[tuple[str, str, str], int] = {}
    kinds = {"lang": pa.string(), "source": pa.string(), "item": pa.string(), "value": pa.int64()}

    def signed(v: int) -> int:
        return (v + (1 << 63)) % (1 << 64) - (1 << 63)

    def pack() -> pa.RecordBatch:
        columns = [*zip(*sums), [signed(v) for v in sums.values()]]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))
        sums.clear()
        return out

    def charge(a: np.ndarray, b: np.ndarray, codes: np.ndarray, names: list, p: np.ndarray, p0: np.ndarray) -> None:
        ps, qs, ps0, qs0 = p[a], p[b], p0[a], p0[b]
        with np.errstate(over="ignore"):
            value = _f(ps, qs) - _f(ps, qs0) - _f(ps0, qs) + _f(ps0, qs0)
            pair = codes[a] * len(names) + codes[b]
            order = np.argsort(pair, kind="stable")
            found, starts = np.unique(pair[order], return_index=True)
            totals = np.add.reduceat(value[order], starts)
        for code, total in zip(found.tolist(), totals.tolist()):
            (lang, s), (_, t) = names[code // len(names)], names[code % len(names)]
            sums[lang, s, t] = sums.get((lang, s, t), 0) + total

    def terms(rows: pa.Table) -> Iterator[None]:
        """Charge whole terms, at most ``_PAIRS`` pairs at a time."""
        lang, term, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        li, ti, si = (c.indices.to_numpy().astype(np.int64) for c in (lang, term, source))
        p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
        groups, codes = np.unique(li * len(source.dictionary) + si, return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        names = [(langs[g // len(sources)], sources[g % len(sources)]) for g in groups.tolist()]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(li) != 0) | (np.diff(ti) != 0))))
        size = np.diff(np.concatenate((new, [len(li)])))
        first, many = np.repeat(new, size), np.repeat(size, size)  # of each row: where its term begins, and its holders
        upto = np.cumsum(many)
        at = 0
        while at < len(li):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
            reps = many[at:end]
            a = np.repeat(np.arange(at, end), reps)
            b = np.repeat(first[at:end], reps) + np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps)
            other = a != b
            charge(a[other], b[other], codes, names, p, p0) if other.any() else None
            at = end
            if len(sums) >= _PAIRS:
                yield None

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = lambda i, b=batch: (b["lang"][i], b["term"][i])
        cut = batch.num_rows
        while cut and key(cut - 1) == key(batch.num_rows - 1):
            cut -= 1  # the last term may go on in the next batch
        if cut:
            for _ in terms(pa.Table.from_batches([*held, batch.slice(0, cut)])):
                yield pack()
            held = []
        elif held and key(0) != (held[0]["lang"][0], held[0]["term"][0]):
            for _ in terms(pa.Table.from_batches(held)):
                yield pack()
            held = []
        held.append(batch.slice(cut))
    if held:
        for _ in terms(pa.Table.from_batches(held)):
            yield pack()
    if sums:
        yield pack()


def source_divergence(
    docs: DataFrame,
    min_docs: int = 3,
    top: int = 200,
    block: int = 400_000,
    shards: int | None = None,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has each other
    source of the language, part ``term`` the group's own terms to rank ``top``."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    # a shard per input partition at least: with the table grows the merge
    shards = shards or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = staged(postings(rows, min_docs, block, shards), "term-postings")
    holders = kept.select("lang", "term", "total", F.inline("holders"))

    own = holders.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    stats = staged(
        rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, ["lang"], "left")
        .na.fill(0, ["n", "terms", "lang_n"]),
        "source-stats",
    )
    p0 = probability(F.lit(0).cast("long"), F.col("n"), F.col("terms"))
    held = holders.join(stats, ["lang", "source"]).select(
        "lang", "term", "source", "count", "total", "terms", "lang_n",
        probability(F.col("count"), F.col("n"), F.col("terms")).alias("p"), p0.alias("p0"),
    )

    # own terms
    own_terms = held.withColumn("q", probability(F.col("total"), F.col("lang_n"), F.col("terms"))).filter("p > q")
    by = lambda *order: Window.partitionBy("lang", "source").orderBy(*order)
    ranked = [F.col("value").desc(), F.col("item")]
    term_part = (
        own_terms.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by(*ranked)))
        .filter(F.col("rank") <= top)
    )

    # pairs: as if no term had two holders ...
    levels = held.groupBy("lang", "source", "count", "p", "p0").agg(F.count("*").alias("times"))
    present = levels.groupBy("lang", "source").agg(F.sum("times").alias("present"))
    absent = stats.join(present, ["lang", "source"], "left").select(
        "lang", "source", F.lit(0).cast("long").alias("count"), p0.alias("p"), p0.alias("p0"),
        (F.col("terms") - F.coalesce("present", F.lit(0))).alias("times"),
    )
    salt = F.pmod(F.xxhash64("source", "count"), F.lit(_SALTS)).cast("int")
    other = stats.select(
        F.col("lang"), F.col("source").alias("other"), p0.alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    )
    exact = lambda n, f: n.cast("decimal(19,0)") * f.cast("decimal(19,0)")
    p, q0, from_zero = F.col("p"), F.col("q0"), F.col("p0")
    charged = F.inline(
        F.array(
            F.struct(F.col("source").alias("source"), F.col("other").alias("item"), exact(F.col("times"), divergence(p, q0)).alias("value")),
            F.struct(
                F.col("other").alias("source"), F.col("source").alias("item"),
                exact(F.col("times"), divergence(q0, p) - divergence(q0, from_zero)).alias("value"),
            ),
        )
    )
    apart = (
        levels.unionByName(absent).withColumn("salt", salt).join(other, ["lang", "salt"]).filter("source <> other")
        .select("lang", charged)
    )
    # ... then corrected for the terms that had
    by_term = held.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    corrections = by_term.mapInArrow(_corrected, "lang string, source string, item string, value long")
    modulus = F.lit(str(1 << 64)).cast("decimal(38,0)")
    pair_part = (
        apart.unionByName(corrections.withColumn("value", F.col("value").cast("decimal(38,0)")))
        .groupBy("lang", "source", "item")
        .agg(F.pmod(F.sum("value"), modulus).cast("long").alias("value"))
        .withColumn("rank", F.row_number().over(by(*ranked)))
    )
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pair_part, "pair").unionByName(columns(term_part, "term"))
