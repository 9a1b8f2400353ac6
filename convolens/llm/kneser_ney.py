"""Interpolated modified Kneser-Ney model of any order, counted in Spark.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), then one end per
text; the first token's context is a start mark.  Words are named by XXH64.

Counting
  1. Word counts: local counts per task, one ``groupBy``; sorted by hash into
     range partitions, each an array file.  A word's index is its rank.
  2. Counts of pairs, then of triples and so on up to ``order``: a task sorts
     and counts its grams (the index of the context's entry among the shorter
     grams, and the word, in one 64-bit key) and sends them, packed, to shards.
     Shards are key ranges of equal token mass, taken from the counts of the
     contexts; a context of more than one share of the tokens is cut into
     several ranges.  Each shard merges its parts into one sorted array file.
     A gram's index is its rank over all files.
  3. Statistics, from the longest grams down: partial sums per file of the
     shorter grams become dense array files beside it (tokens that follow a
     context, its discount mass, and a gram's distinct contexts).

Scoring needs no shuffle: workers memory-map the array files and look up the
sorted words and grams of a batch of texts.

The driver holds scalars, the cuts between shards and figures per file,
nothing per word or gram.  What is counted is every token of every text.

``p(w|vu) = max(c(vuw) - D(c(vuw)), 0) / c(vu) + g(vu) p(w|u)`` with
``g(vu) = (D1 N1(vu) + D2 N2(vu) + D3 N3+(vu)) / c(vu)``; the lower orders have
the same form over numbers of distinct contexts (grams that begin with the
start mark have none and keep their counts), the lowest interpolated with
``1 / (V + 1)``, the share of an unknown word; an unknown context leaves the
lower order.  Discounts come from the counts of counts, per order; where these
give none, they are 1/2, 1 and 3/2.

Defined cases: null and empty texts are one end token; with no training text
every probability is 1 (N = V = 0); repeated ids give repeated rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.session import checkpoint_dir

from .array_files import load, save
from .common import id_and_text, id_type, staged
from .token_files import pack_block, unpack_block

#: Tokens a task gathers before it counts, and token mass of a shard.
GATHER, SHARE = 2_000_000, 2_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _signed_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


END = b" "  # no word holds a space
START = "start"  # label of the start mark's files


def _tokens(text: bytes) -> np.ndarray:
    """Hashes of the words and the end, as signed 64-bit."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    words.append(END)
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Runs of documents: their ids, tokens end to end, first token of each."""
    ids, held, n = [], [], 0

    def run() -> tuple[list, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        return ids, np.concatenate(held), np.cumsum(sizes) - sizes

    for batch in batches:
        for i, text in enumerate(batch.column(column)):
            held.append(_tokens(text.as_py().encode()))
            ids.append(batch.column(0)[i].as_py() if column else None)
            n += len(held[-1])
            if n >= GATHER:
                yield run()
                ids, held, n = [], [], 0
    if held:
        yield run()


@dataclass(frozen=True)
class Level:
    """The grams of one length; an entry's index is its rank over all files."""

    n: int
    shift: int  # key = index of the gram without its last word << shift, plus that word
    shards: tuple[int, ...]  # number of each file
    cuts: tuple[int, ...]  # least key of each file but the first
    sizes: tuple[int, ...]  # entries of each file
    masses: tuple[int, ...]  # tokens of each file
    counts: str  # name of the counts that score: raw ones, or distinct contexts
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)


@dataclass(frozen=True)
class Model:
    """Places and scalars of a trained model; small enough for a closure."""

    folder: str
    parts: tuple[int, ...] = ()  # words in each word file
    firsts: tuple[int, ...] = ()  # first hash of each word file
    labels: tuple[int, ...] = ()  # part of each word file's name
    tokens: int = 0
    levels: tuple[Level, ...] = ()  # from pairs up
    lower_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    lower_rest: float = 1.0  # mass that the lowest order gives to the uniform

    @property
    def words(self) -> int:
        return sum(self.parts)

    @property
    def pairs(self) -> int:
        return sum(self.levels[0].sizes) if self.levels else 0

    def units(self, n: int) -> tuple[tuple, tuple]:
        """Names and sizes of the files of grams of length ``n``; of words, the start mark is the last."""
        if n == 1:
            return (*self.labels, START), (*self.parts, 1)
        return self.levels[n - 2].shards, self.levels[n - 2].sizes


def _index(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Index of each of some ascending hashes, -1 where unknown."""
    out = np.full(len(hashes), -1, np.int64)
    edges = [*np.searchsorted(hashes, np.array(model.firsts[1:], np.int64)).tolist(), len(hashes)]
    base = low = 0
    for part, high in enumerate(edges):
        if high > low and model.parts[part]:
            known = _mapped(model.folder, f"words-{model.labels[part]}")
            at = np.searchsorted(known, hashes[low:high])
            hit = known[np.minimum(at, len(known) - 1)] == hashes[low:high]
            out[low:high] = np.where(hit, base + at, -1)
        base, low = base + model.parts[part], high
    return out


def _values(model: Model, n: int, name: str, index: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Values of a statistic of grams of length ``n`` at any indices (-1: 0)."""
    asked, place = np.unique(index, return_inverse=True)
    out = np.zeros(len(asked), dtype)
    labels, sizes = model.units(n)
    bases = np.cumsum((0, *sizes))
    edges = np.searchsorted(asked, bases).tolist()
    for part, (low, high) in enumerate(zip(edges, edges[1:])):
        if high > low:
            out[low:high] = _mapped(model.folder, f"{name}-{labels[part]}")[asked[low:high] - bases[part]]
    return out[place]


def _entries(model: Model, level: Level, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Index of the grams of some contexts and words, -1 where unknown."""
    out = np.full(len(word), -1, np.int64)
    both = np.flatnonzero((word >= 0) & (context >= 0))
    keys, place = np.unique((context[both] << level.shift) + word[both], return_inverse=True)
    found = np.full(len(keys), -1, np.int64)
    bases = np.cumsum((0, *level.sizes)).tolist()
    edges = [0, *np.searchsorted(keys, np.array(level.cuts, np.int64)).tolist(), len(keys)]
    for base, shard, low, high in zip(bases, level.shards, edges, edges[1:]):
        if high > low:
            known = _mapped(model.folder, f"keys{level.n}-{shard}")
            at = np.minimum(np.searchsorted(known, keys[low:high]), len(known) - 1)
            found[low:high] = np.where(known[at] == keys[low:high], base + at, -1)
    out[both] = found[place]
    return out


def _before(entry: np.ndarray, firsts: np.ndarray, start: int) -> np.ndarray:
    """The entry that ends one token earlier; ``start`` at a text's first token."""
    out = np.concatenate(([start], entry[:-1]))
    out[firsts] = start
    return out


def _contexts(model: Model, index: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For pairs, triples ...: index of the context of each token, and of the
    gram it ends (none for a length the model has not counted)."""
    context = _before(index, firsts, model.words)
    for level in model.levels:
        entry = _entries(model, level, context, index)
        yield context, entry
        context = _before(entry, firsts, -1)
    yield context, None


def _shorter(model: Model, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Index of grams of ``n`` words without their first word."""
    if n == 2:
        return word
    if n == 3:
        head = _values(model, 2, "keys2", context) & 0xFFFFFFFF
    else:
        head = _values(model, n - 1, f"shorter{n - 1}", context)
    return _entries(model, model.levels[n - 3], head, word)


@lru_cache(maxsize=256)  # bounds open files; older maps are opened again
def _mapped(folder: str, name: str) -> np.ndarray:
    return load(folder, name)


def _pack(*arrays: np.ndarray) -> bytes:
    """Ascending keys as steps, and the arrays beside them, in byte planes."""
    first, *rest = arrays
    parts = [pack_block(np.diff(first, prepend=0).astype("<u8")), *(pack_block(a.astype("<u4")) for a in rest)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack_block(data[at + 8 : at + 8 + size]).astype(np.int64))
        at += 8 + size
    out[0] = np.cumsum(out[0])
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if counts.max() < 1 << 32 else counts


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts of counts 1 to 4."""
    if all(n[:3]):
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < x < k for x, k in zip(d, (1, 2, 3))):
            return d
    return 0.5, 1.0, 1.5


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def train(docs: DataFrame, text_col: str = "text", share: int = SHARE, order: int = 2) -> Model:
    """Count a model of grams of up to ``order`` words over all rows of ``docs``."""
    if order < 2:
        raise ValueError("the order of a model is 2 or more")
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm/kneser-ney-{uuid.uuid4().hex}"
    texts = id_and_text(docs, text_col, text_col).select("text")

    # 1. Words.
    def local_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _gathered(batches, 0):
            words, counts = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], ["h", "n"])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            part = TaskContext.get().partitionId()
            words, counts = (np.concatenate(c) for c in zip(*got))
            save(folder, f"words-{part}", words)
            save(folder, f"word_counts-{part}", counts)
            rows = [[part], [len(words)], [int(words[0])], [int(counts.sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["part", "size", "first", "mass"])

    local = texts.mapInArrow(local_words, "h long, n long")
    words = local.groupBy("h").agg(F.sum("n").alias("n")).repartitionByRange("h").sortWithinPartitions("h")
    listing = staged(words.mapInArrow(write_words, "part long, size long, first long, mass long"), "word-files")
    parts = listing.orderBy("part").collect()  # one row per file
    if not parts:
        return Model(folder)
    sizes, mass = [p["size"] for p in parts], [p.mass for p in parts]
    tokens, n_words = sum(mass), sum(sizes)
    if n_words >= 1 << 31:
        raise ValueError("more distinct words than a pair key holds")

    labels = tuple(p.part for p in parts)
    model = Model(folder, tuple(sizes), tuple(p["first"] for p in parts), labels, tokens)

    # 2. Grams, from pairs up to the order (a longer gram names its context by index).
    n_docs = texts.count()
    for n in range(2, order + 1):
        level = _count(spark, texts, model, n, mass, n_docs, share, order)
        if not level.shards:  # no text is that long
            levels = (*model.levels[:-1], replace(model.levels[-1], counts=f"counts{n - 1}"))
            model = replace(model, levels=levels)
            break
        model = replace(model, levels=(*model.levels, level))

    # 3. Statistics, from the longest grams down.
    for k in reversed(range(len(model.levels))):
        model = _statistics(spark, model, k)
    return model


def _count(spark, texts: DataFrame, model: Model, n: int, word_mass: list, n_docs: int, share: int, order: int) -> Level:
    """Count the grams of ``n`` words into array files, key ranges of equal token
    mass over contexts (the start mark is the last)."""
    folder, n_words = model.folder, model.words
    shift = 32 if n == 2 else n_words.bit_length()
    below = model.units(n - 1)
    names, sizes, masses, name = (
        (model.labels, model.parts, word_mass, "word_counts") if n == 2 else (*below, model.levels[-1].masses, f"counts{n - 1}")
    )
    bases, before = np.cumsum([0, *sizes]).tolist(), np.cumsum([0, *masses]).tolist()
    if bases[-1].bit_length() + shift > 63:
        raise ValueError("more distinct contexts than a key holds")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                counts = load(folder, f"{name}-{names[k]}").astype(np.int64)
                total = before[k] + np.cumsum(counts)
                full = total // share - (total - counts) // share  # cuts that fall into each context
                keys = []
                for at in np.flatnonzero(full):
                    pieces = int(full[at])
                    keys += [(bases[k] + int(at) << shift) + n_words * j // pieces for j in range(pieces)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["cut"])

    per_file = spark.range(0, len(names), 1, len(names)).mapInArrow(cut, "cut long")
    cuts = [r.cut for r in per_file.collect()]
    if n == 2:
        pieces = n_docs // share + 1
        cuts += [(n_words << shift) + n_words * j // pieces for j in range(pieces)]
    cuts = sorted({c for c in cuts if c > 0})
    shared = spark.sparkContext.broadcast((model, np.array(cuts, np.int64)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, edges_ = shared.value
        for _, tokens, firsts in _gathered(batches, 0):
            unique, place = np.unique(tokens, return_inverse=True)
            index = _index(known, unique)[place]
            *_, (context, _) = _contexts(known, index, firsts)
            full = context >= 0
            keys, counts = np.unique((context[full] << shift) + index[full], return_counts=True)
            edges = [0, *np.searchsorted(keys, edges_).tolist(), len(keys)]
            sent = [(s, a, b) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            payload = [_pack(keys[a:b], counts[a:b]) for _, a, b in sent]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in sent], pa.int32()), pa.array(payload, pa.binary())], ["shard", "payload"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(shard: int, held: list) -> pa.RecordBatch:
            keys, counts = (np.concatenate(c) for c in zip(*held))
            order_ = np.argsort(keys, kind="stable")
            keys, counts = keys[order_], counts[order_]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[at], np.add.reduceat(counts, at)
            save(folder, f"keys{n}-{shard}", keys)
            save(folder, f"counts{n}-{shard}", _narrow(counts))
            if 2 < n < order:
                word = keys & ((1 << shift) - 1)
                save(folder, f"shorter{n}-{shard}", _shorter(shared.value[0], n, keys >> shift, word))
            row = [shard, len(keys), int(counts.sum())]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["shard", "size", "mass"])

        shard, held = None, []
        for batch in batches:
            for own, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != shard:
                    if held:
                        yield close(shard, held)
                    shard, held = own, []
                held.append(_unpack(payload.as_py()))
        if held:
            yield close(shard, held)

    listing = staged(
        texts.mapInArrow(local, "shard int, payload binary")
        .repartition(len(cuts) + 1, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(merge, "shard long, size long, mass long"),
        "gram-files",
    )
    files = listing.orderBy("shard").collect()  # one row per file
    shards = tuple(f.shard for f in files)
    return Level(
        n, shift, shards, tuple(cuts[s - 1] for s in shards[1:]), tuple(f["size"] for f in files),
        tuple(f.mass for f in files), f"counts{n}" if n == order else f"contexts{n}",
    )


def _statistics(spark, model: Model, k: int) -> Model:
    """What follows each context of level ``k``, and the distinct contexts of the
    grams one word shorter, as dense array files beside those."""
    level, folder = model.levels[k], model.folder
    n, labels, sizes = level.n, *model.units(level.n - 1)
    bases = np.cumsum([0, *sizes])
    shared = spark.sparkContext.broadcast(model)
    names = ["block", "n1", "n2", "n3", "n4", "payload"]
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for s in batch.column(0).to_pylist():
                keys = load(folder, f"keys{n}-{level.shards[s]}")
                counts = load(folder, f"{level.counts}-{level.shards[s]}").astype(np.int64)
                context, word = keys >> level.shift, keys & ((1 << level.shift) - 1)
                rows = [(-1, *(int((counts == c).sum()) for c in (1, 2, 3, 4)), b"")]
                at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                sums = [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]
                sums[0:1] = [sums[0] & 0xFFFFFFFF, sums[0] >> 32]
                follow, contexts_of = np.unique(_shorter(known, n, context, word), return_counts=True)
                for index, values in ((context[at], sums), (follow, [contexts_of])):
                    edges = np.searchsorted(index, bases).tolist()
                    for block, (a, b) in enumerate(zip(edges, edges[1:])):
                        if b > a:
                            rows.append((block, 0, 0, 0, 0, _pack(index[a:b], *(v[a:b] for v in values))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "block int, n1 long, n2 long, n3 long, n4 long, payload binary"
    shards = spark.range(0, len(level.shards), 1, len(level.shards))
    partials = staged(shards.mapInArrow(partial, schema), "gram-statistics")
    seen = partials.filter("block < 0").agg(*[F.sum(c).alias(c) for c in names[1:5]]).first()
    discounts = _discounts([seen.n1, seen.n2, seen.n3, seen.n4])

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(block: int, sums: np.ndarray) -> pa.RecordBatch:
            low, high, one, two, more, contexts = sums
            label = labels[block]
            save(folder, f"followed{n}-{label}", _narrow(low + (high << 32)))
            save(folder, f"rest{n}-{label}", discounts[0] * one + discounts[1] * two + discounts[2] * more)
            if n > 2:  # grams that begin with the start mark have no context: their own count stays
                own = load(folder, f"counts{n - 1}-{label}")
                contexts = np.where(contexts > 0, contexts, own)
            save(folder, f"contexts{n - 1}-{label}", _narrow(contexts))
            got = [(contexts == c).sum() for c in (1, 2, 3, 4)] + [(contexts >= 3).sum()]
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()) for g in got], ["n1", "n2", "n3", "n4", "more"])

        own, sums = None, None
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != own:
                    if sums is not None:
                        yield close(own, sums)
                    own, sums = block, np.zeros((6, sizes[block]), np.int64)
                payload = payload.as_py()
                if payload:
                    index, *values = _unpack(payload)
                    index -= bases[block]
                    for c, v in zip(range(5) if len(values) > 1 else (5,), values):
                        sums[c, index] += v
        if sums is not None:
            yield close(own, sums)

    every = spark.range(len(labels)).select(F.col("id").cast("int").alias("block"), F.lit(b"").alias("payload"))
    lower = staged(
        partials.filter("block >= 0")
        .select("block", "payload")
        .union(every)
        .repartition(len(labels), "block")
        .sortWithinPartitions("block")
        .mapInArrow(per_block, "n1 long, n2 long, n3 long, n4 long, more long"),
        "context-statistics",
    )
    model = replace(model, levels=(*model.levels[:k], replace(level, discounts=discounts), *model.levels[k + 1 :]))
    if n > 2:
        return model
    got = lower.agg(*[F.sum(c).alias(c) for c in lower.columns]).first()
    lowest = _discounts([got.n1, got.n2, got.n3, got.n4])
    rest = lowest[0] * got.n1 + lowest[1] * got.n2 + lowest[2] * got.more
    return replace(model, lower_discounts=lowest, lower_rest=rest / model.pairs)


def _scores(model: Model, tokens: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """Per document: tokens, known tokens, base score, score."""
    n_words, total = model.words, model.tokens
    unique, place = np.unique(tokens, return_inverse=True)
    found = _index(model, unique) if n_words else np.full(len(unique), -1, np.int64)
    counts = _values(model, 1, "word_counts", found)
    base = np.log10((counts + 0.5) / (total + 0.5 * (n_words + 1)))[place]
    contexts = _values(model, 1, "contexts1", found)
    p1 = np.maximum(contexts - _discount(contexts, model.lower_discounts), 0) / max(model.pairs, 1)
    p = (p1 + model.lower_rest / (n_words + 1))[place]
    for level, (context, entry) in zip(model.levels, _contexts(model, found[place], firsts)):
        times = _values(model, level.n, level.counts, entry)
        followed = _values(model, level.n - 1, f"followed{level.n}", context)
        rest = _values(model, level.n - 1, f"rest{level.n}", context, np.float64)
        higher = np.maximum(times - _discount(times, level.discounts), 0) + rest * p
        p = np.where(followed > 0, higher / np.maximum(followed, 1), p)
    sizes = np.diff(np.append(firsts, len(tokens)))
    return [
        sizes,
        np.add.reduceat((counts > 0)[place].astype(np.int64), firsts),
        np.add.reduceat(base, firsts),
        np.add.reduceat(np.log10(p), firsts),
    ]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row;
    the perplexity of a text is ``10 ** (-score / n_tokens)``."""
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for ids, tokens, firsts in _gathered(watched(), 1):
            sizes, known, base, full = _scores(shared.value, tokens, firsts)
            columns = [pa.array(ids, kind), pa.array(sizes), pa.array(known), pa.array(base), pa.array(full)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    schema = f"doc_id {id_type(rows)}, n_tokens long, n_known long, base_score double, score double"
    return rows.mapInArrow(run, schema).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
