"""Alignment of two tokenizers by the bytes their tokens cover.

Side A is a byte-level BPE file of the tokenizers library, applied to a space
and the text; side B a sentencepiece model, which adds that space itself.
Strings of special tokens inside a text are plain text.  A's tokens are
decoded byte-level, B's pieces as UTF-8 with U+2581 as a space and ``<0xHH>``
as a byte.

Method: a batch of documents becomes two frames of tokens, with document and
byte offset.  ``pandas.merge_asof``, keyed by document, finds for each token
start of one side the token of the other side that covers it; the union of
both directions is every pair of tokens that overlap.  Overlapping tokens with
equal ends are *links*; the ends cut a document's tokens into groups.

How often an id pair is linked in the corpus is counted in Spark.  The counts
are at most (ids of A) x (ids of B), whatever the corpus; they are stored as
arrays sorted by pair, by B id modulo ``PARTS``, which workers memory-map.

Encoding looks up repeated words: a word is a pre-token of A (the file's
settings are checked, and the text must be ASCII or Latin-1 letters), and a
run of spaces with what follows for B (no piece may hold a space after
something else, which is checked when the model is loaded).  Anything else goes
through the libraries whole.

Defined cases: a text that is null or empty, or whose tokens' bytes on either
side are not the space and the text (U+2581 in a text, say), has no tokens:
zeros and an empty digest; rows that repeat an id give a row each; an empty
table gives an empty result; other columns are ignored.  A document is aligned
whole: some 100 bytes of a task's memory per byte of its longest text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.session import checkpoint_dir, ship_package

from .array_files import load, save
from .common import id_type, slices, staged

MEMO = 400_000
PARTS = 64  # files of pair counts
_BATCH_BYTES = 2 << 20  # of text that are aligned together
_BEST = np.int64(1) << 62  # flag in a stored count

# The pre-tokeniser for which looking words up is exact.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PLAIN_TEXT = re.compile(r"[\x09-\x0D\x20-~À-ÖØ-öø-ÿ]*").fullmatch
_PRE_TOKENS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\x09-\x0D\x20A-Za-z0-9À-ÖØ-öø-ÿ]+"
    r"|[\x09-\x0D\x20]+(?![^\x09-\x0D\x20])|[\x09-\x0D\x20]+"
).findall
_SPACED = re.compile(r" *[^ ]+(?: +\Z)?| +").findall
_SPACE = "▁"


class _Memo(dict):
    """Words to packed ids; full, the newer half (the rarer words) goes."""

    def __init__(self, ids, dtype) -> None:
        super().__init__()
        self._ids, self._dtype = ids, dtype

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            for old in list(self)[MEMO // 2 :]:
                del self[old]
        out = self[word] = np.array(self._ids(word), self._dtype).tobytes()
        return out


def _width(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class ByteLevel:
    """Side A."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        letter = _byte_letters()
        letters = {c: "".join(map(letter.__getitem__, chr(c).encode())) for c in range(0x100)}
        byte_of = {x: b for b, x in enumerate(letter)}
        self.tokens = [b""] * self.size
        for token, i in vocabulary.items():  # an added token never comes out of a text
            self.tokens[i] = bytes(byte_of.get(x, 0) for x in token)
        self.dtype = _width(self.size)
        spec = json.loads(self._tokenizer.to_str())
        self._by_words = (
            spec.get("normalizer") is None
            and spec.get("pre_tokenizer") == _PRE_TOKENIZER
            and spec["model"]["type"] == "BPE"
            and spec["model"].get("dropout") is None
        )
        model = self._tokenizer.model
        self._memo = _Memo(lambda word: [t.id for t in model.tokenize(word.translate(letters))], self.dtype)

    def ids(self, text: str) -> np.ndarray:
        text = " " + text
        if self._by_words and _PLAIN_TEXT(text):
            return np.frombuffer(b"".join(map(self._memo.__getitem__, _PRE_TOKENS(text))), self.dtype)
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level files: printable Latin-1 bytes are
    themselves, the others are numbered from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + others.index(b)) for b in range(256)]


class Pieces:
    """Side B."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        names = [self._model.id_to_piece(i) for i in range(self.size)]
        as_byte = re.compile(r"<0x([0-9A-Fa-f]{2})>").fullmatch
        self.tokens = [
            bytes.fromhex(m[1]) if (m := as_byte(name)) else name.replace(_SPACE, " ").encode() for name in names
        ]
        self.dtype = _width(self.size)
        self._by_words = not any(_SPACE in name.lstrip(_SPACE) for name in names)
        self._memo = _Memo(lambda word: self._model.encode(word[1:]), self.dtype)

    def ids(self, text: str) -> np.ndarray:
        if self._by_words and _SPACE not in text:
            return np.frombuffer(b"".join(map(self._memo.__getitem__, _SPACED(" " + text))), self.dtype)
        return self.whole(text)

    def whole(self, text: str) -> np.ndarray:
        """The ids by the library, without words looked up."""
        return np.array(self._model.encode(text), self.dtype)


@lru_cache(maxsize=2)
def _sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


class Tokens(NamedTuple):
    """One side of a batch: per token its id, document, first byte and end.
    Offsets run through the batch; the sides of a document are of one length."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Spelling:
    """Strings by number, written out in a row."""

    def __init__(self, strings: list[bytes]) -> None:
        self._strings = pa.array(strings, pa.large_binary())
        self.lengths = np.array([len(x) for x in strings], np.int64)

    def __call__(self, numbers: np.ndarray) -> bytes:
        data = self._strings.take(pa.array(numbers)).buffers()[2]
        return data.slice(0, int(self.lengths[numbers].sum())).to_pybytes() if data else b""


def _side(ids: list[np.ndarray], lengths: np.ndarray) -> Tokens:
    flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    end = np.cumsum(lengths[flat])
    return Tokens(flat, np.repeat(np.arange(len(ids)), [len(i) for i in ids]), end - lengths[flat], end)


@lru_cache(maxsize=2)
def _spellings(a_path: str, b_path: str) -> tuple[Spelling, Spelling]:
    return tuple(Spelling(side.tokens) for side in _sides(a_path, b_path))


def tokens_of(texts: list[str], a_path: str, b_path: str) -> tuple[Tokens, Tokens]:
    """Both sides of a batch of texts; texts that are not spelled right have no tokens."""
    sides, spell = _sides(a_path, b_path), _spellings(a_path, b_path)
    wholes = [b" " + t.encode() if t else b"" for t in texts]
    ids = [[side.ids(t) if t else np.zeros(0, side.dtype) for t in texts] for side in sides]

    def right(side: int, of: list[int]) -> bool:
        """Whether the side's tokens of these texts spell them."""
        lengths = [int(spell[side].lengths[ids[side][i]].sum()) for i in of]
        if lengths != [len(wholes[i]) for i in of]:
            return False
        return spell[side](np.concatenate([ids[side][i] for i in of])) == b"".join(wholes[i] for i in of)

    everything = list(range(len(texts)))
    if texts and not (right(0, everything) and right(1, everything)):
        for i in everything:
            if not right(1, [i]):
                ids[1][i] = sides[1].whole(texts[i])
            if not (right(0, [i]) and right(1, [i])):
                ids[0][i], ids[1][i] = ids[0][i][:0], ids[1][i][:0]
    return tuple(_side(own, s.lengths) for own, s in zip(ids, spell))


def overlapping(a: Tokens, b: Tokens) -> pd.DataFrame:
    """``a, b``: positions of all tokens of the two sides that share a byte."""
    left = pd.DataFrame({"at": a.start, "doc": a.doc, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"at": b.start, "doc": b.doc, "b": np.arange(len(b.ids))})
    covers_a = pd.merge_asof(left, right, on="at", by="doc")
    covers_b = pd.merge_asof(right, left, on="at", by="doc")
    # where both start together, both directions find the pair: it counts once
    again = a.start[covers_b["a"].to_numpy(np.int64)] == b.start
    return pd.concat([covers_a[["a", "b"]], covers_b.loc[~again, ["a", "b"]]], ignore_index=True).astype("int64")


class Aligned(NamedTuple):
    """Link ends of a batch and where the tokens stand in group order."""

    link_a: np.ndarray
    link_b: np.ndarray
    ends_a: np.ndarray  # flag: the token ends a group
    ends_b: np.ndarray
    place_a: np.ndarray  # place among all tokens of the batch: by group, then A before B
    place_b: np.ndarray


def aligned(a: Tokens, b: Tokens) -> Aligned:
    pairs = overlapping(a, b)
    la, lb = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    together = a.end[la] == b.end[lb]
    la, lb = np.sort(la[together]), np.sort(lb[together])
    flags, places = [], []
    for n, own in ((len(a.ids), la), (len(b.ids), lb)):
        flag = np.zeros(n, bool)
        flag[own] = True
        flags.append(flag)
    group_a, group_b = (np.cumsum(f) - f for f in flags)
    before = np.concatenate(([0], lb + 1))  # tokens of B in earlier groups
    places = np.arange(len(a.ids)) + before[group_a], np.arange(len(b.ids)) + (la + 1)[group_b]
    return Aligned(la, lb, *flags, *places)


class _Printed:
    """Ids with the mark that follows them."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.first_b = 2 * size_a
        text = [b"%d%s" % (i, m) for i in range(size_a) for m in (b",", b"|")]
        self.text = Spelling(text + [b"%d%s" % (i, m) for i in range(size_b) for m in (b",", b";")])

    def digests(self, a: Tokens, b: Tokens, al: Aligned, sizes: np.ndarray) -> list[str]:
        """The digest of each document's groups; ``sizes``: its tokens of both sides."""
        codes = np.empty(len(a.ids) + len(b.ids), np.int64)
        codes[al.place_a] = 2 * a.ids + al.ends_a
        codes[al.place_b] = self.first_b + 2 * b.ids + al.ends_b
        line, ends = self.text(codes), np.concatenate(([0], np.cumsum(self.text.lengths[codes])))
        after = np.cumsum(sizes)
        return [
            hashlib.sha256(line[ends[j - n] : ends[j] - 1]).hexdigest() if n else ""
            for n, j in zip(sizes.tolist(), after.tolist())
        ]


@lru_cache(maxsize=1)
def _printed(size_a: int, size_b: int) -> _Printed:
    return _Printed(size_a, size_b)


def overlaps(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per overlapping pair of tokens: ``doc_id``, token numbers ``a, b``
    in the document, ``a_id, b_id``, byte ranges in the space and the text
    (``a_start, a_end, b_start, b_end``) and ``together`` (equal ends: a link)."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after in slices(batch.column(1), _BATCH_BYTES):
                part = batch.slice(first, after - first)
                a, b = tokens_of([t or "" for t in part.column(1).to_pylist()], a_path, b_path)
                pairs = overlapping(a, b).sort_values(["a", "b"])
                i, j = pairs["a"].to_numpy(), pairs["b"].to_numpy()
                doc = a.doc[i]
                begin = [np.searchsorted(s.doc, doc) for s in (a, b)]  # first token of the document
                base = a.start[begin[0]]
                columns = [i - begin[0], j - begin[1], a.ids[i], b.ids[j], a.start[i] - base, a.end[i] - base,
                           b.start[j] - base, b.end[j] - base, a.end[i] == b.end[j]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), *map(pa.array, columns)],
                    ["doc_id", "a", "b", "a_id", "b_id", "a_start", "a_end", "b_start", "b_end", "together"],
                )

    longs = ", ".join(f"{c} long" for c in ("a", "b", "a_id", "b_id", "a_start", "a_end", "b_start", "b_end"))
    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, {longs}, together boolean")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _per_document(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts and digest per document, and its linked id pairs (``id of B x
    ids of A + id of A``, ascending) with the times they are linked in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = (side.size for side in _sides(a_path, b_path))
        printed = _printed(size_a, size_b)
        for batch in batches:
            for first, after in slices(batch.column(1), _BATCH_BYTES):
                part = batch.slice(first, after - first)
                n = part.num_rows
                a, b = tokens_of([t or "" for t in part.column(1).to_pylist()], a_path, b_path)
                al = aligned(a, b)
                n_a, n_b, n_links = (np.bincount(d, minlength=n) for d in (a.doc, b.doc, a.doc[al.link_a]))
                digests = printed.digests(a, b, al, n_a + n_b)
                space = size_a * size_b
                pair = a.doc[al.link_a] * space + b.ids[al.link_b] * size_a + a.ids[al.link_a]
                pair, times = np.unique(pair, return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(n + 1) * space).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (pair % space, times)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, (n_a, n_b, n_links)), pa.array(digests, pa.string()), *lists],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
                )

    schema = (
        f"doc_id {id_type(rows)}, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "pairs array<long>, times array<long>"
    )
    return rows.mapInArrow(run, schema)


def pair_counts(documents: DataFrame, size_a: int, folder: str) -> list[int]:
    """Write the corpus-wide counts of all pairs as array files, by B id modulo
    ``PARTS``, and return the numbers of the files there are."""
    counts = (
        documents.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.times").alias("n"))
    )
    part = F.expr(f"cast(pair div {size_a} % {PARTS} as int)")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        pair, n = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("pair", "n"))
        of_b = pair // size_a
        new = np.flatnonzero(np.concatenate(([True], np.diff(of_b) != 0)))
        best = np.repeat(np.maximum.reduceat(n, new), np.diff(np.concatenate((new, [len(n)])))) == n
        number = int(of_b[0]) % PARTS
        save(folder, f"pair-{number}", pair)
        save(folder, f"count-{number}", n | np.where(best, _BEST, 0))
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32())})

    files = counts.repartitionById(PARTS, part).sortWithinPartitions("pair").mapInArrow(write, "part int")
    return sorted(r["part"] for r in files.collect())  # at most PARTS numbers


@lru_cache(maxsize=2 * PARTS)
def _loaded(folder: str, name: str) -> np.ndarray:
    return load(folder, name)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``.  A link's count is how often its id pair is
    linked in the corpus; it is best if no other A id is linked to its B id more often."""
    spark = docs.sparkSession
    documents = staged(_per_document(_rows(docs, id_col, text_col), a_path, b_path), "aligned")
    size_a = _sides(a_path, b_path)[0].size
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm/pair-counts-{uuid.uuid4().hex}"
    pair_counts(documents, size_a, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (batch[c].flatten().to_numpy() for c in ("pairs", "times"))
            found = np.zeros(len(pairs), np.int64)
            part = pairs // size_a % PARTS
            for number in np.unique(part).tolist():
                own = part == number
                at = np.searchsorted(_loaded(folder, f"pair-{number}"), pairs[own])
                found[own] = _loaded(folder, f"count-{number}")[at]
            doc = np.repeat(np.arange(batch.num_rows), batch["pairs"].value_lengths().to_numpy())
            best, count = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(best, doc, times * (found & _BEST != 0))
            np.add.at(count, doc, times * (found & ~_BEST))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch["n_groups"], pa.array(best), pa.array(count), batch["groups_sha256"]],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    schema = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return documents.mapInArrow(run, f"doc_id {id_type(documents)}, {schema}, groups_sha256 string")
