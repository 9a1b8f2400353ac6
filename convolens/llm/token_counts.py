"""Token counts by section through offset-mapped attribution.

A document's fields are laid end to end, with ``separator`` between them (so
none for a single field), and the whole is encoded once with a byte-level BPE.  Such an encoding is
lossless, so the byte lengths of the tokens give the character span of each
token; the spans are joined to the section intervals by binary search.  A
section is a run of characters of one field: the whole field, or its lines
(a line keeps its line break).

Tokens inside one section count there.  A token that crosses a border is
given by one rule:

``first``  to the section of its first character,
``most``   to the section with most of its characters, the first of equals,
``split``  to all its sections, in proportion to characters.

The counts of a document always sum to its number of tokens: with one field,
those of its own text.  A separator belongs to the section it closes.

Defined cases: a null field counts as empty; an empty field, and so an empty
document, has one empty section (without a token, where no separator follows); a token without a whole character (part of a
multi-byte one) spans that character; repeated ids give repeated rows; an
empty table gives an empty result; columns not named as fields are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.session import ship_package

from .common import id_type, text_of

RULES = ("first", "most", "split")
_OUT_ROWS = 100_000


class ByteBPE:
    """A rank file as encoder with token byte lengths."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._lengths[rank] = len(token)

    def byte_ends(self, text: str) -> np.ndarray:
        """End byte of every token of a text."""
        return np.cumsum(self._lengths[np.array(self._encoding.encode_ordinary(text), np.int64)])


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def char_spans(text: bytes, byte_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each token."""
    starts = np.concatenate(([0], byte_ends[:-1])).astype(np.int64)
    leads = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    before = np.concatenate(([0], np.cumsum(leads)))  # characters that begin before a byte
    return before[starts + 1] - 1, before[byte_ends]


def attribute(first: np.ndarray, after: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Token count per section, and tokens per section that cross out of or
    into it.  ``borders``: the sections' ends, ascending; spans ascend."""
    n = len(borders)
    counts = np.zeros(n)
    a = np.searchsorted(borders, first, side="right")
    b = np.searchsorted(borders, after - 1, side="right")
    inside = a == b
    counts += np.bincount(a[inside], minlength=n)
    crossing = np.zeros(n, np.int64)
    starts = np.concatenate(([0], borders[:-1]))
    for k in np.flatnonzero(~inside):
        own = np.arange(a[k], b[k] + 1)
        chars = np.minimum(borders[own], after[k]) - np.maximum(starts[own], first[k])
        own, chars = own[chars > 0], chars[chars > 0]
        crossing[own] += 1
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "most":
            counts[own[np.argmax(chars)]] += 1
        else:
            counts[own] += chars / chars.sum()
    return counts, crossing


def token_counts(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    fields: list[str],
    lines: bool = True,
    rule: str = "most",
    separator: str = "\n",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per section: ``doc_id, field, section, char_start, char_end``
    (in the laid-out document), ``n_tokens`` (double), ``n_crossing``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array(*[text_of(f) for f in fields]).alias("texts"))

    def sections(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The laid-out text; each section's field, number and end."""
        of, number, ends, at, whole = [], [], [], 0, []
        for k, text in enumerate(texts):
            closing = separator if k + 1 < len(texts) else ""
            whole += [text, closing]
            size = len(text)
            if lines and "\n" in text:
                points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                cuts = (np.flatnonzero(points == 10) + 1).tolist()
                cuts = [c for c in cuts if c < size] + [size]
            else:
                cuts = [size]
            cuts[-1] += len(closing)
            of += [k] * len(cuts)
            number += range(len(cuts))
            ends += [at + c for c in cuts]
            at += size + len(closing)
        return "".join(whole), np.array(of), np.array(number), np.array(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(rank_file, pattern)
        names = pa.array(fields)
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def flush(held=held, batch=batch) -> pa.RecordBatch:
                at = pa.array(np.concatenate([h[0] for h in held]))
                columns = [np.concatenate(c) for c in list(zip(*held))[1:]]
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), names.take(pa.array(columns[0])), *map(pa.array, columns[1:])],
                    ["doc_id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

            for i, texts in enumerate(batch.column(1)):
                whole, of, number, ends = sections(texts.as_py())
                data = whole.encode()
                if data:
                    counts, crossing = attribute(*char_spans(data, bpe.byte_ends(whole)), ends, rule)
                else:
                    counts, crossing = np.zeros(len(ends)), np.zeros(len(ends), np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                held.append((np.full(len(ends), i), of, number.astype(np.int32), starts, ends, counts, crossing))
                size += len(ends)
                if size >= _OUT_ROWS:
                    yield flush()
                    held.clear()
                    size = 0
            if held:
                yield flush()

    schema = (
        f"doc_id {id_type(rows)}, field string, section int, char_start long, char_end long, "
        "n_tokens double, n_crossing long"
    )
    return rows.mapInArrow(run, schema)
