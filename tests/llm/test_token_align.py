"""Cross-tokenizer alignment against a brute force on the libraries themselves."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from convolens.llm import token_align as ta
from convolens.llm.common import slices
from convolens.llm.queries import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs int, n_a string, part int, a long"  # clashing names
TEXTS = [
    (1, "The quick brown fox doesn't jump."), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n\tand more  "),
    (6, "日本語のテキスト 🙂🙃 mixed ñandú"), (7, "a ▁ mark"), (8, "<|endoftext|> <s> </s> <unk> <0x41> [x]"),
    (9, "The quick brown fox doesn't jump."), (9, "The quick brown fox doesn't jump."), (None, "no id The fox"),
    (10, "word " * 20_000 + "end"), (11, "x" * 3_000), (12, "\r\n\r\n line\x0bfeed\x0c"), (13, "Ünïcode \U0010ffff íí ퟿"),
    (14, "nul \x00 byte"),
]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


def spelled_a(tokenizer, ids):
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {
        chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)
    }
    return [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in ids]


def spelled_b(model, ids):
    names = map(model.id_to_piece, ids)
    return [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]


def tokens(libraries, text):
    """``(id, start, end)`` per side, or nothing."""
    t, m = libraries
    if not text:
        return [], []
    sides = []
    for ids, bytes_of in (
        (t.encode(" " + text, add_special_tokens=False).ids, lambda i: spelled_a(t, i)), (m.encode(text), lambda i: spelled_b(m, i)),
    ):
        at, side, spelled = 0, [], bytes_of(ids)
        if b"".join(spelled) != (" " + text).encode():
            return [], []
        for i, s in zip(ids, spelled):
            side.append((i, at, at + len(s)))
            at += len(s)
        sides.append(side)
    return tuple(sides)


def brute(libraries, texts):
    docs, count = [], Counter()
    for i, text in texts:
        a, b = tokens(libraries, text)
        ends_b = {e: t for t, _, e in b}
        links = [(t, ends_b[e]) for t, _, e in a if e in ends_b]
        groups, ga, gb, j = [], [], [], 0
        for t, _, e in a:
            ga.append(str(t))
            if e in ends_b:
                while j < len(b) and b[j][2] <= e:
                    gb.append(str(b[j][0]))
                    j += 1
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        assert not ga and j == len(b)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        docs.append((i, len(a), len(b), len(groups), links, digest))
        count.update(links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        [
            (i, na, nb, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), d)
            for i, na, nb, g, links, d in docs
        ],
        key=repr,
    )


def small(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, "n", 2, 3) for i, t in texts], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_align_equals_brute_force(spark, libraries):
    assert rows_of(ta.align(small(spark).repartition(3), A, B)) == brute(libraries, TEXTS)


def test_query_on_driver_documents(spark, libraries):
    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = op12_token_alignment(spark, sf)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(df) == brute(libraries, texts)


def test_batches_are_cut_by_bytes_and_align_alike():
    texts = [x or "" for _, x in TEXTS]
    cuts = list(slices(pa.array(texts), 60))
    assert [c for c, _ in cuts] == [0, *[d for _, d in cuts[:-1]]] and cuts[-1][1] == len(texts) and len(cuts) > 4
    assert all(j - i == 1 or sum(len(t.encode()) for t in texts[i:j]) <= 60 for i, j in cuts)
    whole = ta.overlapping(*ta.tokens_of(texts, A, B))
    assert len(whole) == sum(len(ta.overlapping(*ta.tokens_of(texts[i:j], A, B))) for i, j in cuts)


def test_align_empty_table(spark):
    assert ta.align(small(spark, []), A, B).count() == 0


def test_overlaps_equal_all_pairs(spark, libraries):
    texts = [t for t in TEXTS if t[0] in (1, 5, 6, 8, 12)]
    expected = []
    for i, text in texts:
        a, b = tokens(libraries, text)
        for x, (ia, sa, ea) in enumerate(a):
            for y, (ib, sb, eb) in enumerate(b):
                if sa < eb and sb < ea:
                    expected.append((i, x, y, ia, ib, sa, ea, sb, eb, ea == eb))
    assert rows_of(ta.overlaps(small(spark, texts).repartition(2), A, B)) == sorted(expected, key=repr)


def test_encoders_equal_the_libraries(libraries):
    t, m = libraries
    a, b = ta.ByteLevel(A), ta.Pieces(B)
    rng = random.Random(11)
    parts = ["'", " ", "  ", "\n", "\t", "a", "The", "'s", "'ll", "1", "23", "é", "×", "\x0b", "\xa0", "--", "...", "日本", "🙂", "▁",
             "<|endoftext|>", "<s>", "don't", "É", " ", "ſ", "word", "ing"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(4_000)] + [x for _, x in TEXTS if x]
    for text in texts:
        assert a.ids(text).tolist() == t.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert b.ids(text).tolist() == m.encode(text), repr(text)
