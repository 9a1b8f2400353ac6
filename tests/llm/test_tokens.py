"""BPE with chunk reuse, token files and token counts against the libraries."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as E
from convolens.llm import chunk_reuse, token_counts, token_files
from convolens.llm.vocab import Encoder

SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, name string, ids int, pos int"  # clashing extra columns
PASSAGE = " ".join(f"Wörd{i} shared's passage," for i in range(120))
ROWS = [
    (3, "alpha " + PASSAGE + " omega"), (1, PASSAGE), (2, "é́ Σας ΣΑΣ İ ǰ <|endoftext|> " + PASSAGE), (4, None), (5, ""),
    (6, "x" * 30_000 + " tail"), (7, "日本語" * 4000), (8, PASSAGE), (8, PASSAGE), (8, "other text"), (None, "no id"),
    (9, " \n\t "), (10, ("deadbeef" * 2000) + PASSAGE), (11, "a b" * 70_000),
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(d, t, "n", 1, 2) for d, t in ROWS], SCHEMA).repartition(3)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_memo_is_exact(tok):
    enc = Encoder(PATH)
    assert enc.by_words
    rng = random.Random(7)
    pool = [chr(c) for c in range(1, 384)] + list("ΣσςİıǰJ̌́日本語ß'’<|>…😀‍") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def brute_op6(tok, rows):
    out = []
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        dec = tok.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chunk_reuse_small(spark, small, tok):
    assert sorted_rows(chunk_reuse.digests(chunk_reuse.encode_decode(small, PATH))) == brute_op6(tok, ROWS)
    assert chunk_reuse.encode_decode(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_chunk_reuse_query(spark, tok):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted_rows(E.queries()["op6_chunk_bpe"](spark, SF)) == brute_op6(tok, rows)


def test_chunks_are_content_defined():
    data = PASSAGE.encode() * 3
    a = {c for c in chunk_reuse.chunks(b"prefix that moves everything " + data)}
    b = {c for c in chunk_reuse.chunks(data)}
    assert b"".join(chunk_reuse.chunks(data)) == data
    assert len(a & b) >= len(b) / 2
    for c in chunk_reuse.chunks(("é" * 40_000).encode()):
        c.decode()


def test_joins_are_repaired_with_reused_ids(tok):
    enc = Encoder(PATH)
    data = ("lead " + PASSAGE + " x" * 9000 + "y" * 20_000 + " end").encode()
    shared = {k: enc.packed(c.decode()) for k, c in enumerate(chunk_reuse.chunks(data))}
    for some in (shared, {}, dict(list(shared.items())[::2])):
        got = np.frombuffer(chunk_reuse.assemble(enc, data, some), enc.dtype).tolist()
        assert got == tok.encode(data.decode(), add_special_tokens=False).ids


def test_joins_of_random_texts(tok):
    """Chunk borders fall anywhere: inside words, specials, combining marks."""
    enc = Encoder(PATH)
    rng = random.Random(11)
    pool = ["word", "Ä", "ß", "é", "\u0301", "Σ", "<|endoftext|>", "<|start", "'s", "'LL", "12", "!!", "日本", "😀", "İ"]
    for _ in range(150):
        glue = rng.choice([" ", "", "\n", "\t ", "\u00a0"])
        text = "".join(rng.choice(pool) + (glue if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 900)))
        data = text.encode()
        shared = {k: enc.packed(c.decode()) for k, c in enumerate(chunk_reuse.chunks(data)) if rng.random() < 0.5}
        got = np.frombuffer(chunk_reuse.assemble(enc, data, shared), enc.dtype).tolist()
        assert got == tok.encode(text, add_special_tokens=False).ids


def brute_op8(tok, rows):
    out, at = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind,block", [("byte", 1 << 16), ("bit", 1000), ("byte", 7)])
def test_token_files_small(spark, small, tok, kind, block):
    rows = ROWS if block > 100 else ROWS[:3]
    df = small if block > 100 else spark.createDataFrame([(d, t, "", 0, 0) for d, t in rows], SCHEMA)
    path = token_files.write_tokens(df, PATH, 2, block=block, kind=kind)
    back = token_files.read_documents(spark, path, with_ids=True).collect()
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back), key=repr)
    assert got == brute_op8(tok, rows)
    for r in back:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens


def test_one_null_id_on_most_rows(spark, tok):
    """Token files and chunk reuse with 70 % of the rows under a null id, most of them equal."""
    rows = [(None, "the same row " + PASSAGE)] * 250 + [(None, f"own text {i}") for i in range(100)] + [(i, PASSAGE) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        path = token_files.write_tokens(df, PATH, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = {r["part"]: r["sum(n)"] for r in spark.read.parquet(path).selectExpr("part", "size(lengths) n").groupBy("part").sum("n").collect()}
    assert len(parts) >= 6 and max(parts.values()) < 150  # 350 rows of one id
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, path).collect())
    want = sorted((repr(d), n, c) for d, _, n, c in brute_op8(tok, rows))
    assert got == want
    starts = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in token_files.read_documents(spark, path).collect())
    assert all(a[0] + a[1] == b[0] and a[2:] <= b[2:] for a, b in zip(starts, starts[1:])) and starts[0][0] == 0
    encoded = chunk_reuse.encode_decode(df, PATH)
    found = Counter((r.doc_id, np.frombuffer(r.ids, "<u4").tobytes()) for r in encoded.collect())
    ids = {t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for _, t in rows}
    assert found == Counter((d, ids[t]) for d, t in rows)


def test_equal_rows_come_out_again(spark):
    df = spark.createDataFrame([(1, PASSAGE)] * 40 + [(2, "x")], "doc_id long, text string").coalesce(1)
    assert chunk_reuse.encode_decode(df, PATH).count() == 41


def test_token_files_empty(spark):
    path = token_files.write_tokens(spark.createDataFrame([], SCHEMA), PATH, 2)
    assert token_files.read_documents(spark, path).count() == 0


def test_token_files_query(spark, tok):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted_rows(E.queries()["op8_token_files"](spark, SF)) == brute_op8(tok, rows)


def test_blocks_round_trip_and_crc_join():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 1000):
        for dtype in ("<u2", "<u4"):
            ids = rng.integers(0, 49408, n).astype(dtype)
            for kind in token_files.KINDS:
                assert token_files.unpack_block(token_files.pack_block(ids, kind)).tolist() == ids.tolist()
    for a, b in ((b"", b"abc"), (b"abc", b""), (b"abc" * 99, b"x" * 12345)):
        assert token_files.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def brute_spans(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data, at, out = text.encode(), 0, []
    for token in enc.encode_ordinary(text):
        end = at + len(enc.decode_single_token_bytes(token))
        touched = [i for i in range(at, end)]
        chars = sorted({len(data[: b + 1].decode(errors="ignore")) if data[b] < 0x80 else sum(x & 0xC0 != 0x80 for x in data[: b + 1]) for b in touched})
        out.append((chars[0] - 1, chars[-1]))
        at = end
    return out


def brute_op10(rows, rule):
    """Sections are lines with their line break; the tokens are those of the text itself."""
    out = []
    for d, t, *_ in rows:
        lines = re.findall(r"[^\n]*\n|[^\n]+", t or "") or [""]
        ends = [sum(map(len, lines[: k + 1])) for k in range(len(lines))]
        counts, crossing = [0.0] * len(ends), [0] * len(ends)
        starts = [0, *ends[:-1]]
        for a, b in brute_spans(t or ""):
            parts = [(k, min(b, ends[k]) - max(a, starts[k])) for k in range(len(ends)) if min(b, ends[k]) > max(a, starts[k])]
            if len(parts) > 1:
                for k, _ in parts:
                    crossing[k] += 1
            if rule == "first":
                counts[parts[0][0]] += 1
            elif rule == "most":
                counts[max(parts, key=lambda p: (p[1], -p[0]))[0]] += 1
            else:
                for k, n in parts:
                    counts[k] += n / (b - a)
        out += [(d, "text", k, starts[k], ends[k], round(counts[k], 9), crossing[k]) for k in range(len(ends))]
    return sorted(out, key=repr)


def test_token_counts_sum_to_the_document(spark):
    """Against the tokenizers library's file of the same vocabulary."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "long words and lines\n" * 20_000), (-4, "\n")]
    schema = "doc_id long, text string, field string, section int, n_tokens string, char_start long"  # clashing names
    df = spark.createDataFrame([(d, t, "f", 1, "n", 2) for d, t in rows], schema)
    got = token_counts.token_counts(df, RANKS, P.PATTERN, ["text"]).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in rows}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    rows = [(1, "one two\n\n\n  three\n\nfour"), (2, None), (3, ""), (4, "日本\n語😀é\n\n"), (5, "\n"), (5, "\n"), (None, "x\n y"), (6, "line\n" * 300)]
    df = spark.createDataFrame([(d, t, "", 0, 0) for d, t in rows], SCHEMA)
    got = token_counts.token_counts(df, RANKS, P.PATTERN, ["text"], rule=rule).collect()
    assert sorted(((*tuple(r)[:5], round(r.n_tokens, 9), r.n_crossing) for r in got), key=repr) == brute_op10(rows, rule)


def test_token_counts_fields_and_query(spark):
    rows = [(1, "title", "body of text"), (2, None, "only body")]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string")
    got = token_counts.token_counts(df, RANKS, P.PATTERN, ["title", "body"], lines=False).collect()
    for d, t, b in rows:
        total = len(brute_spans((t or "") + "\n" + b))
        assert sum(r.n_tokens for r in got if r.doc_id == d) == total
        assert [r.field for r in sorted(got, key=lambda r: r.char_start) if r.doc_id == d] == ["title", "body"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    some = {d for d, _ in docs}
    got = [r for r in E.queries()["op10_token_counts"](spark, SF).collect() if r.doc_id in some]
    assert sorted(((*tuple(r)[:5], round(r.n_tokens, 9), r.n_crossing) for r in got), key=repr) == brute_op10(docs, "most")
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN, ["text"]).count() == 0
