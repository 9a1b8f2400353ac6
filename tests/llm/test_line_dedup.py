"""Line dedup against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from convolens.llm.line_dedup import kept_lines, line_bitmaps, line_counts, line_dedup

SCHEMA = "doc_id long, text string, row int, key string, dropped int, t1 long, line string"  # clashing names too
LONG, OTHER = "this line is long enough", "another line, just as long"
TEXTS = [
    (1, f"{LONG}\nshort\n{OTHER}"),
    (2, f"  {LONG.upper()}\t\nshort\n"),
    (3, f"{LONG}\n{LONG}\nshort\n\x0b{LONG}\x0c"),
    (4, f"{OTHER}\nshort"),
    (5, None),
    (6, ""),
    (7, "\n\n"),
    (8, "x" * 19 + "\n" + "y" * 20 + "\n" + "é" * 20),
    (9, "x" * 19 + "\n" + "y" * 20 + "\n" + "É" * 20),
    (10, "x" * 19 + "\n" + "y" * 20 + "\n" + "é" * 20),
    (10, "x" * 19 + "\n" + "y" * 20 + "\n" + "é" * 20),  # a repeated row
    (10, "é" * 20 + "\nanother text of the same id"),
    (None, f"{LONG}\nnull id\n{OTHER}"),
    (None, "held by null ids only, so it stays\nz"),
    (None, "held by null ids only, so it stays"),
    (None, "held by null ids only, so it stays"),
    (11, "\n".join([LONG, "own line"] * 5_000)),  # long, a cut at every second line
    (12, f"{LONG} \n{LONG}"),
    (13, "\n".join(f"filler line number {i % 700} of many" for i in range(3_000))),
    (14, "\n".join(f"filler line number {i} of many" for i in range(700))),
    (15, "\n".join(f"filler line number {i} of many" for i in range(699, -1, -1)) + "\nend"),
]


def small(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 0, "k", 1, 2, "l") for i, t in texts], SCHEMA)


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute(texts, min_chars=20, min_docs=3):
    docs = [(i, (t or "").split("\n")) for i, t in texts]
    holders = {}
    for n, (_, lines) in enumerate(docs):
        for k in {key_of(x) for x in lines}:
            holders.setdefault(k, set()).add(n)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, lines in docs:
        kept = []
        for line in lines:
            k = key_of(line)
            hot = len(k) >= min_chars and len(holders[k]) >= min_docs
            if not hot or rank(i) == max(rank(docs[n][0]) for n in holders[k]):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [(20, 3), (1, 2), (0, 1)])
def test_line_dedup_equals_brute_force(spark, least):
    assert rows_of(line_counts(line_dedup(small(spark).repartition(5), *least))) == brute(TEXTS, *least)


def test_line_dedup_hot_line_and_hot_null_id(spark):
    """A line in every document, and 70 % of the rows with a null id and one text."""
    texts = [(None, f"{LONG}\nthe same row again")] * 700 + [(i, f"{LONG}\nrow {i}\n{OTHER}") for i in range(300)]
    assert rows_of(line_counts(line_dedup(small(spark, texts).repartition(6)))) == brute(texts)


def test_line_dedup_empty_table(spark):
    judged = line_counts(line_dedup(small(spark, [])))
    assert judged.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and judged.count() == 0


def test_bitmaps_name_lines_and_leave_out_whole_words(spark):
    texts = [(n, "\n".join([f"only in {n}: {i} and more" for i in range(200)] + [LONG])) for n in range(4)]
    bitmaps = {r["doc_id"]: r["dropped"] for r in line_bitmaps(small(spark, texts)).collect()}
    assert set(bitmaps) == {0, 1, 2}
    assert [tuple(w) for w in bitmaps[0]] == [(200 // 64, 1 << (200 % 64))]
    last = [(0, "\n".join(["x"] * 63 + [LONG])), (1, LONG), (2, LONG)]  # the sign bit of a word
    applied = line_dedup(small(spark, last)).filter("doc_id = 0").select(kept_lines(F.col("text"), F.col("dropped")))
    assert applied.first()[0] == "\n".join(["x"] * 63)


def test_native_plan(spark):
    plan = line_dedup(small(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
