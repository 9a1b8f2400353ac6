"""Source divergence against brute force in plain integers."""

import random
import re

import pyarrow as pa
import pytest

from convolens.llm import source_divergence as sd
from convolens.llm.source_divergence import Block, merged, source_divergence, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, n int, rank int"  # clashing names
_rng = random.Random(5)
_WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["éa", "日本", "naïve", "UPPER"]
ROWS = [
    (i, " ".join(_rng.choices(_WORDS, [1 / (k + 1) for k in range(len(_WORDS))], k=_rng.randint(1, 60))),
     _rng.choice(["en", "de", None]), _rng.choice(["a", "a", "a", "b", "c", None, "Z", "é"]))
    for i in range(150)
] + [
    (900, None, "en", "only null"), (901, "", "en", "only empty"), (902, "1 2 3 _", "xx", "no terms"),
    (903, "lonely words here", "yy", "s"), (904, "other words there", "yy", "t"),  # a language that keeps no term
    (905, "solo SOLO solo", "zz", "one"), (905, "solo SOLO solo", "zz", "one"), (905, "solo SOLO solo", "zz", "one"),
    (None, "wa Wb, wc", "en", "b"),
    (906, "waa " * 100_000 + "tail", "en", "long"), (907, "waa wab! " * 200_000 + "tail", "en", "longer"),
]


def small(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], SCHEMA)


def brute(rows, min_docs=3, top=200):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))) for _, t, la, so in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = {}
        for _, _, ws in own:
            for w in set(ws):
                seen[w] = seen.get(w, 0) + 1
        kept = sorted((w for w in seen if seen[w] >= min_docs), key=str.encode)
        v = len(kept)
        count = {s: {w: sum(ws.count(w) for _, so, ws in own if so == s) for w in kept} for s in {d[1] for d in own}}
        total = {w: sum(c[w] for c in count.values()) for w in kept}
        n = {s: sum(c.values()) for s, c in count.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (n[s] + v) for w in kept} for s, c in count.items()}
        q = {w: 1 + 10**9 * (total[w] + 1) // (sum(total.values()) + v) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(sum(f(p[s][w], p[t][w]) for w in kept), t) for t in count if t != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if count[s][w] > 0 and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(items[: top if part == "term" else None], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    assert rows_of(source_divergence(small(spark).repartition(4))) == brute(ROWS)


def test_many_runs_pieces_and_flushes(spark, monkeypatch):
    """Blocks of few entries, one shard, low ranks: runs overlap and are merged."""
    got = source_divergence(small(spark).repartition(7), min_docs=2, top=5, block=20, shards=1)
    assert rows_of(got) == brute(ROWS, 2, 5)


def test_empty_table(spark):
    assert source_divergence(small(spark, [])).count() == 0


def test_corrections_do_not_depend_on_batches(monkeypatch):
    """Terms cut over batches, pairs over blocks, sums over flushes: the same totals."""
    rng = random.Random(3)
    rows = sorted(
        (la, f"t{t:03}", f"s{s}", rng.randint(1, 10**9), rng.randint(1, 10**6))
        for la in "xy" for t in range(40) for s in range(9) if rng.random() < 0.6
    )
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "term", "source", "p", "p0"])

    def totals(batches):
        sums = {}
        for b in sd._corrected(iter(batches)):
            for r in b.to_pylist():
                k = r["lang"], r["source"], r["item"]
                sums[k] = (sums.get(k, 0) + r["value"]) % (1 << 64)
        return sums

    f = lambda a, b: (a - b) ** 2 // b
    expected = {}
    for la, t, s, p, p0 in rows:
        for lb, u, o, q, q0 in rows:
            if (la, t) == (lb, u) and s != o:
                k = la, s, o
                expected[k] = (expected.get(k, 0) + f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)) % (1 << 64)
    assert totals([whole]) == expected
    cut = [whole.slice(i, 5) for i in range(0, whole.num_rows, 5)]
    assert totals(cut) == expected
    monkeypatch.setattr(sd, "_PAIRS", 4)
    assert totals(cut) == expected and totals([whole]) == expected


@pytest.mark.parametrize("rows", [1, 40, 10**9])
def test_heap_merge_gives_each_term_once(rows):
    rng = random.Random(1)
    block, pieces, expected = Block(), [], {}
    for n in range(300):
        texts, groups = [], []
        for _ in range(3):
            words = ["x" + "abcdefghij"[k % 10] * (k // 10 + 1) for k in rng.choices(range(80), k=rng.randint(0, 12))]
            group = ("l", rng.choice("ab"))
            texts.append(", ".join(words).upper())
            groups.append(group)
            for w in words:
                expected.setdefault((*group, w), [0, 0])[0] += 1
            for w in set(words):
                expected[*group, w][1] += 1
        block.add(groups[:2], pa.array(["skipped", *texts[:2]])[1:])
        block.add_long(groups[2], texts[2].encode())
        if block.entries > 60:
            pieces += [(first, piece) for _, first, piece in block.run(1)]
    pieces += [(first, piece) for _, first, piece in block.run(1)]
    assert len(pieces) > 20 and block.entries == 0
    tables = list(merged(iter(sorted(pieces)), rows))
    got = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    assert len(got) == len(expected) and {r[:3]: list(r[3:]) for r in got} == expected
    ends = [(min(t["term"].to_pylist()), max(t["term"].to_pylist())) for t in tables]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # whole terms, in term order


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(sd, "_CHUNK", 7)
    for text in ("", "a", "Ab,cD é_f", "x" * 50, "ab " * 20 + "y" * 30 + " z", "   ", "日本語の文 x", "a" * 7, " " * 20 + "b"):
        lists = list(terms_of(text.encode()))
        expected = re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())
        assert [w for part in lists for w in part] == expected


@pytest.mark.parametrize("c,n,v", [(0, 0, 1), (0, 0, 0), (5, 10, 7), (10**12, 10**13, 10**6), (3, 9 * 10**15, 1)])
def test_probability_is_exact(spark, c, n, v):
    from pyspark.sql import functions as F

    long = lambda x: F.lit(x).cast("long")
    got = spark.range(1).select(sd.probability(long(c), long(n), long(v))).first()[0]
    assert got == 1 + 10**9 * (c + 1) // max(n + v, 1)
