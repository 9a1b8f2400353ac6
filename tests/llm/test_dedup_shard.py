"""Exact dedup, SimHash and sharding against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from convolens.llm.components import components
from convolens.llm.exact_dedup import deduplicated, exact_dedup
from convolens.llm.sharding import jump_hash, shard_documents
from convolens.llm.simhash import near_groups, one_per_group

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, norm int"  # extra columns with clashing names
ROWS = [
    (5, "ab c", "x", 1), (2, " abc", "x", 1), (9, "a\tbc\n", None, 2), (3, None, "y", 3), (4, "", "y", 3),
    (7, "   ", "y", 3), (1, "Abc", "z", 4), (6, "a bc", "z", 4), (8, "x" * 50_000, "q", 5), (10, "x" * 50_000, "q", 5),
    (11, "a b c d e f", "", 6), (11, "a b c d e f", "", 6), (None, "lone", "", 7),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


def brute_dedup(rows):
    groups = {}
    for d, t, *_ in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d is None, d))
    out = []
    for d, t, *_ in rows:
        t = t or ""
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best = min(groups[norm])
        out.append((d, best[2], len(groups[norm]), d == best[2] and len(t) == -best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup_small(small):
    assert tuples(exact_dedup(small)) == brute_dedup(ROWS)


def test_exact_dedup_compares_content_when_digests_collide(small):
    weak = exact_dedup(small, digest=lambda c: F.substring(F.sha2(c, 256), 1, 0))
    assert tuples(weak) == brute_dedup(ROWS)


def test_exact_dedup_empty_and_stage(spark, small):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = deduplicated(small)
    assert kept.columns == small.columns
    want = sorted((d for d, k, n, keep, s in brute_dedup(ROWS) if keep), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(rows):
    fps = np.array([brute_fp(t) for _, t, *_ in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{int(fps[i]):016x}", least.get(find(i))) for i, (d, *_) in enumerate(rows)), key=repr)


def test_simhash_small(spark, small):
    assert tuples(near_groups(small)) == brute_near(ROWS)
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert one_per_group(small).columns == small.columns


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = E.queries()["op2_simhash"](spark, SF)
    assert tuples(got) == brute_near(rows)


def test_near_variants_link(spark):
    base = [f"w{i % 97}x{i}" for i in range(400)]
    rows = [(i, " ".join(base[: 200 + i] + [f"edit{i}"] + base[200 + i :]), "", 0) for i in range(60)]
    rows += [(100 + i, " ".join(f"o{i}y{k}" for k in range(50)), "", 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert tuples(near_groups(df)) == brute_near(rows)


@pytest.mark.parametrize("shape", ["path", "star", "pairs", "empty"])
def test_components(spark, shape):
    n = 200
    edges = {
        "path": [(i, i + 1) for i in range(n)],
        "star": [(0, i) for i in range(1, n)],
        "pairs": [(2 * i, 2 * i + 1) for i in range(n)] + [(3, 3), (None, 1)],
        "empty": [],
    }[shape]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    sets = {}
    for r in got:
        sets.setdefault(r.component, set()).add(r.node)
    want = {
        "path": [set(range(n + 1))],
        "star": [set(range(n))],
        "pairs": [{2 * i, 2 * i + 1} for i in range(n)],
        "empty": [],
    }[shape]
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want))


HOT_IDS = [
    (None, "one two three", "a", 0), (None, "one two three", "b", 0), (None, "onetwo three", "c", 0), (None, "alone here", "d", 0),
    (4, "four five six", "e", 0), (4, "four five six", "e", 0), (4, "quite another text", "f", 0), (3, "quite another  text", "g", 0),
    (4, "four five  six", "h", 0), (8, "four five six", "i", 0),
]


def test_rows_with_a_null_or_repeated_id_are_judged_one_by_one(spark):
    df = spark.createDataFrame(HOT_IDS, SCHEMA).repartition(3)
    exact = tuples(deduplicated(df, repeats=False).select("doc_id", "text"))
    assert exact == sorted([(None, "one two three"), (None, "alone here"), (4, "four five  six"), (3, "quite another  text")], key=repr)
    assert sorted((r.digest for r in deduplicated(df).collect())) == ["a", "b", "d", "g", "h"]
    groups = {}
    for d, t, x, _ in HOT_IDS:
        groups.setdefault(brute_fp(t), []).append((d is None, d, x))
    near = one_per_group(df, max_bits=0)
    assert near.columns == df.columns
    kept = [(brute_fp(r.text), r.doc_id) for r in near.collect()]
    assert sorted(kept, key=repr) == sorted(((f, min(g, key=lambda r: r[:1] + (r[1] or 0,))[1]) for f, g in groups.items()), key=repr)


def brute_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = list(range(300)) + [-1, -5, 2**63 - 1, -(2**63), 123456789012345678]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: brute_jump(k, n) for k in keys}
    assert df.select(F.lit(None).cast("long").alias("k")).select(jump_hash(F.col("k"), 16)).first()[0] == brute_jump(0, 16)


def test_sharding(spark, small):
    for df, rows in ((small, ROWS), (None, None)):
        if df is None:
            df = spark.read.parquet(f"{SF}/documents.parquet")
            rows = [(r.doc_id, r.text) for r in df.collect()]
            got = E.queries()["op9_sharding"](spark, SF).collect()
        else:
            got = shard_documents(df, 16).collect()
        want = sorted(
            ((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute_jump(d or 0, 16), brute_jump(d or 0, 17)) for d, t, *_ in rows),
            key=repr,
        )
        assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got), key=repr) == want
        slots = {}
        for r in got:
            assert r.law == "key" and r.grown_shard in (r.shard, 16)
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(spark.createDataFrame([], SCHEMA), 16).count() == 0


def test_sharding_of_text_ids_hot_ids_and_clashing_names(spark):
    names = "doc_id string, text string, size int, slot string, law int, shard string, grown_shard int, msg_idx int"
    rows = [(None, f"row {i % 40}") for i in range(700)] + [(f"id-{i}", f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(i, t, 1, "s", 2, "x", 3, 4) for i, t in rows], names).repartition(6)
    got = shard_documents(df, 16).collect()
    key = lambda i: xxhash.xxh64(i.encode(), seed=42).intdigest() if i is not None else 0
    want = [(i, len(t) + 1, zlib.crc32(t.encode()), brute_jump(key(i), 16), brute_jump(key(i), 17)) for i, t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got), key=repr) == sorted(want, key=repr)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id is not None, r.doc_id or "", r.text_crc32))
    for own in slots.values():
        assert [s for s, *_ in sorted(own)] == list(range(len(own)))
        assert [x[1:] for x in sorted(own)] == sorted(x[1:] for x in own)  # by id, then text


def test_a_hot_id_is_spread_over_tasks(spark):
    """A null id on 70 % of the rows, most of them equal rows."""
    from convolens.operators.prefix import PLACE, with_prefix

    rows = [(None, "the same row")] * 2_800 + [(i, f"t{i}") for i in range(1_200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(r.slot for r in shard_documents(df, 1).collect()) == list(range(4_000))
    order = F.struct("doc_id", "text", F.monotonically_increasing_id())
    placed, _ = with_prefix(df.withColumn("shard", F.lit(0)), "shard", order, {"slot": F.lit(1).cast("long")}, partitions=16)
    tasks = [r["count"] for r in placed.groupBy(F.shiftright(PLACE, 33)).count().collect()]
    assert len(tasks) > 10 and max(tasks) < 700
