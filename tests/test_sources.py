"""Parallel quoted CSV, batched fetches, versioned runs, the result cache."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from convolens.operators import incremental as INC
from convolens.operators.transcript import conversation_digest
from convolens.sources import readers as R
from convolens.sources import sinks as K
from convolens.sources.adapters import message_rows

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_csv(path, n, seed, header="phone,text,note", end="\n", bom=False):
    rng = random.Random(seed)
    parts = ["a", ",", "\n", '""', "ñ", " b", "\n\n", "x,y", "7", "long " * 30]
    def cell():
        text = "".join(rng.choices(parts, k=rng.randint(0, 4)))
        return f'"{text}"' if any(c in text for c in ',\n"') or rng.random() < 0.2 else text
    lines = [header] + [f"{i},{cell()},{cell()}" for i in range(n)]
    if seed % 2:
        lines.insert(n // 2, "")  # a blank line between records
    path.write_text(("﻿" if bom else "") + end.join(lines) + (end if seed % 3 else ""), encoding="utf-8", newline="")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quoted_csv_is_split_and_equals_the_whole_file_reader(spark, tmp_path, seed):
    p = tmp_path / "m.csv"
    odd_csv(p, 400, seed, bom=seed == 2)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "700b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = R.read_quoted_csv(spark, str(p))
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 10
        rows = got.orderBy("record_no").collect()
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(p))).collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(r) for r in want] and len(rows) == 400
    assert [r.record_no for r in rows] == list(range(1, 401))


def test_quoted_csv_of_several_files_and_line_ends(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(3):
        odd_csv(d / f"part-{i}.csv", 30, 5 + i, end="\r\n" if i == 1 else "\n")
    got = R.read_quoted_csv(spark, str(d))
    want = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(d))
    assert rows_of(got.drop("record_no")) == rows_of(want) and got.select("record_no").distinct().count() == 90
    (d / "empty.csv").write_text("phone,text,note\n")
    assert R.read_quoted_csv(spark, str(d)).count() == 90
    assert R.read_quoted_csv(spark, str(d / "empty.csv")).count() == 0


def test_failed_batches_are_logged_and_left_out(spark):
    store = {f"55{i:08}": [(f"55{i:08}", f"hola {n}", n) for n in range(i % 3)] for i in range(60)}
    keys = spark.createDataFrame([(k,) for k in store] * 2 + [(None,)], "phone string")

    def fetch(batch):
        if "5500000007" in batch:
            raise TimeoutError("warehouse")
        assert len(batch) <= 4
        return [row for k in batch for row in store[k]]

    rows, failures = R.fetch_batches(keys, fetch, "phone string, text string, n int", batch_size=4, concurrency=3)
    failed = failures.collect()
    assert len(failed) == 1 and failed[0].error == "TimeoutError: warehouse" and "5500000007" in failed[0]["keys"]
    want = [row for k, own in store.items() if k not in failed[0]["keys"] for row in own]
    assert rows_of(rows) == sorted(want, key=repr) and rows.columns == ["phone", "text", "n"]

    def down(batch):
        raise ConnectionError("down")

    with pytest.raises(RuntimeError, match="all .* batches failed"):
        R.fetch_batches(keys, down, "phone string, text string, n int")
    rows, failures = R.fetch_batches(keys.limit(0), down, "phone string, text string, n int")
    assert rows.count() == 0 and failures.count() == 0


def test_csv_has_a_byte_order_mark(spark, tmp_path):
    leads = spark.createDataFrame([("0551234567", 'say "hi", ok'), ("5512345678", None)], "cleaned_phone string, note string").coalesce(1)
    path = K.write_csv(leads, str(tmp_path / "out.csv"))
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    data = open(os.path.join(path, part), "rb").read()
    assert data.startswith(b"\xef\xbb\xbfcleaned_phone,note") and data.count(b"\xef\xbb\xbf") == 1
    assert R.read_leads_csv(spark, path).columns == ["cleaned_phone", "note"]
    K.write_csv(leads, str(tmp_path / "bare.csv"), bom=False)
    assert R.read_leads_csv(spark, str(tmp_path / "bare.csv")).columns == ["cleaned_phone", "note"]


def test_the_latest_run_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    with pytest.raises(FileNotFoundError):
        K.read_latest(spark, path)
    K.write_versioned(one, path, "2024-01-01T10-00")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr("convolens.sources.versioned._Files.publish", dies)
        with pytest.raises(KeyboardInterrupt):
            K.write_versioned(two, path, "2024-01-02T10-00")
    assert K.read_latest(spark, path).count() == 3
    for _ in range(2):  # a run that is written twice
        K.write_versioned(two, path, "2024-01-02T10-00")
    assert K.read_latest(spark, path).count() == 5 and K.read_run(spark, path, "2024-01-01T10-00").count() == 3
    with pytest.raises(FileNotFoundError):
        K.read_run(spark, path, "2024-01-03T10-00")
    assert K.run_stamp(datetime(2024, 1, 2, 3, 4)) == "2024-01-02T03-04"


def test_extract_falls_back_to_the_newest(spark, tmp_path):
    path = str(tmp_path / "extract")

    def broken():
        raise OSError("no warehouse")

    with pytest.raises(OSError):
        R.daily_extract(spark, path, "2024-01-01", broken)
    assert R.daily_extract(spark, path, "2024-01-01", lambda: spark.range(3)).count() == 3
    assert R.daily_extract(spark, path, "2024-01-02", broken).count() == 3
    assert R.daily_extract(spark, path, "2024-01-02", lambda: spark.range(4)).count() == 4


def test_result_cache(spark, tmp_path):
    schema = "cleaned_phone string, conversation_digest string, payload string, scored_at timestamp"
    t = datetime(2024, 1, 1)
    cache = INC.ResultCache(spark, str(tmp_path / "c"))
    now = spark.createDataFrame([("p", "d1"), ("q", "d2"), ("r", None)], "cleaned_phone string, conversation_digest string")
    assert cache.needed(now).count() == 3 and cache.hits(now).count() == 0
    cache.add(spark.createDataFrame([("p", "d1", "old", t), ("p", "d1", "new", datetime(2024, 1, 2)), ("q", None, "x", t)], schema), "run-1")
    cache.add(spark.createDataFrame([("p", "d1", None, datetime(2024, 1, 3)), ("q", "d9", "y", t)], schema), "run-2")  # a corrupt entry hides nothing
    cache.add(spark.createDataFrame([("q", "d2", "twice", t)], schema), "run-2")  # repeated under its name: ignored
    assert [(r.cleaned_phone, r.payload) for r in cache.hits(now).collect()] == [("p", "new")]
    assert sorted(r.cleaned_phone for r in cache.needed(now).collect()) == ["q", "r"]


def test_old_digests_come_from_one_scan(spark):
    m = message_rows(spark, SF, keep_conv_id=True)
    drop = F.col("conv_id") % 3 == 0
    both = INC.version_digests(m, drop)
    assert both._jdf.queryExecution().executedPlan().toString().count("conversations.parquet") == 1
    plain = conversation_digest(m)
    assert rows_of(both.select(plain.columns)) == rows_of(plain)
    from pyspark.sql import Window

    from convolens.operators.features import order_key

    back = F.row_number().over(Window.partitionBy("cleaned_phone").orderBy(order_key(m.columns).desc()))
    earlier = conversation_digest(m.withColumn("back", back).where(~(drop & (F.col("back") == 1))).drop("back"))
    got = both.where("old_messages > 0").selectExpr("cleaned_phone", "old_digest", "old_messages")
    assert rows_of(got) == rows_of(earlier)


def test_cache_queries_scan_conversations_once(spark):
    import __spark_entry__ as E

    for name in ("score_needed", "cache_hits"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("conversations.parquet") == 1
