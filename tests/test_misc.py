"""Smaller helpers: masking, lead names, lenient dates, observe counts, E2, U1."""

import pytest
from pyspark.sql import functions as F

from convolens.functions import lead_name, mask_sensitive, parse_ts_month_first
from convolens.functions.timefmt import age_text
from convolens.operators import features as FT
from convolens.operators import report as RP
from convolens.sources.readers import union_chunks


def test_mask_sensitive(spark):
    df = spark.createDataFrame([("5512345678", "a@b.com", "x")], "phone string, user_email string, note string")
    r = mask_sensitive(df).first()
    assert r.phone == "[REDACTED]" and r.user_email == "[REDACTED]" and r.note == "x"


def test_lead_name(spark):
    df = spark.createDataFrame([("Hola *Ana María*! Bienvenida",), ("Hola Ana",)], "m string")
    assert [r[0] for r in df.select(lead_name("m")).collect()] == ["Ana María", None]


def test_month_first_dates(spark):
    df = spark.createDataFrame([("3/15/2024 10:30",), ("2024-03-15",), ("nope",)], "d string")
    got = [r[0] for r in df.select(F.date_format(parse_ts_month_first("d"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-03-15 10:30", "2024-03-15 00:00", None]


def test_age_text(spark):
    df = spark.createDataFrame([(None,), (59 * 60.0,), (69 * 60.0,), (50 * 3600.0,)], "s double")
    got = [r[0] for r in df.select(age_text(F.col("s"))).collect()]
    assert got == ["N/A", "59 min", format(69 / 60, ".1f") + " h", format(50 / 24, ".1f") + " días"]


def test_strict_filter_counts(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(" 5512345678 ",), ("55123",), ("abc5512345678",)], "cleaned_phone string")
    obs = Observation("strict")
    out = RP.strict_phone_filter(df, observation=obs)
    assert [r.cleaned_phone for r in out.collect()] == ["5512345678"]
    assert obs.get == {"kept": 1, "skipped": 2}
    counted, summary = RP.run_summary(df, "leads")
    counted.collect()
    assert summary.get["rows"] == 3
    twice = df.union(df)
    assert tuple(RP.key_counts(twice).first()) == (6, 3)
    assert tuple(RP.key_counts(df.limit(0)).first()) == (0, 0)


def test_dotted_feature_path():
    f = FT.make_feature("convolens.operators.features.Temporal", {"timezone": "UTC"})
    assert isinstance(f, FT.Temporal)
    with pytest.raises(ValueError):
        FT.make_feature("no.such.module.Feature")
    with pytest.raises(TypeError):
        FT.load_feature("convolens.session.get_spark")


def test_union_chunks(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 3.0)], "id int, b double")
    out = union_chunks([a, b])
    assert sorted(out.columns) == ["a", "b", "id"] and out.count() == 2


def test_scans_are_pruned(spark):
    import __spark_entry__ as E

    df = E.queries()["eligible_leads"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "l_extendedprice" not in plan
    assert "PushedFilters: [IsNotNull(o_custkey)" in plan


def test_time_bounds_reach_the_parquet_scan(spark, tmp_path):
    from convolens.operators import messages as MS
    from convolens.sources.adapters import message_rows

    path = str(tmp_path / "messages")
    message_rows(spark, "/root/testdata/sf0.001").write.parquet(path)
    m = spark.read.parquet(path)
    bounded = MS.time_bounds(m, end="2024-01-04 12:00:00", as_of="2024-01-05 00:00:00", lookback_days=90)
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(creation_time), LessThanOrEqual(creation_time" in plan
    assert "GreaterThanOrEqu" in plan.split("PushedFilters:")[1]  # the plan text truncates it


def test_internal_column_never_reaches_a_report(spark):
    df = spark.createDataFrame([("1", "a", "t1"), ("2", None, "t2"), ("3", "c", None)],
                               "lead_id string, summary string, timing_reasoning string")
    out = RP.export_prep(df, ["lead_id", "summary", "timing_reasoning"])
    assert out.columns == ["lead_id", "summary"]
    assert [tuple(r) for r in out.orderBy("lead_id").collect()] == [("1", "a"), ("2", ""), ("3", "c")]
