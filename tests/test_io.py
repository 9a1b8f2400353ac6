"""Sources, sinks, recipes and the streaming refresh."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from convolens.operators import features as FT
from convolens.plans.recipe import RECIPES, Recipe, get_recipe
from convolens.sources import readers as R
from convolens.sources import sinks as K
from convolens.sources.adapters import message_rows

SF = "/root/testdata/sf0.001"


def scratch():
    return tempfile.mkdtemp(prefix="convolens-test-")


def test_parameterised_query(spark):
    spark.range(10).createOrReplaceTempView("nums")
    df = R.parameterised_query(spark, "SELECT id FROM nums WHERE id >= %(lo)s AND id < %(hi)s", {"lo": 3, "hi": 6})
    assert [r.id for r in df.collect()] == [3, 4, 5]
    with pytest.raises(KeyError):
        R.parameterised_query(spark, "SELECT id FROM nums WHERE id = %(x)s", {})
    with pytest.raises(ValueError):
        R.parameterised_query(spark, "   ")


def test_csv_roundtrip_and_versioned_runs(spark):
    d = scratch()
    leads = spark.createDataFrame([("0551234567", "Ana", None), ("5512345678", "Luis", "x")],
                                  "cleaned_phone_number string, name string, note string")
    paths = K.export_data(leads, d, "leads", ["csv", "json", "xml"])
    assert set(paths) == {"csv", "json"}
    back = R.read_leads_csv(spark, paths["csv"])
    rows = {r.cleaned_phone: r for r in back.collect()}
    assert "0551234567" in rows  # leading zero kept: phones are text
    assert rows["0551234567"].note is None or rows["0551234567"].note == ""
    with pytest.raises(ValueError):
        K.export_data(leads, d, "x", ["xml"])
    runs = os.path.join(d, "runs")
    K.write_versioned(leads, runs, "2024-01-01T10-00")
    K.write_versioned(leads.limit(1), runs, "2024-01-02T10-00")
    assert K.read_latest(spark, runs).count() == 1
    assert K.export_formats("all") == ["csv", "json"] and K.export_formats("both") == ["csv"]


def test_sheet_prep(spark):
    df = spark.createDataFrame(
        [(" 3/15/2024 10:30 ", "+52 1 55 1234 5678", "Ana"), ("bad", "5512345678", "B"), ("3/1/2024", "123", "C"),
         (None, None, None)],
        "`Fecha ` string, Telefono string, Nombre string")
    out = R.prepare_sheet_leads(df, "Fecha", "Telefono", {"name": "Nombre", "email": "Correo"}).collect()
    assert len(out) == 1
    assert out[0].cleaned_phone == "5512345678" and out[0].lead_created_at == "2024-03-15 10:30:00"
    assert out[0].email == ""


def test_daily_extract_reuse(spark):
    d = os.path.join(scratch(), "extract")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert R.daily_extract(spark, d, "2024-01-05", compute).count() == 3
    assert R.daily_extract(spark, d, "2024-01-05", compute).count() == 3
    assert len(calls) == 1


def test_recipes_validate_and_lint():
    assert set(RECIPES) == {"simulation_to_handoff", "marzo_cohorts", "marzo_cohorts_live",
                            "fede_abril_preperfilamiento", "top_up_may", "formalizacion"}
    for r in RECIPES.values():
        assert r.lint() == [], r.name
    with pytest.raises(ValueError):
        Recipe(name="x", schema_version=1)
    with pytest.raises(ValueError):
        Recipe(name="x", processors=(("TemporalProcessor", (("skip_hours_minutes", True),)),))
    r = get_recipe("fede_abril_preperfilamiento")
    assert [f.alias for f in r.features(only=["human_transfer"])] == ["human_transfer"]
    assert "pre_validacion_detected" in r.result_columns()


def test_streaming_refresh_matches_batch(spark):
    from convolens.streaming.refresh import latest_features, refresh_features

    d = scratch()
    src = os.path.join(d, "incoming")
    m = message_rows(spark, SF)
    # two arrivals: early turns first, later turns second
    m.where("src_ord < 2").write.mode("append").parquet(src)
    q = refresh_features(spark, src, os.path.join(d, "hist"), os.path.join(d, "feat"), name=f"t{os.getpid()}a")
    q.awaitTermination(120)
    m.where("src_ord >= 2").write.mode("append").parquet(src)
    q = refresh_features(spark, src, os.path.join(d, "hist"), os.path.join(d, "feat"), name=f"t{os.getpid()}a")
    q.awaitTermination(120)
    got = latest_features(spark, os.path.join(d, "feat"))
    want = FT.conversation_features(m, FT.chain(FT.DEFAULT_CHAIN))
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
