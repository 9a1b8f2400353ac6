"""Recipe runs on literal rows, and the shape of their plans."""

from datetime import datetime

import pytest

from convolens.operators import incremental as INC
from convolens.operators import report as RP
from convolens.plans import queries as Q
from convolens.plans.recipe import RECIPES, LabelKey, Recipe, get_recipe, run_recipe
from convolens.sources import adapters as A
from convolens.sources import readers as R
from convolens.sources import sinks as K

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 4, 10)


def messages(spark, *rows):
    return spark.createDataFrame(
        [(p, i, T0, who, text) for i, (p, who, text) in enumerate(rows)],
        "cleaned_phone string, src_ord int, creation_time timestamp, msg_from string, message string")


def leads(spark, *phones):
    return spark.createDataFrame([(p, f"n{i}") for i, p in enumerate(phones)], "cleaned_phone_number string, name string")


def small_recipe(**more):
    return Recipe(name="r", processors=(("TemporalProcessor", ()), ("MessageMetadataProcessor", ())),
                  label_keys=(LabelKey("summary"), LabelKey("primary_stall_reason_code", enum=("A", "B")),
                              LabelKey("suggested_message_es", optional=True)),
                  output_columns=("cleaned_phone", "summary", "suggested_message_es", "extra"), **more)


def test_both_sides_pass_the_key_rules(spark):
    m = messages(spark, ("+52 5512345678", "user", "hola"), (None, "user", "x"), ("123", "user", "x"))
    out = run_recipe(small_recipe(), leads(spark, "5512345678", "no number", None), m).collect()
    assert [(r.cleaned_phone, r.last_message_sender, r.cache_status) for r in out] == [("5512345678", "user", "FRESH")]
    assert out[0].summary == "No conversation data found" and out[0].extra == ""


def test_optional_labels_stay_and_missing_required_ones_are_repaired(spark):
    m = messages(spark, ("5512345678", "user", "hola"), ("5512345679", "user", "hola"))
    lab = spark.createDataFrame([("5512345678", "s", "hola Ana")], "cleaned_phone string, summary string, suggested_message_es string")
    out = {r.cleaned_phone: r for r in run_recipe(small_recipe(), leads(spark, "5512345678", "5512345679"), m, lab).collect()}
    assert out["5512345678"].suggested_message_es == "hola Ana"
    assert out["5512345678"].primary_stall_reason_code == "N/A"  # the label table lacks the column
    assert out["5512345679"].primary_stall_reason_code is None and out["5512345679"].cache_status == "FRESH"


def test_unlisted_error_kind_keeps_its_text(spark):
    m = messages(spark, ("5512345678", "user", "hola"))
    lab = spark.createDataFrame([("5512345678", "s", "A", "Missing keys: summary")],
                                "cleaned_phone string, summary string, primary_stall_reason_code string, error_kind string")
    r = run_recipe(small_recipe(), leads(spark, "5512345678"), m, lab).first()
    assert (r.summary, r.error, r.cache_status) == ("Missing keys: summary", "Missing keys: summary", "ERROR")


def test_raw_responses_become_labels_or_errors(spark):
    phones = ["5512345678", "5512345679", "5512345670"]
    m = messages(spark, *[(p, "user", "hola") for p in phones])
    raw = spark.createDataFrame(list(zip(phones, ["summary: fine\nprimary_stall_reason_code: 'A'", "- x", None])),
                                "cleaned_phone string, raw_response string")
    out = {r.cleaned_phone: r for r in run_recipe(small_recipe(), leads(spark, *phones), m, responses=raw).collect()}
    assert (out[phones[0]].summary, out[phones[0]].primary_stall_reason_code, out[phones[0]].cache_status) == ("fine", "A", "FRESH")
    assert (out[phones[1]].error, out[phones[1]].error_details) == ("ERROR_PROCESSING", "Missing keys: primary_stall_reason_code, summary")
    assert out[phones[2]].error == "ERROR_LLM_NONE"


def plan_counts(df):
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return text.count("conversations.parquet"), text.count("customer.parquet"), text.count("MapInPandas")


@pytest.mark.parametrize("threshold", [None, "-1"])
def test_a_run_scans_its_inputs_few_times(spark, threshold):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    try:
        if threshold:
            spark.conf.set(key, threshold)
        conversations, customers, python = plan_counts(Q.recipe_result(spark, SF))
        # messages: one scan; labels: one
        assert conversations <= 2 and customers <= 3 and python == 0
        conversations, customers, python = plan_counts(Q.QUERIES["error_rows"](spark, SF))
        assert conversations <= 2 and customers <= 1 and python == 0
    finally:
        spark.conf.set(key, old)


def test_lead_query_reads_each_table_as_often_as_it_must(spark):
    df = Q.QUERIES["lead_contact"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 1 and text.count("orders.parquet") <= 2


def test_lead_source_of_every_recipe(spark, tmp_path):
    plans = {"lead_contact": lambda: Q.warehouse_leads(spark, SF)}
    (tmp_path / "leads.csv").write_text("cleaned_phone,name\n0551234567,Ana\n")
    (tmp_path / "q.sql").write_text("SELECT %(a)s AS cleaned_phone")
    for r in RECIPES.values():
        df = R.load_leads(spark, r, base_dir=str(tmp_path), queries=plans)
        assert df.count() > 0 and ("cleaned_phone" in RP.rename_key(df).columns)
    sql = Recipe(name="x", lead_source="bigquery", lead_sql="q.sql")
    assert R.load_leads(spark, sql, {"a": "5"}, str(tmp_path)).first().cleaned_phone == "5"
    with pytest.raises(FileNotFoundError):
        R.load_leads(spark, Recipe(name="x", lead_source="redshift", lead_sql="gone.sql"), base_dir=str(tmp_path))
    with pytest.raises(ValueError):
        R.load_leads(spark, Recipe(name="x", lead_source="redshift", lead_sql="lead_contact"))


def test_columns_by_processor_and_result_schema():
    r = get_recipe("simulation_to_handoff")
    inc, exc = r.columns_for(enabled=["template"], disabled=["HandoffProcessor"])
    assert inc == ["recovery_template_detected", "consecutive_recovery_templates_count"] and "handoff_response" in exc
    types = {f.name: f.dataType.typeName() for f in r.result_schema()}
    assert types["human_transfer"] == "boolean" and types["summary"] == "string"


def test_cache_and_completion_log_round_trip(spark, tmp_path):
    res = spark.createDataFrame([("p", "d1", "x", T0), ("q", None, "y", T0)],
                                "cleaned_phone string, conversation_digest string, payload string, scored_at timestamp")
    cache = INC.ResultCache(spark, str(tmp_path / "cache"))
    cache.add(res)
    cache.add(res.where("cleaned_phone = 'p'").selectExpr("cleaned_phone", "'d2' conversation_digest", "payload", "scored_at"))
    cache = cache.rows(res)
    assert sorted(r.conversation_digest for r in cache.collect()) == ["d1", "d2"]
    now = spark.createDataFrame([("p", "d2"), ("q", "d9")], "cleaned_phone string, conversation_digest string")
    assert [r.cleaned_phone for r in INC.cache_hits(now, cache).collect()] == ["p"]
    assert [r.cleaned_phone for r in INC.score_needed(now, cache).collect()] == ["q"]
    log = str(tmp_path / "log")
    done = spark.createDataFrame([("p", "c", "d2", "me", "", T0)],
                                 "cleaned_phone string, recipe string, digest string, completed_by string, notes string, completed_at timestamp")
    INC.mark_complete(done, log)
    again = spark.read.parquet(log)
    assert INC.completed_leads(again, "c").count() == 1 and INC.completed_leads(again, "z").count() == 0
    cur = now.selectExpr("cleaned_phone", "'c' recipe", "conversation_digest")
    assert {r.cleaned_phone: r.status for r in INC.completion_status(cur, again).collect()} == {"p": "COMPLETED", "q": "ACTIVE"}


def test_error_side_output_and_report_step(spark, tmp_path):
    path = str(tmp_path / "errors")
    rows = spark.createDataFrame([("p", "ERROR_X", "ERROR")], "cleaned_phone string, error string, cache_status string")
    K.write_errors(rows, path, "2024-01-01T10-00")
    K.write_errors(rows.union(rows), path, "2024-01-02T09:00")
    assert K.read_latest(spark, path).count() == 2
    runs = str(tmp_path / "runs")
    K.write_versioned(rows, runs, "2024-01-01T10-00")
    paths = K.report_step(spark, runs, str(tmp_path / "out"), small_recipe())
    assert R.read_leads_csv(spark, paths["csv"]).columns == ["cleaned_phone"]


def test_message_files(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('cleaned_phone_number,creation_time,msg_from,message\n055,2024-01-04 10:00:00,user,"a\nb"\n055,2024-01-04T10:00:00,bot,c\n')
    rows = R.read_messages_csv(spark, str(p)).orderBy("src_ord").collect()
    assert [(r.cleaned_phone, r.msg_from, r.message) for r in rows] == [("055", "user", "a\nb"), ("055", "bot", "c")]
    assert rows[0].creation_time == rows[1].creation_time and rows[0].src_ord < rows[1].src_ord
    j = tmp_path / "r.json"
    j.write_text('[{"a": 1},\n {"a": 2}]')
    assert R.read_records_json(spark, str(j)).count() == 2
    j.write_text('{"a": 1}')
    assert R.read_records_json(spark, str(j), None).first().a == 1
    none = R.empty_messages(spark)
    assert none.count() == 0 and run_recipe(small_recipe(), leads(spark, "5512345678"), none).first().summary == "No conversation data found"
    (tmp_path / "e.sql").write_text(" ")
    with pytest.raises(ValueError):
        R.query_from_file(spark, str(tmp_path / "e.sql"))


def test_local_checkpoint_folder_is_an_error_on_a_cluster(spark):
    from types import SimpleNamespace

    from convolens.session import checkpoint_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        checkpoint_dir(far)


def test_adapters_feed_the_same_recipe(spark):
    out = Q.recipe_result(spark, SF)
    assert out.count() == A.leads_from_customers(spark, SF).count()
