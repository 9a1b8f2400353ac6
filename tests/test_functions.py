"""Scalar functions: phones, e-mails, digest, redaction, enum repair, parsing."""

from pyspark.sql import functions as F

from convolens.functions import (
    clean_email,
    clean_email_sql,
    phone_first10,
    phone_last10,
    phone_last10_strict,
    redact_pii,
    text_digest,
)
from convolens.operators import labels as LB


def one(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_phone_rules(spark):
    raw = ["+52 1 5512345678", "5215512345678", "55-1234-5678", "123"]
    assert one(spark, raw, phone_first10) == ["5512345678", "5215512345", None, None]
    assert one(spark, raw, phone_last10) == ["5512345678", "5512345678", "5512345678", "123"]
    assert one(spark, raw, phone_last10_strict) == ["5512345678", "5512345678", "5512345678", ""]


def test_email_rules(spark):
    raw = ["FooBar@example.com", "Foo+Alias@Example.com", "", None, "foo@ex+ample.com"]
    assert one(spark, raw, clean_email) == ["foobar@example.com", "foo@example.com", "", "", "foo@ex+ample.com"]
    assert one(spark, raw[-1:], clean_email_sql) == ["foo@ex@ex+ample.com"]


def test_digest_normalises_whitespace(spark):
    d = one(spark, ["  a \n b ", "a b"], text_digest)
    assert d[0] == d[1] == "0cc9cd4dd26c5137b675a0d819cb9ab0"


def test_redaction(spark):
    out = one(spark, ["call 5512345678 now", "mail a.b@ex.com", "nothing here", "x 123456789 y"], redact_pii)
    assert out == ["call [PHONE_REDACTED] now", "mail [EMAIL_REDACTED]", "nothing here", "x 123456789 y"]


def parsed(spark, *texts, required=("a",)):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, raw_response string")
    return [r for r in sorted(LB.parse_labels(df, required=list(required)).collect(), key=lambda r: r.i)]


def test_response_cleaning(spark):
    tail = '\ntransfer_context_analysis: "N/A"'
    cases = {
        "```yaml\nkey: value\n```": "key: value" + tail,
        "```\nkey: value\n```": "key: value" + tail,
        "key: value": "key: value" + tail,
        'reason: "User said "hello" yesterday"': "reason: 'User said \"hello\" yesterday'" + tail,
        "a: x: y": 'a: "x: y"' + tail,
        "a: x\nmore of x\nb: y": "a: x\n  more of x\nb: y" + tail,
        '"a" : x\ntransfer_context_analysis: z': "a: x\ntransfer_context_analysis: z",
        "transfer_context_analysis: z\nsuggested_message_es: hi\\nrubbish": "transfer_context_analysis: z\nsuggested_message_es: hi",
    }
    assert [r.cleaned for r in parsed(spark, *cases)] == list(cases.values())


def test_response_parsing(spark):
    ok = parsed(spark, "a: 1\nb: two", "a: 'it''s'\nb: \"x \\\"y\\\"\"", "a: one\nthen more\na: last", "b: yes # sure\na:", "a: ~")
    assert [r.error for r in ok] == [None] * 5
    assert [(r.labels["a"], r.labels.get("b")) for r in ok] == [
        ("1", "two"), ("it's", 'x \\"y\\"'), ("last", None), (None, "True"), (None, None)]
    assert parsed(spark, "x", "- just a list\n- 2\n", None, "", "b: 1")[0].labels is not None  # only the default line
    assert [r.error for r in parsed(spark, None, "b: 1")] == ["ERROR_LLM_NONE", "Missing keys: a"]
    none = parsed(spark, "- transfer_context_analysis", "transfer_context_analysis")
    assert [r.error for r in none] == ["Expected a mapping"] * 2


def test_failed_labels_become_error_rows(spark):
    df = spark.createDataFrame([("p", None), ("q", "summary: x"), ("r", "summary: x\nnext_action_code: ESPERAR")],
                               "cleaned_phone string, raw_response string")
    keys = ["summary", "next_action_code"]
    lab = LB.label_columns(LB.parse_labels(df, required=keys), keys)
    out = {r.cleaned_phone: r for r in LB.apply_error_kinds(lab).collect()}
    assert out["p"].summary == "ERROR: LLM summarization failed." and out["p"].next_action_code == "ERROR_LLM_NONE"
    assert out["q"].next_action_code == "ERROR_PROCESSING" and out["q"].error_details == "Missing keys: next_action_code"
    assert out["r"].summary == "x" and out["r"].error_kind is None
    odd = spark.createDataFrame([("a", "Missing keys: summary")], "summary string, error_kind string")
    assert LB.apply_error_kinds(odd).first().summary == "Missing keys: summary"


def test_validation_errors(spark):
    df = spark.createDataFrame([("x", None, "BAD"), ("x", "y", "OK"), (None, None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(LB.validation_errors(["b", "a"], {"c": ["OK"]})).collect()]
    assert got == [["Missing keys: b", "Invalid value for 'c': 'BAD'"], [], ["Missing keys: a, b"]]


def test_label_repair(spark):
    rows = [
        ("a", "'CERRAR'", "x", False, "3h 0m"),      # quoted critical -> unquoted valid
        ("b", "OTRO", "NADA", False, "3h 0m"),        # unknown critical -> N/A
        ("c", "OTRO", "INSISTIR", True, "5h 0m"),     # no errors -> unchanged
        ("d", "FOO", "NADA", True, "0h 5m"),          # no user + errors -> NUNCA / ESPERAR
        ("e", "FOO", "NADA", True, "9h 5m"),          # no user -> LLAMAR_LEAD_NUNCA_RESPONDIO -> N/A (not in enum)
    ]
    df = spark.createDataFrame(rows, "cleaned_phone string, primary_stall_reason_code string, next_action_code string, "
                               "NO_USER_MESSAGES_EXIST boolean, HOURS_MINUTES_SINCE_LAST_MESSAGE string")
    df = df.withColumns({"summary": F.lit("s"), "transfer_context_analysis": F.lit("t"),
                         "suggested_message_es": F.lit("m"), "inferred_stall_stage": F.lit("POST_VALIDACION")})
    enums = {"primary_stall_reason_code": ["CERRAR", "OTRO", "NUNCA_RESPONDIO"],
             "next_action_code": ["INSISTIR", "ESPERAR"]}
    r = {x.cleaned_phone: x for x in LB.repair_labels(df, enums=enums).collect()}
    assert r["a"].primary_stall_reason_code == "CERRAR" and r["a"].next_action_code == "N/A"
    assert r["b"].next_action_code == "N/A" and r["b"].had_errors
    assert r["c"].next_action_code == "INSISTIR" and not r["c"].had_errors
    assert r["c"].inferred_stall_stage == "POST_VALIDACION"
    assert r["d"].primary_stall_reason_code == "NUNCA_RESPONDIO" and r["d"].next_action_code == "ESPERAR"
    assert r["d"].inferred_stall_stage == "PRE_VALIDACION"
    assert r["e"].next_action_code == "N/A"
