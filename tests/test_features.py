"""Hand-derived expectations for every detector branch (FIXTURES.md §4) and
invariants of the feature fold."""

from pyspark.sql import functions as F

from convolens.operators import features as FT


def feats(make_messages, rows, specs):
    return {r.cleaned_phone: r for r in FT.conversation_features(make_messages(rows), specs).collect()}


def test_durations_truncate_toward_zero(make_messages):
    r = feats(make_messages, [("a", 69, "user", "hola"), ("b", -90, "user", "hola")], [FT.Temporal()])
    assert r["a"].HOURS_MINUTES_SINCE_LAST_MESSAGE == "1h 8m"  # double arithmetic loses a minute
    assert r["b"].HOURS_MINUTES_SINCE_LAST_MESSAGE == "-1h -30m"


def test_temporal_flags_with_and_without_user(make_messages):
    rows = [("u", 26 * 60, "bot", "x"), ("u", 25 * 60, "user", "y"), ("u", 24 * 60, "bot", "x"),
            ("u", 2 * 60, "user", "y"), ("u", 60, "bot", "x"),
            ("n", 26 * 60, "bot", "x"), ("n", 24 * 60, "bot", "x"), ("n", 2 * 60, "bot", "x"), ("n", 60, "bot", "x")]
    r = feats(make_messages, rows, [FT.Temporal()])
    assert r["u"].NO_USER_MESSAGES_EXIST is False
    assert r["u"].IS_WITHIN_REACTIVATION_WINDOW is True and r["u"].IS_RECOVERY_PHASE_ELIGIBLE is False
    assert r["u"].LAST_USER_MESSAGE_TIMESTAMP_TZ == "2024-01-04T16:00:00-06:00"
    assert r["n"].NO_USER_MESSAGES_EXIST is True
    assert r["n"].IS_WITHIN_REACTIVATION_WINDOW is False and r["n"].IS_RECOVERY_PHASE_ELIGIBLE is False
    assert r["n"].HOURS_MINUTES_SINCE_LAST_USER_MESSAGE is None


def test_skip_temporal_gives_defaults(make_messages):
    r = feats(make_messages, [("a", 5, "user", "x")], [FT.Temporal({"skip_detailed_temporal": True})])
    assert r["a"].NO_USER_MESSAGES_EXIST is True and r["a"].HOURS_MINUTES_SINCE_LAST_MESSAGE is None


def handoff(make_messages, reply, **params):
    rows = [("p", 30, "bot", "Estás a un paso de la aprobación"), ("p", 20, "user", reply)]
    return feats(make_messages, rows, [FT.Handoff(params)])["p"]


def test_handoff_reply_classes(make_messages):
    assert handoff(make_messages, "No me interesa").handoff_response == "STARTED_HANDOFF"
    assert handoff(make_messages, "No me interesa", strict=True).handoff_response == "DECLINED_HANDOFF"
    assert handoff(make_messages, "casi quiero").handoff_response == "STARTED_HANDOFF"
    assert handoff(make_messages, "No gracias").handoff_response == "DECLINED_HANDOFF"
    assert handoff(make_messages, "qué?").handoff_response == "UNCLEAR_RESPONSE"
    r = handoff(make_messages, "Sí", skip_handoff_started=True)
    assert r.handoff_response == "INVITATION_SENT" and r.handoff_finalized is False


def test_handoff_no_response_and_finalized(make_messages):
    r = feats(make_messages, [("p", 30, "user", "hola"), ("p", 20, "bot", "No pierdas la oportunidad")], [FT.Handoff()])
    assert r["p"].handoff_response == "NO_RESPONSE"
    rows = [("q", 50, "bot", "Hemos recibido tu solicitud"), ("q", 40, "bot", "No pierdas la oportunidad"),
            ("q", 30, "user", "Sí, quiero")]
    r = feats(make_messages, rows, [FT.Handoff()])
    assert r["q"].handoff_response == "STARTED_HANDOFF" and r["q"].handoff_finalized is False
    rows.append(("q", 10, "bot", "Tu solicitud ha sido enviada"))
    assert feats(make_messages, rows, [FT.Handoff()])["q"].handoff_finalized is True


def test_transfer_accent_trap(make_messages):
    rows = [("p", 5, "bot", "Un supervisor te asistirá")]
    assert feats(make_messages, rows, [FT.HumanTransfer()])["p"].human_transfer is False
    assert feats(make_messages, rows, [FT.HumanTransfer({"strict": True})])["p"].human_transfer is True


def test_template_needs_accent_and_run_breaks_on_operator(make_messages):
    r = feats(make_messages, [("p", 5, "bot", "prestamo por tu auto")], [FT.Template()])
    assert r["p"].recovery_template_detected is False
    rows = [("q", 30, "bot", "Aprovecha tu oferta"), ("q", 20, "operator", "hola"), ("q", 10, "bot", "aprovecha tu oferta")]
    r = feats(make_messages, rows, [FT.Template()])
    assert r["q"].consecutive_recovery_templates_count == 1 and r["q"].recovery_template_detected is True
    rows = [("z", 30, "user", "hola"), ("z", 20, "bot", "template: a"), ("z", 10, "bot", "template: b")]
    assert feats(make_messages, rows, [FT.Template()])["z"].consecutive_recovery_templates_count == 2


def test_sender_case(make_messages):
    rows = [("p", 30, "Bot", "Antes de continuar, necesito confirmar tres detalles importantes sobre tu auto"),
            ("p", 20, "USER", "hola")]
    r = feats(make_messages, rows, FT.chain(["temporal", "metadata", "validation"]))["p"]
    assert r.NO_USER_MESSAGES_EXIST is False and r.last_message_sender == "user"
    assert r.pre_validacion_detected is False  # V sees only the exact sender 'bot'


def test_metadata_last_sender_operator_and_truncation(make_messages):
    long = "x" * 151
    r = feats(make_messages, [("p", 30, "user", long), ("p", 20, "operator", "ok")], [FT.Metadata({"max_message_length": 150})])["p"]
    assert r.last_message_sender == "kuna"
    assert r.last_user_message_text == "x" * 150 + "..."
    assert r.last_kuna_message_text == "ok"
    whole = feats(make_messages, [("p", 30, "user", long)], [FT.Metadata()])["p"]
    assert whole.last_user_message_text == long


def test_state_sees_only_earlier_flags(make_messages):
    rows = [("p", 5, "bot", "Antes de continuar, necesito confirmar tres detalles importantes sobre tu auto")]
    before = feats(make_messages, rows, FT.chain(["conversation_state", "validation"]))["p"]
    after = feats(make_messages, rows, FT.chain(["validation", "conversation_state"]))["p"]
    assert before.conversation_state == "PRE_VALIDACION"
    assert after.conversation_state == "POST_VALIDACION"


def test_unknown_parameter_is_rejected():
    import pytest

    with pytest.raises(ValueError):
        FT.Temporal({"skip_hours_minutes": True})
    with pytest.raises(ValueError):
        FT.make_feature("NoSuchProcessor")


def test_invariants_on_driver_data(spark):
    import __spark_entry__ as E

    from convolens.sources.adapters import message_rows

    m = message_rows(spark, "/root/testdata/sf0.01")
    out = FT.conversation_features(m, FT.chain(FT.DEFAULT_CHAIN))
    bad = out.where(
        (F.col("IS_WITHIN_REACTIVATION_WINDOW") & F.col("IS_RECOVERY_PHASE_ELIGIBLE"))
        | ((F.col("consecutive_recovery_templates_count") > 0) & ~F.col("recovery_template_detected"))
        | (F.col("handoff_finalized") & (F.col("handoff_response") != "STARTED_HANDOFF"))
    )
    assert bad.count() == 0
    assert out.count() == 100
    dig = E.queries()["conversation_digest"]
    a = {r.cleaned_phone: r.conversation_digest for r in dig(spark, "/root/testdata/sf0.01").collect()}
    from convolens.operators.transcript import conversation_digest

    b = {r.cleaned_phone: r.conversation_digest for r in conversation_digest(m.repartition(3).orderBy(F.rand(7))).collect()}
    assert a == b  # stable under input reordering and partition count


def test_feature_fold_scans_and_deals_the_messages_once(spark):
    from convolens.sources.adapters import message_rows

    m = message_rows(spark, "/root/testdata/sf0.01")
    out = FT.conversation_features(m, FT.chain(FT.DEFAULT_CHAIN))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("conversations.parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # temporal/metadata-only chains need no anchors: a single aggregation
    simple = FT.conversation_features(m, [FT.Temporal(), FT.Metadata()])
    p2 = simple._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in p2 and "BroadcastHashJoin" not in p2


def test_equal_times_do_not_tie(spark):
    """Three messages at one time in six input orders give one result; without
    source positions the content decides, with them the position does."""
    from datetime import datetime
    from itertools import permutations

    from convolens.operators.transcript import conversation_digest, conversation_text

    t = datetime(2024, 1, 4)
    rows = [("p", 0, t, "user", "hola"), ("p", 1, t, "bot", "template: a"), ("p", 2, t, "bot", "template: b")]
    for columns in (["cleaned_phone", "src_ord", "creation_time", "msg_from", "message"],
                    ["cleaned_phone", "creation_time", "msg_from", "message"]):
        seen = set()
        for order in permutations(rows):
            df = spark.createDataFrame(list(order), "cleaned_phone string, src_ord int, creation_time timestamp, msg_from string, message string")
            df = df.select(*columns)
            f = FT.conversation_features(df, [FT.Metadata(), FT.Template(), FT.Digest()]).first()
            d, x = conversation_digest(df).first(), conversation_text(df).first()
            assert d.conversation_digest == f.conversation_digest
            seen.add((f.last_message_sender, f.last_kuna_message_text, f.consecutive_recovery_templates_count,
                      d.conversation_digest, x.conversation_text))
        assert len(seen) == 1
        if "src_ord" in columns:
            assert next(iter(seen))[:3] == ("kuna", "template: b", 2)


def test_digest_and_text_of_odd_rows(spark):
    from datetime import datetime

    from convolens.operators.transcript import PLAIN, conversation_digest, conversation_text

    t = datetime(2024, 1, 4, 10)
    rows = [(None, 0, t, "user", "x"), ("a", 0, t, "user", "  a \n b "), ("b", 0, t, "user", "a b"),
            ("c", 0, None, None, None), ("d", 0, t, "user", "one"), ("d", 1, datetime(2024, 1, 5), "bot", "two")]
    df = spark.createDataFrame(rows, "cleaned_phone string, src_ord int, creation_time timestamp, msg_from string, message string")
    got = {r.cleaned_phone: r for r in conversation_digest(df).collect()}
    assert set(got) == {None, "a", "b", "c", "d"} and got["d"].n_messages == 2
    assert got["a"].conversation_digest == got["b"].conversation_digest != got["d"].conversation_digest
    text = {r.cleaned_phone: r.conversation_text for r in conversation_text(df, style=PLAIN).collect()}
    assert text["d"] == "2024-01-04 10:00:00 user: one\n2024-01-05 00:00:00 bot: two" and text[None].endswith("x")
