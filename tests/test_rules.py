"""One hand-derived row per branch of the decision rules."""

import pytest
from pyspark.sql import functions as F

from convolens.functions import patterns as P
from convolens.operators import rules as RU


def evaluate(spark, column, names, types, rows):
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_silence_band(spark):
    rows = {(True, None): "NUNCA_RESPONDIO", (False, 5.99): "PROCESO_EN_CURSO", (False, 6.0): "OTRO",
            (False, 11.99): "OTRO", (False, 12.0): "GHOSTING", (False, -1.0): "PROCESO_EN_CURSO"}
    assert evaluate(spark, RU.silence_band("n", "h"), ["n", "h"], ["boolean", "double"], rows) == list(rows.values())


def test_next_action_and_gates(spark):
    rows = {("INSISTIR", True): "ENVIAR_PLANTILLA_RECUPERACION", ("INSISTIR", False): "INSISTIR", ("CERRAR", True): "CERRAR",
            ("LLAMAR_LEAD", True): "LLAMAR_LEAD", (None, True): None, ("ESPERAR", None): "ESPERAR"}
    assert evaluate(spark, RU.next_action("a", "e"), ["a", "e"], ["string", "boolean"], rows) == list(rows.values())
    gated = {("INSISTIR", "m"): "m" if "INSISTIR" in P.MESSAGE_ACTIONS else "N/A", ("CERRAR", "m"): "N/A", (None, "m"): "N/A"}
    assert evaluate(spark, RU.suggested_message(F.col("a"), "m"), ["a", "m"], ["string", "string"], gated) == list(gated.values())
    context = {(True, "x"): "x", (True, None): "N/A", (False, "x"): "N/A", (None, "x"): "N/A"}
    assert evaluate(spark, RU.transfer_context("h", "c"), ["h", "c"], ["boolean", "string"], context) == list(context.values())


ENGAGEMENT = [
    ((True, "kuna", None, 1.0, False, False), "IGNORED_INITIAL_CONTACT"),
    ((False, "user", 1.0, 1.0, True, True), "EXPLICIT_DISINTEREST"),
    ((False, "user", 1.0, 1.0, False, True), "TECHNICAL_ISSUE_REPORTED"),
    ((False, "user", 5.9, 5.9, False, False), "KUNA_PENDING_RESPONSE"),
    ((False, "kuna", 9.0, 6.0, False, False), "STALLED_AFTER_RESPONSE"),
    ((False, "kuna", 9.0, 5.9, False, False), "USER_PENDING_RESPONSE"),
    ((False, "other", 9.0, 5.9, False, False), "ENGAGED_ACTIVE_CONVO"),
    ((False, "user", 6.0, 6.0, False, False), "N/A"),
]


def test_engagement_status(spark):
    got = evaluate(spark, RU.engagement_status("n", "s", "u", "m", "d", "t"), list("nsumdt"),
                   ["boolean", "string", "double", "double", "boolean", "boolean"], [r for r, _ in ENGAGEMENT])
    assert got == [w for _, w in ENGAGEMENT]


ACTIONS = [  # stall, engagement, hours since message, hours since user message
    (("NUNCA_RESPONDIO", "IGNORED_INITIAL_CONTACT", 1.0, None), "LLAMAR_LEAD_NUNCA_RESPONDIO"),
    (("ZONA_NO_CUBIERTA", "KUNA_PENDING_RESPONSE", 1.0, 1.0), "CERRAR_CASO"),
    (("DESINTERES_EXPLICITO", "EXPLICIT_DISINTEREST", 1.0, 1.0), "CERRAR_CASO"),
    (("DESINTERES_EXPLICITO", "N/A", 1.0, 1.0), "REVISAR_MANUALMENTE"),
    (("DESINTERES_EXPLICITO", "USER_PENDING_RESPONSE", 1.0, 1.0), "PROGRAMAR_RECONTACTO_AUTOMATICO"),
    (("OTRO", "TECHNICAL_ISSUE_REPORTED", 1.0, 1.0), "ESCALAR_CASO_A_HUMANO"),
    (("OTRO", "KUNA_PENDING_RESPONSE", 1.0, 1.0), "RESPONDER_AL_CLIENTE"),
    (("PROCESO_EN_CURSO", "ENGAGED_ACTIVE_CONVO", 1.0, 1.0), "MONITOREAR_CONVERSACION"),
    (("PROCESO_EN_CURSO", "USER_PENDING_RESPONSE", 1.0, 1.0), "PROGRAMAR_RECONTACTO_AUTOMATICO"),
    (("OTRO", "STALLED_AFTER_RESPONSE", 24.1, 1.0), "PROGRAMAR_RECONTACTO_ESPECIAL"),
    (("OTRO", "STALLED_AFTER_RESPONSE", 24.0, 99.0), "PROGRAMAR_RECONTACTO_AUTOMATICO"),
    (("GHOSTING", "N/A", 1.0, 24.1), "PROGRAMAR_RECONTACTO_ESPECIAL"),
    (("GHOSTING", "N/A", 99.0, 24.0), "PROGRAMAR_RECONTACTO_AUTOMATICO"),
    (("PROBLEMA_TERMINOS", "N/A", 1.0, 1.0), "PROGRAMAR_RECONTACTO_AUTOMATICO"),
    (("ERROR_PROCESO_INTERNO", "N/A", 1.0, 1.0), "ESCALAR_CASO_A_HUMANO"),
    (("OTRO", "N/A", 1.0, 1.0), "REVISAR_MANUALMENTE"),
]


def test_engagement_action(spark):
    got = evaluate(spark, RU.engagement_action("s", "e", "m", "u"), list("semu"), ["string", "string", "double", "double"],
                   [r for r, _ in ACTIONS])
    assert got == [w for _, w in ACTIONS]


def test_campaign_status_and_message(spark):
    rows = {("PROCESS_STARTED", True, None): "IGNORED_NO_RESPONSE", ("PROCESS_STARTED", False, 48.0): "PROCESS_STARTED_ACTIVE",
            ("PROCESS_STARTED", False, 48.1): "PROCESS_STARTED_UNFINISHED", ("EXPLICITLY_NO", False, 99.0): "EXPLICITLY_NO",
            ("EXPLICITLY_NO", True, None): "EXPLICITLY_NO", ("PROCESS_STARTED", None, 1.0): "IGNORED_NO_RESPONSE"}
    got = evaluate(spark, RU.campaign_status("l", "n", "u"), list("lnu"), ["string", "boolean", "double"], rows)
    assert got == list(rows.values())
    messages = {("RESPOND_NOW", "m"): "m", ("WAIT", "m"): "N/A", (None, "m"): "N/A"}
    assert evaluate(spark, RU.campaign_message("a", "m"), ["a", "m"], ["string", "string"], messages) == list(messages.values())


def test_code_lookup_left_joins(spark):
    df = spark.createDataFrame([("GHOSTING",), ("unknown",), (None,)], "primary_stall_reason_code string")
    dim = RU.lookup_table(spark, P.STALL_INITIAL_ACTION, ["primary_stall_reason_code", "initial_action"])
    got = {r.primary_stall_reason_code: r.initial_action for r in RU.code_lookup(df, dim, "primary_stall_reason_code").collect()}
    assert got == {"GHOSTING": dict(P.STALL_INITIAL_ACTION)["GHOSTING"], "unknown": None, None: None}


SUMMARIES = [  # documents, validation, quality, gps
    ((None, "Sí", "Mala", "GPS completado"), "SUMMARY_NO_CONVERSATION"), (("", "Sí", "", ""), "SUMMARY_NO_CONVERSATION"),
    (("x", "No", "Buena", "GPS completado"), "SUMMARY_GPS_DONE"), (("x", "Sí", "Buena", "GPS agendado"), "SUMMARY_VALIDATION_GPS_SCHEDULED"),
    (("x", "Sí", "Buena", "Pendiente"), "SUMMARY_VALIDATION_GPS_PENDING"), (("x", "Sí", "Buena", None), "SUMMARY_VALIDATION"),
    (("Faltan: INE", "No", "Mala", None), "SUMMARY_STUCK"), (("Faltan: INE", "No", "Buena", None), "SUMMARY_MISSING_DOCS"),
    (("Documentos completos", "No", None, "GPS agendado"), "SUMMARY_DOCS_GPS_SCHEDULED"),
    (("Documentos completos", None, None, None), "SUMMARY_DOCS_GPS_PENDING"), (("Parcial", None, None, None), "SUMMARY_IN_PROGRESS"),
]


@pytest.mark.parametrize("row,name", SUMMARIES)
def test_smart_summary(spark, row, name):
    got = evaluate(spark, RU.smart_summary("d", "v", "q", "g"), list("dvqg"), ["string"] * 4, [row])
    assert got == [getattr(P, name)]
