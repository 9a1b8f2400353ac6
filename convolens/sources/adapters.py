"""Adapters from the driver tables to this package's inputs.

Every conversation row becomes a message with its own whole text.  The driver's
prose never matches a detector, so trigger sentences are added as further rows
by ``(conv_id, turn)`` arithmetic, and user turns of every conversation with
``conv_id % 10 = 7`` are given to the operator, so that some conversations
have no user (see FIXTURES.md §3).  Everything is a column expression: the
adapters scale with the tables and push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.operators.report import one_per_key
from convolens.sources.tables import read_table

PHONE_BASE = 5500000000
EPOCH_BASE = 1704067200  # 2024-01-01 00:00:00 UTC

# FIXED VALUES — trigger sentences the adapter places into driver text.
BOT_OFFER = "Hola, aprovecha tu oferta"
BOT_INVITE = "Estás a un paso de la aprobación"
BOT_PREVALIDATION = "Antes de continuar, necesito confirmar tres detalles importantes sobre tu auto"
BOT_TRANSFER = "Quieres hablar con un asesor"
BOT_RECEIVED = "Hemos recibido tu solicitud"
USER_YES_WANT = "Sí, quiero"
USER_NO_THANKS = "No gracias"
USER_NOT_INTERESTED = "no me interesa"
USER_YES = "Sí"


def phone_of(conv_id) -> F.Column:
    """Conversation id -> ten-digit phone text."""
    return (F.lit(PHONE_BASE) + conv_id).cast("string")


def _message_columns(conv: DataFrame) -> DataFrame:
    """One message per turn (even ``src_ord``) and, where a trigger sentence
    follows it, a second one at the same time (odd ``src_ord``)."""
    cid, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    muted = cid % 10 == 7
    bot_k, user_k = (cid * 3 + turn) % 7, (cid + turn) % 6
    is_bot, is_user = role == "assistant", (role == "user") & ~muted
    trigger = F.when(is_bot & muted & (turn >= 3), F.lit(BOT_OFFER))
    for k, text in enumerate([BOT_INVITE, BOT_OFFER, BOT_PREVALIDATION, BOT_TRANSFER, BOT_RECEIVED]):
        trigger = trigger.when(is_bot & (bot_k == k), F.lit(text))
    for k, text in enumerate([USER_YES_WANT, USER_NO_THANKS, USER_NOT_INTERESTED, USER_YES]):
        trigger = trigger.when(is_user & (user_k == k), F.lit(text))
    said = F.array(
        F.struct((turn * 2).cast("int").alias("src_ord"), F.col("text").alias("message")),
        F.struct((turn * 2 + 1).cast("int").alias("src_ord"), trigger.alias("message")),
    )
    seconds = F.lit(EPOCH_BASE) + (cid % 100) * 3600 + turn * (7 + cid % 5) * 60
    return conv.select(
        phone_of(cid).alias("cleaned_phone"),
        F.timestamp_seconds(seconds).alias("creation_time"),
        F.when(is_user, "user").when(is_bot, "bot").otherwise("operator").alias("msg_from"),
        cid.alias("conv_id"),
        F.explode(F.filter(said, lambda m: (m["src_ord"] % 2 == 0) | m["message"].isNotNull())).alias("said"),
    ).select("cleaned_phone", "said.src_ord", "creation_time", "msg_from", "said.message", "conv_id")


def message_rows(spark: SparkSession, sf_dir: str, keep_conv_id: bool = False) -> DataFrame:
    """Canonical messages ``(cleaned_phone, src_ord, creation_time, msg_from, message)``."""
    out = _message_columns(read_table(spark, sf_dir, "conversations"))
    return out if keep_conv_id else out.drop("conv_id")


def leads_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead table ``(lead_id, name, cleaned_phone)``; one lead per customer."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("lead_id"),
        F.col("c_name").alias("name"),
        phone_of(F.col("c_custkey")).alias("cleaned_phone"),
    )


def raw_message_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse-shaped messages ``message_metrics(session_id, creation_time,
    msg_from, operator_alias, message)``; session = conversation."""
    m = _message_columns(read_table(spark, sf_dir, "conversations"))
    return m.select(
        F.col("conv_id").cast("string").alias("session_id"),
        "src_ord",
        "creation_time",
        "msg_from",
        F.when(F.col("msg_from") == "operator", F.lit("agent")).alias("operator_alias"),
        "message",
    )


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_metrics(session_id, user_platform_contact_id)``: contact id is
    the phone with the '521' country/mobile prefix."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select("conv_id").distinct().select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat(F.lit("521"), phone_of(F.col("conv_id"))).alias("user_platform_contact_id"),
    )


def synthetic_email(name: F.Column, key: F.Column) -> F.Column:
    """Address built from a customer name; even keys carry a '+o<k%3>' alias."""
    local = F.regexp_replace(name, "#", ".")
    alias = F.when(key % 2 == 0, F.concat(F.lit("+o"), (key % 3).cast("string"))).otherwise(F.lit(""))
    return F.concat(local, alias, F.lit("@Example.com"))


def financing_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead source rows ``(id, user_id, user_email, create_date, profiling_status, product)``
    from orders (one candidate lead per order)."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        synthetic_email(F.col("c_name"), F.col("o_orderkey")).alias("user_email"),
        F.col("o_orderdate").alias("create_date"),
        F.col("o_orderstatus").alias("profiling_status"),
        F.col("o_orderpriority").alias("product"),
    )


def leads_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows ``(lead_id, field, new_value)``: a returned line means the
    lead's offer ENTERED hand-off."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("lead_id"),
        F.lit("OFFER_STATUS").alias("field"),
        F.when(F.col("l_returnflag") == "R", F.lit("ENTERED")).otherwise(F.lit("PENDING")).alias("new_value"),
    )


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact intents ``(id, email, name, last_name, phone_number, updated_at)``."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.col("o_orderkey").alias("id"),
        synthetic_email(F.col("c_name"), F.col("o_orderkey") + 1).alias("email"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("last_name"),
        F.concat(F.lit("521"), phone_of(F.col("c_custkey"))).alias("phone_number"),
        F.col("o_orderdate").alias("updated_at"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages keyed by user: clicks and purchases are the user
    speaking, views an operator, everything else the bot."""
    e = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("user_id").cast("string").alias("cleaned_phone"),
        F.col("event_id").alias("src_ord"),
        F.col("ts").cast("timestamp").alias("creation_time"),
        F.when(et.isin("click", "purchase"), "user").when(et == "view", "operator").otherwise("bot").alias("msg_from"),
        et.alias("message"),
    )


# FIXED VALUES — label variants the adapter assigns by conversation id
# (valid codes, plus quoted, padded, unknown and missing ones).
STALL_VARIANTS = [
    "NUNCA_RESPONDIO", "FINANCIAMIENTO_ACTIVO", "VEHICULO_ANTIGUO_KM", "NO_PROPIETARIO",
    "VIN_EXTRANJERO", "ZONA_NO_CUBIERTA", "USUARIO_SIN_AUTO", "RECHAZADO_POR_KUNA",
    "PRODUCTO_INCORRECTO_COMPRADOR", "OTRO_PROCESO_DE_NEGOCIO", "DESINTERES_EXPLICITO",
    "ADEUDO_VEHICULAR_MULTAS", "PROBLEMA_SEGUNDA_LLAVE", "PROBLEMA_TERMINOS",
    "ERROR_PROCESO_INTERNO", "PROCESO_EN_CURSO", "GHOSTING", "OTRO",
    "'GHOSTING'", "  OTRO  ", "INVENTADO", None,
]
ACTION_VARIANTS = [
    "CERRAR", "ESPERAR", "LLAMAR_LEAD", "CONTACTO_PRIORITARIO", "MANEJAR_OBJECION",
    "INSISTIR", "ENVIAR_PLANTILLA_RECUPERACION", '"ESPERAR"', "NADA", None,
]
STAGE_VARIANTS = ["PRE_VALIDACION", "POST_VALIDACION", "HANDOFF"]
CAMPAIGN_VARIANTS = [
    "IGNORED_NO_RESPONSE", "CLICKED_BUTTON_ONLY", "PROCESS_STARTED", "EXPLICITLY_NO",
    "TECHNICAL_ISSUE", "NOT_ELIGIBLE_BUREAU",
]
DOCUMENT_VARIANTS = ["Faltan documentos", "Documentos completos", "Parcial", None, ""]
VALIDATION_VARIANTS = ["Sí", "No", "No claro", None]
QUALITY_VARIANTS = ["Buena", "Regular", "Mala"]
GPS_VARIANTS = ["GPS agendado", "Pendiente", "GPS completado", "No", None]
OBJECTION_VARIANTS = ["Tasa alta", "Ninguna", "Plazo"]


def pick(index: F.Column, values: list) -> F.Column:
    """``values[index]`` for a non-negative integer column."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model labels, a row per turn (what a model would have returned for the
    conversation so far): codes by arithmetic on the conversation id, free texts
    around the turn's whole text."""
    conv = read_table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    c = F.col("conv_id")
    return conv.select(
        phone_of(c).alias("cleaned_phone"),
        c.alias("conv_id"),
        "turn",
        F.when(c % 17 == 5, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Resumen: "), F.col("text"))).alias("summary"),
        pick(c % len(STALL_VARIANTS), STALL_VARIANTS).alias("primary_stall_reason_code"),
        pick((c * 7) % len(ACTION_VARIANTS), ACTION_VARIANTS).alias("next_action_code"),
        F.when(c % 4 == 0, F.lit("N/A")).otherwise(F.lit("Pidió hablar con una persona")).alias("transfer_context_analysis"),
        F.concat(F.lit("Hola, sobre tu mensaje: "), F.col("text")).alias("suggested_message_es"),
        pick(c % 3, STAGE_VARIANTS).alias("inferred_stall_stage"),
        (c % 9 == 4).alias("explicit_disinterest"),
        (c % 11 == 5).alias("technical_issue"),
        pick(c % len(CAMPAIGN_VARIANTS), CAMPAIGN_VARIANTS).alias("campaign_label"),
        pick(c % len(DOCUMENT_VARIANTS), DOCUMENT_VARIANTS).alias("documentos_enviados_analisis"),
        pick(F.floor(c / 5) % len(VALIDATION_VARIANTS), VALIDATION_VARIANTS).alias("enviado_a_validacion"),
        pick(c % len(QUALITY_VARIANTS), QUALITY_VARIANTS).alias("calidad_atencion_agente"),
        pick(F.floor(c / 2) % len(GPS_VARIANTS), GPS_VARIANTS).alias("gps_instalacion_agendada"),
        pick(c % len(OBJECTION_VARIANTS), OBJECTION_VARIANTS).alias("objecion_principal_cliente"),
        F.when(c % 13 == 6, F.lit("ERROR_PROCESSING"))
        .when(c % 29 == 11, F.lit("ERROR_LLM_NONE"))
        .when(c % 31 == 30, F.lit("ERROR_UNEXPECTED")).alias("error_kind"),
    )


def latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest label row of each conversation."""
    return one_per_key(label_rows(spark, sf_dir))
