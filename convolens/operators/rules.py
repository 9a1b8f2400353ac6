"""Decision rules B1-B12 as column expressions, and code lookups.

The reference asks a model to apply these tables; the parts that depend only on
columns are plain ``when`` chains here, and text judgements (explicit
disinterest, a reported technical problem) arrive as label columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions import patterns as P


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def lookup_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A fixed code table as a DataFrame (size bounded by the code list)."""
    return spark.createDataFrame(rows, columns)


def code_lookup(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Left join to a code table.  Spark broadcasts it if its size, known or
    measured at run time, is below the session's limit."""
    return df.join(dim, on=on, how="left")


def silence_band(no_user: Column | str, user_hours: Column | str) -> Column:
    """Never replied first, then user silence < 6 h in progress, >= 12 h
    ghosting, in between other."""
    h = _c(user_hours)
    return (
        F.when(_c(no_user), F.lit("NUNCA_RESPONDIO"))
        .when(h < 6, F.lit("PROCESO_EN_CURSO"))
        .when(h >= 12, F.lit("GHOSTING"))
        .otherwise(F.lit("OTRO"))
    )


def next_action(initial: Column | str, recovery_eligible: Column | str) -> Column:
    """B2: recovery-eligible leads whose initial action is not a close or a
    call get the recovery template."""
    i = _c(initial)
    return F.when(
        F.coalesce(_c(recovery_eligible), F.lit(False)) & i.isNotNull() & ~i.isin("CERRAR", "LLAMAR_LEAD"),
        F.lit("ENVIAR_PLANTILLA_RECUPERACION"),
    ).otherwise(i)


def suggested_message(action: Column | str, message: Column | str) -> Column:
    """Keep the suggested message only for the actions that send one."""
    return F.when(_c(action).isin(*P.MESSAGE_ACTIONS), _c(message)).otherwise(F.lit("N/A"))


def transfer_context(human_transfer: Column | str, context: Column | str) -> Column:
    """Transfer analysis input only when there was a transfer."""
    return F.when(F.coalesce(_c(human_transfer), F.lit(False)), F.coalesce(_c(context), F.lit("N/A"))).otherwise(
        F.lit("N/A")
    )


def engagement_status(
    no_user: Column | str,
    last_sender: Column | str,
    user_hours: Column | str,
    msg_hours: Column | str,
    disinterest: Column | str,
    technical: Column | str,
    threshold_hours: float = 6.0,
) -> Column:
    """First matching condition wins."""
    u, m, s = _c(user_hours), _c(msg_hours), _c(last_sender)
    return (
        F.when(F.coalesce(_c(no_user), F.lit(True)), F.lit("IGNORED_INITIAL_CONTACT"))
        .when(F.coalesce(_c(disinterest), F.lit(False)), F.lit("EXPLICIT_DISINTEREST"))
        .when(F.coalesce(_c(technical), F.lit(False)), F.lit("TECHNICAL_ISSUE_REPORTED"))
        .when((s == "user") & (u < threshold_hours), F.lit("KUNA_PENDING_RESPONSE"))
        .when((s == "kuna") & (m >= threshold_hours), F.lit("STALLED_AFTER_RESPONSE"))
        .when((s == "kuna") & (m < threshold_hours), F.lit("USER_PENDING_RESPONSE"))
        .when(m < threshold_hours, F.lit("ENGAGED_ACTIVE_CONVO"))
        .otherwise(F.lit("N/A"))
    )


def engagement_action(
    stall: Column | str,
    engagement: Column | str,
    msg_hours: Column | str,
    user_hours: Column | str,
    silence_hours: float = 24.0,
) -> Column:
    """Next action of the engagement recipe, first matching rule wins.
    ``silence_hours`` is the prompt's example bound, kept as a parameter."""
    st, en = _c(stall), _c(engagement)
    silence = F.when(en == "STALLED_AFTER_RESPONSE", _c(msg_hours)).otherwise(_c(user_hours))
    return (
        F.when(st == "NUNCA_RESPONDIO", F.lit("LLAMAR_LEAD_NUNCA_RESPONDIO"))
        .when(st.isin(*P.INELIGIBLE_CODES), F.lit("CERRAR_CASO"))
        .when((st == "DESINTERES_EXPLICITO") & (en == "EXPLICIT_DISINTEREST"), F.lit("CERRAR_CASO"))
        .when(en == "TECHNICAL_ISSUE_REPORTED", F.lit("ESCALAR_CASO_A_HUMANO"))
        .when(en == "KUNA_PENDING_RESPONSE", F.lit("RESPONDER_AL_CLIENTE"))
        .when((st == "PROCESO_EN_CURSO") & en.isin("ENGAGED_ACTIVE_CONVO", "KUNA_PENDING_RESPONSE"),
              F.lit("MONITOREAR_CONVERSACION"))
        .when(en == "USER_PENDING_RESPONSE", F.lit("PROGRAMAR_RECONTACTO_AUTOMATICO"))
        .when((en == "STALLED_AFTER_RESPONSE") | (st == "GHOSTING"),
              F.when(silence > silence_hours, F.lit("PROGRAMAR_RECONTACTO_ESPECIAL"))
              .otherwise(F.lit("PROGRAMAR_RECONTACTO_AUTOMATICO")))
        .when(st.isin(*P.RECONTACT_CODES), F.lit("PROGRAMAR_RECONTACTO_AUTOMATICO"))
        .when(st.isin(*P.ESCALATE_CODES), F.lit("ESCALAR_CASO_A_HUMANO"))
        .otherwise(F.lit("REVISAR_MANUALMENTE"))
    )


def campaign_status(label: Column | str, no_user: Column | str, user_hours: Column | str,
                    split_hours: float = 48.0) -> Column:
    """A started process is ACTIVE while the user spoke within 48 h,
    UNFINISHED after; a lead who never wrote is IGNORED."""
    lab, h = _c(label), _c(user_hours)
    started = lab.startswith("PROCESS_STARTED")
    return (
        F.when(F.coalesce(_c(no_user), F.lit(True)) & started, F.lit("IGNORED_NO_RESPONSE"))
        .when(started & (h > split_hours), F.lit("PROCESS_STARTED_UNFINISHED"))
        .when(started, F.lit("PROCESS_STARTED_ACTIVE"))
        .otherwise(lab)
    )


def campaign_table(spark: SparkSession) -> DataFrame:
    """B9 table ``(status, action, context)``."""
    return lookup_table(spark, P.CAMPAIGN_ACTION, ["current_engagement_status", "next_action_code", "next_action_context"])


def campaign_message(action: Column | str, message: Column | str) -> Column:
    """A suggested message only for RESPOND_* actions."""
    return F.when(_c(action).startswith("RESPOND_"), _c(message)).otherwise(F.lit("N/A"))


def smart_summary(documents: Column | str, validation: Column | str, quality: Column | str, gps: Column | str) -> Column:
    """Ordered substring rules over four label columns (lower-cased text;
    a missing value reads as 'nan', as the reference's string conversion does)."""
    raw_docs = _c(documents)
    d = F.lower(F.coalesce(raw_docs, F.lit("nan")))
    v = F.lower(F.coalesce(_c(validation), F.lit("nan")))
    q = F.lower(F.coalesce(_c(quality), F.lit("nan")))
    g = F.lower(F.coalesce(_c(gps), F.lit("nan")))
    return (
        F.when(raw_docs.isNull() | (raw_docs == ""), F.lit(P.SUMMARY_NO_CONVERSATION))
        .when(g.contains("gps completado") | g.contains("completado"), F.lit(P.SUMMARY_GPS_DONE))
        .when(v.contains("sí"),
              F.when(g.contains("agendado"), F.lit(P.SUMMARY_VALIDATION_GPS_SCHEDULED))
              .when(g.contains("pendiente"), F.lit(P.SUMMARY_VALIDATION_GPS_PENDING))
              .otherwise(F.lit(P.SUMMARY_VALIDATION)))
        .when(d.contains("faltan"),
              F.when(q.contains("mala") | q.contains("regular"), F.lit(P.SUMMARY_STUCK))
              .otherwise(F.lit(P.SUMMARY_MISSING_DOCS)))
        .when(d.contains("documentos completos"),
              F.when(g.contains("agendado"), F.lit(P.SUMMARY_DOCS_GPS_SCHEDULED))
              .otherwise(F.lit(P.SUMMARY_DOCS_GPS_PENDING)))
        .otherwise(F.lit(P.SUMMARY_IN_PROGRESS))
    )
