"""Registered queries: each reads the driver tables at ``sf_dir`` and returns a
lazy DataFrame; ``ORACLE`` holds the DuckDB SQL twin of each (where one exists).
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions import patterns as P
from convolens.operators import features as FT
from convolens.operators.transcript import conversation_digest
from convolens.plans import oracle as O
from convolens.session import AS_OF_DEFAULT, checkpoint_dir, tune_session
from convolens.sources import adapters as A
from convolens.sources.stage import staged

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune_session(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return deco


def _msgs(spark, sf_dir):
    return A.message_rows(spark, sf_dir)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --------------------------------------------------------------- features
@register(
    "temporal_features",
    _with(O.messages_cte(), O.ordinal_cte(), O.temporal_agg_sql())
    + f"SELECT cleaned_phone, {O.temporal_select()} FROM t_agg",
)
def temporal_features(spark, sf_dir):
    """T1-T7 per conversation."""
    return FT.conversation_features(_msgs(spark, sf_dir), [FT.Temporal()])


@register(
    "message_metadata",
    _with(O.messages_cte(), O.ordinal_cte(), O.metadata_agg_sql())
    + f"SELECT cleaned_phone, {O.metadata_select()} FROM m_agg",
)
def message_metadata(spark, sf_dir):
    """M1-M4 per conversation."""
    return FT.conversation_features(_msgs(spark, sf_dir), [FT.Metadata()])


@register(
    "template_run",
    _with(O.messages_cte(), O.ordinal_cte(), O.template_agg_sql())
    + f"SELECT cleaned_phone, {O.template_select()} FROM r_agg",
)
def template_run(spark, sf_dir):
    """Last bot row is a recovery template; trailing template run length."""
    return FT.conversation_features(_msgs(spark, sf_dir), [FT.Template()])


@register(
    "pre_validation",
    _with(O.messages_cte())
    + f"SELECT cleaned_phone, {O.validation_expr()} AS pre_validacion_detected FROM msgs GROUP BY cleaned_phone",
)
def pre_validation(spark, sf_dir):
    """V1 per conversation."""
    return FT.conversation_features(_msgs(spark, sf_dir), [FT.Validation()])


@register(
    "human_transfer",
    _with(O.messages_cte())
    + f"SELECT cleaned_phone, {O.transfer_expr()} AS human_transfer FROM msgs GROUP BY cleaned_phone",
)
def human_transfer(spark, sf_dir):
    """X1 per conversation (reference matching: accented phrase never hits)."""
    return FT.conversation_features(_msgs(spark, sf_dir), [FT.HumanTransfer()])


@register(
    "handoff_funnel",
    _with(O.messages_cte(), O.ordinal_cte(), O.handoff_ctes())
    + f"SELECT cleaned_phone, {O.handoff_select()} FROM h_agg",
)
def handoff_funnel(spark, sf_dir):
    """H1-H3: invitation, classified reply, completion after the invitation."""
    return FT.conversation_features(_msgs(spark, sf_dir), [FT.Handoff()])


@register(
    "conversation_state",
    _with(O.messages_cte(), O.ordinal_cte(), O.handoff_ctes(),
          f"v AS (SELECT cleaned_phone, {O.validation_expr()} AS pv FROM om GROUP BY cleaned_phone)")
    + """SELECT h_agg.cleaned_phone, v.pv AS pre_validacion_detected,
       h_agg.inv IS NOT NULL AS handoff_invitation_detected,
       CASE WHEN h_agg.inv IS NOT NULL THEN 'HANDOFF' WHEN v.pv THEN 'POST_VALIDACION'
            ELSE 'PRE_VALIDACION' END AS conversation_state
FROM h_agg JOIN v USING (cleaned_phone)""",
)
def conversation_state(spark, sf_dir):
    """V1 + H1 + C1 folded in one chain (state sees the earlier flags)."""
    specs = FT.chain(["validation", ("handoff", {"skip_handoff_started": True}), "conversation_state"])
    out = FT.conversation_features(_msgs(spark, sf_dir), specs)
    return out.select("cleaned_phone", "pre_validacion_detected", "handoff_invitation_detected", "conversation_state")


@register(
    "event_recency",
    _with(O.events_cte(), O.ordinal_cte("emsgs"), O.temporal_agg_sql(), O.metadata_agg_sql())
    + """SELECT t_agg.cleaned_phone AS user_key,
       HOURS_MINUTES_SINCE_LAST_USER_MESSAGE, HOURS_MINUTES_SINCE_LAST_MESSAGE,
       IS_WITHIN_REACTIVATION_WINDOW, IS_RECOVERY_PHASE_ELIGIBLE, NO_USER_MESSAGES_EXIST,
       last_message_sender
FROM (SELECT t_agg.cleaned_phone, """ + O.temporal_select() + """ FROM t_agg) t_agg
JOIN (SELECT m_agg.cleaned_phone, """ + O.metadata_select() + """ FROM m_agg) m USING (cleaned_phone)""",
)
def event_recency(spark, sf_dir):
    """T4-T7 and M1 over the event stream keyed by user (events as messages)."""
    out = FT.conversation_features(A.event_messages(spark, sf_dir), [FT.Temporal(), FT.Metadata()])
    return out.select(
        F.col("cleaned_phone").alias("user_key"),
        "HOURS_MINUTES_SINCE_LAST_USER_MESSAGE", "HOURS_MINUTES_SINCE_LAST_MESSAGE",
        "IS_WITHIN_REACTIVATION_WINDOW", "IS_RECOVERY_PHASE_ELIGIBLE", "NO_USER_MESSAGES_EXIST",
        "last_message_sender",
    )


# --------------------------------------------------------------- lead snapshot (entry)
SNAPSHOT_COLUMNS = [
    "lead_id", "name", "cleaned_phone", "NO_USER_MESSAGES_EXIST",
    "HOURS_MINUTES_SINCE_LAST_USER_MESSAGE", "HOURS_MINUTES_SINCE_LAST_MESSAGE",
    "IS_WITHIN_REACTIVATION_WINDOW", "IS_RECOVERY_PHASE_ELIGIBLE",
    "LAST_USER_MESSAGE_TIMESTAMP_TZ", "LAST_MESSAGE_TIMESTAMP_TZ",
    "last_message_sender", "last_user_message_text", "last_kuna_message_text",
    "last_message_ts", "conversation_digest",
]


def _snapshot_oracle() -> str:
    dig = f"dig AS (SELECT cleaned_phone, {O.digest_agg()} AS conversation_digest FROM msgs GROUP BY cleaned_phone)"
    return _with(O.messages_cte(), O.ordinal_cte(), O.temporal_agg_sql(), O.metadata_agg_sql(), O.leads_cte(), dig) + f"""
SELECT l.lead_id, l.name, l.cleaned_phone,
       t.NO_USER_MESSAGES_EXIST, t.HOURS_MINUTES_SINCE_LAST_USER_MESSAGE, t.HOURS_MINUTES_SINCE_LAST_MESSAGE,
       t.IS_WITHIN_REACTIVATION_WINDOW, t.IS_RECOVERY_PHASE_ELIGIBLE,
       t.LAST_USER_MESSAGE_TIMESTAMP_TZ, t.LAST_MESSAGE_TIMESTAMP_TZ,
       m.last_message_sender, m.last_user_message_text, m.last_kuna_message_text,
       coalesce(m.last_message_ts, {O.q(AS_OF_DEFAULT[:19])}) AS last_message_ts,
       coalesce(d.conversation_digest, {O.q(P.NO_CONVERSATION_DIGEST)}) AS conversation_digest
FROM leads l
LEFT JOIN (SELECT t_agg.cleaned_phone, {O.temporal_select()} FROM t_agg) t USING (cleaned_phone)
LEFT JOIN (SELECT m_agg.cleaned_phone, {O.metadata_select()} FROM m_agg) m USING (cleaned_phone)
LEFT JOIN dig d USING (cleaned_phone)"""


def lead_snapshot_plan(leads: DataFrame, messages: DataFrame, as_of: str = AS_OF_DEFAULT) -> DataFrame:
    """Leads with their conversation features, digest and P20 defaults."""
    feats = FT.conversation_features(messages, [FT.Temporal(), FT.Metadata(), FT.Digest()], as_of=as_of)
    out = leads.join(feats, "cleaned_phone", "left")
    out = out.withColumns({
        "last_message_ts": F.coalesce(F.col("last_message_ts"), F.lit(as_of[:19])),
        "conversation_digest": F.coalesce(F.col("conversation_digest"), F.lit(P.NO_CONVERSATION_DIGEST)),
    })
    return out.select(*SNAPSHOT_COLUMNS)


@register("lead_snapshot", _snapshot_oracle())
def lead_snapshot(spark, sf_dir):
    """Flagship: every lead with temporal + metadata features and the digest."""
    return lead_snapshot_plan(A.leads_from_customers(spark, sf_dir), _msgs(spark, sf_dir))


# --------------------------------------------------------------- lead selection
from convolens.functions.emails import clean_email, clean_email_sql  # noqa: E402
from convolens.functions.phones import (  # noqa: E402
    is_strict_phone,
    phone_first10,
    phone_last10,
    phone_last10_strict,
    phone_right10,
)
from convolens.functions.text import redact_pii  # noqa: E402
from convolens.functions.timefmt import age_text, iso_in_zone, seconds_between  # noqa: E402
from convolens.operators import leads as LD  # noqa: E402
from convolens.operators import messages as MS  # noqa: E402
from convolens.operators import report as RP  # noqa: E402
from convolens.operators.prompt import SYSTEM_MESSAGE, around, as_py_text, prompt_chunks  # noqa: E402
from convolens.operators.transcript import CHUNK_BYTES  # noqa: E402
from convolens.sources.tables import read_table  # noqa: E402

EXCLUDED_STATUS = "F"  # driver orders: status 'F' plays the role of a rejected profile


def _p10(e: str) -> str:
    return (f"lower(CASE WHEN position('+' IN {e}) > 0 THEN substr({e}, 1, position('+' IN {e}) - 1) || "
            f"CASE WHEN position('@' IN {e}) > 0 THEN substr({e}, position('@' IN {e})) ELSE {e} END ELSE {e} END)")


def _p9(e: str) -> str:
    dom = f"substr({e}, position('@' IN {e}) + 1)"
    return (f"CASE WHEN {e} IS NULL OR {e} = '' THEN '' "
            f"WHEN position('@' IN {e}) > 0 AND length({dom}) > 0 "
            f"THEN lower(split_part(split_part({e}, '@', 1), '+', 1)) || '@' || lower({dom}) "
            f"ELSE lower({e}) END")


LEAD_PRODUCT = "1-URGENT"  # driver orders: priority plays the role of the product
LEAD_LOOKBACK_DAYS = 9_000  # reaches into the driver's order dates from AS_OF


_LEAD_BOUNDS = f"""AND o_orderpriority = '{LEAD_PRODUCT}'
  AND o_orderdate >= CAST({O.AS_OF} AS DATE) - {LEAD_LOOKBACK_DAYS}"""


def _eligible_sql(bounds: str = "") -> str:
    """One aggregation: the newest lead per address among the eligible ones."""
    email = _p10(O.synthetic_email("c_name", "o_orderkey"))
    newest = "(o_orderdate, o_orderkey)"
    return f"""SELECT max_by(o_orderkey, {newest}) AS lead_id, max_by(o_custkey, {newest}) AS user_id,
       {email} AS clean_email, max(o_orderdate) AS lead_created_at
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE coalesce(o_orderstatus, '') NOT LIKE '%{EXCLUDED_STATUS}' {bounds}
  AND NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY {email}"""


def _eligible(spark, sf_dir, **bounds) -> DataFrame:
    return LD.eligible_leads(
        A.financing_leads(spark, sf_dir), A.leads_audit(spark, sf_dir), excluded_suffix=EXCLUDED_STATUS, **bounds
    )


def warehouse_leads(spark, sf_dir) -> DataFrame:
    """The lead query of a warehouse recipe."""
    bounds = {"product": LEAD_PRODUCT, "as_of": AS_OF_DEFAULT, "lookback_days": LEAD_LOOKBACK_DAYS}
    return LD.leads_with_contact(_eligible(spark, sf_dir, **bounds), A.intents(spark, sf_dir))


@register("eligible_leads", _eligible_sql())
def eligible_leads(spark, sf_dir):
    """P13 + J3 + W1: leads not in hand-off, eligible status, latest per e-mail."""
    return _eligible(spark, sf_dir)


@register(
    "lead_contact",
    f"""SELECT DISTINCT ON (lead.clean_email) lead.*, c.c_name AS name, c.c_mktsegment AS last_name,
       right('521' || CAST({A.PHONE_BASE} + c.c_custkey AS VARCHAR), 10) AS cleaned_phone_number
FROM ({_eligible_sql(_LEAD_BOUNDS)}) lead
JOIN (orders o JOIN customer c ON o.o_custkey = c.c_custkey)
  ON lead.clean_email = {_p10(O.synthetic_email('c.c_name', 'o.o_orderkey + 1'))}
ORDER BY lead.clean_email, o.o_orderdate DESC, o.o_orderkey DESC""",
)
def lead_contact(spark, sf_dir):
    """S1 lead query: product and look-back (P12, P13), P10 e-mails, W1/W2
    latest rows, J2 + J4."""
    return warehouse_leads(spark, sf_dir)


# --------------------------------------------------------------- message selection
TARGET_SEGMENT = "AUTOMOBILE"
MESSAGE_END = "2024-01-04 12:00:00"
LOOKBACK_DAYS = 90


@register(
    "messages_for_targets",
    _with(O.messages_cte())
    + f"""SELECT right('521' || CAST({A.PHONE_BASE} + m.conv_id AS VARCHAR), 10) AS cleaned_phone_number,
       m.src_ord, m.creation_time, m.msg_from,
       CASE WHEN m.msg_from = 'operator' THEN 'agent' END AS operator_alias, m.message
FROM msgs m
WHERE right('521' || CAST({A.PHONE_BASE} + m.conv_id AS VARCHAR), 10) IN
      (SELECT CAST({A.PHONE_BASE} + c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = '{TARGET_SEGMENT}')
  AND m.creation_time >= {O.AS_OF} - INTERVAL {LOOKBACK_DAYS} DAY
  AND m.creation_time <= TIMESTAMP '{MESSAGE_END}'
ORDER BY cleaned_phone_number, creation_time""",
)
def messages_for_targets(spark, sf_dir):
    """Message ⋈ session (J1), semi-join to target phones (J2), absolute
    and relative time bounds (P11, P12), ordered by phone and time (O1)."""
    j = MS.messages_with_sessions(A.raw_message_metrics(spark, sf_dir), A.session_metrics(spark, sf_dir))
    cust = read_table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == TARGET_SEGMENT)
    targets = cust.select(A.phone_of(F.col("c_custkey")).alias("cleaned_phone_number"))
    j = MS.for_targets(j, targets, "cleaned_phone_number")
    j = MS.time_bounds(j, end=MESSAGE_END, as_of=AS_OF_DEFAULT, lookback_days=LOOKBACK_DAYS)
    return j.orderBy("cleaned_phone_number", "creation_time")


@register(
    "phase_start_messages",
    """WITH fs AS (SELECT user_id, min(ts) AS phase_start FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id, e.event_id, e.ts, e.event_type, fs.phase_start
FROM events e JOIN fs ON e.user_id = fs.user_id
WHERE e.ts >= fs.phase_start""",
)
def phase_start_messages(spark, sf_dir):
    """A2 + J5: per user the first purchase, then every event from it on."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return MS.from_phase_start(e, F.col("event_type") == "purchase", key="user_id", time_col="ts")


# --------------------------------------------------------------- cleaning functions
def _raw_phones_spark(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    p = A.phone_of(k)
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("+52 1 "), p))
        .when(k % 5 == 1, F.concat(F.lit("521"), p))
        .when(k % 5 == 2, F.concat(F.substring(p, 1, 2), F.lit("-"), F.substring(p, 3, 4), F.lit("-"), F.substring(p, 7, 4)))
        .when(k % 5 == 3, k.cast("string"))
        .otherwise(F.concat(F.lit(" "), p, F.lit(" ")))
    )
    cust = c.select(F.lit("customer").alias("source"), k.alias("id"), raw.alias("raw"))
    d = read_table(spark, sf_dir, "documents")
    runs = F.regexp_extract_all(F.col("text"), F.lit("[0-9][0-9 ()+-]{8,}[0-9]"), F.lit(0))
    docs = d.select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.explode_outer(runs).alias("raw"))
    return cust.unionByName(docs)


@register(
    "phone_variants",
    f"""WITH r AS (
  SELECT 'customer' AS source, c_custkey AS id,
         CASE c_custkey % 5
           WHEN 0 THEN '+52 1 ' || CAST({A.PHONE_BASE} + c_custkey AS VARCHAR)
           WHEN 1 THEN '521' || CAST({A.PHONE_BASE} + c_custkey AS VARCHAR)
           WHEN 2 THEN substr(CAST({A.PHONE_BASE} + c_custkey AS VARCHAR), 1, 2) || '-' ||
                       substr(CAST({A.PHONE_BASE} + c_custkey AS VARCHAR), 3, 4) || '-' ||
                       substr(CAST({A.PHONE_BASE} + c_custkey AS VARCHAR), 7, 4)
           WHEN 3 THEN CAST(c_custkey AS VARCHAR)
           ELSE ' ' || CAST({A.PHONE_BASE} + c_custkey AS VARCHAR) || ' ' END AS raw
  FROM customer
  UNION ALL
  SELECT 'document', doc_id, raw
  FROM documents LEFT JOIN (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9 ()+-]{{8,}}[0-9]')) AS raw FROM documents) USING (doc_id)
)
SELECT source, id, raw,
       nullif(regexp_extract(trim(raw), '([0-9]{{10}})', 1), '') AS phone_a,
       CASE WHEN raw IS NULL OR raw = '' THEN '' ELSE right(regexp_replace(raw, '[^0-9]', '', 'g'), 10) END AS phone_b,
       CASE WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 10
            THEN right(regexp_replace(raw, '[^0-9]', '', 'g'), 10) ELSE '' END AS phone_c,
       right(raw, 10) AS phone_d,
       coalesce(regexp_matches(trim(raw), '^[0-9]{{10}}$'), false) AS strict_ok
FROM r""",
)
def phone_variants(spark, sf_dir):
    """The four phone rules side by side, plus the strict 10-digit test."""
    r = _raw_phones_spark(spark, sf_dir)
    return r.select(
        "source", "id", "raw",
        phone_first10("raw").alias("phone_a"),
        phone_last10("raw").alias("phone_b"),
        phone_last10_strict("raw").alias("phone_c"),
        phone_right10("raw").alias("phone_d"),
        is_strict_phone("raw").alias("strict_ok"),
    )


def _raw_email_sql() -> str:
    n = "replace(c_name, '#', '.')"
    return f"""CASE c_custkey % 6
      WHEN 0 THEN {n} || '+o' || CAST(c_custkey % 3 AS VARCHAR) || '@Example.com'
      WHEN 1 THEN {n} || '@Example.com'
      WHEN 2 THEN 'Foo.' || CAST(c_custkey AS VARCHAR) || '@ex+ample.com'
      WHEN 3 THEN {n} || '+x'
      WHEN 4 THEN NULL
      ELSE '' END"""


@register(
    "clean_emails",
    f"""WITH e AS (SELECT c_custkey, {_raw_email_sql()} AS raw_email FROM customer)
SELECT c_custkey, raw_email, {_p9('raw_email')} AS email_app, {_p10('raw_email')} AS email_sql FROM e""",
)
def clean_emails(spark, sf_dir):
    """P9 vs P10 on synthetic addresses (alias, '+' in domain, no '@', null, '')."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    n = F.regexp_replace(F.col("c_name"), "#", ".")
    raw = (
        F.when(k % 6 == 0, F.concat(n, F.lit("+o"), (k % 3).cast("string"), F.lit("@Example.com")))
        .when(k % 6 == 1, F.concat(n, F.lit("@Example.com")))
        .when(k % 6 == 2, F.concat(F.lit("Foo."), k.cast("string"), F.lit("@ex+ample.com")))
        .when(k % 6 == 3, F.concat(n, F.lit("+x")))
        .when(k % 6 == 4, F.lit(None).cast("string"))
        .otherwise(F.lit(""))
    )
    e = c.select(k, raw.alias("raw_email"))
    return e.select("c_custkey", "raw_email", clean_email("raw_email").alias("email_app"),
                    clean_email_sql("raw_email").alias("email_sql"))


@register(
    "redact_documents",
    f"""SELECT doc_id,
       regexp_replace(regexp_replace(text, '\\b[0-9]{{10,}}\\b', {O.q(P.PII_PHONE_TOKEN)}, 'g'),
                      {O.q(P.PII_EMAIL)}, {O.q(P.PII_EMAIL_TOKEN)}, 'g') AS redacted_text
FROM documents""",
)
def redact_documents(spark, sf_dir):
    """F4 over whole document texts: phone runs first, then e-mail addresses."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", redact_pii("text").alias("redacted_text"))


# --------------------------------------------------------------- transcripts
@register(
    "conversation_digest",
    _with(O.messages_cte())
    + f"SELECT cleaned_phone, {O.digest_agg()} AS conversation_digest, count(*) AS n_messages FROM msgs GROUP BY cleaned_phone",
)
def conversation_digest_q(spark, sf_dir):
    """F6 + F7: digest of the normalised transcript per conversation."""
    return conversation_digest(_msgs(spark, sf_dir))


# FIXED VALUES — the prompt template used by the prompt_render query.
PROMPT_TEMPLATE = (
    "Hoy es {HOY_ES}. Ultimo mensaje: {LAST_QUERY_TIMESTAMP} (hace {delta_real_time_formateado}).\n"
    "Sin mensajes del usuario: {NO_USER_MESSAGES_EXIST}; desde el ultimo del usuario: "
    "{HOURS_MINUTES_SINCE_LAST_USER_MESSAGE}; desde el ultimo: {HOURS_MINUTES_SINCE_LAST_MESSAGE}.\n"
    "Minutos: {delta_min}. Estado: {conversation_state}; invitacion: {handoff_invitation_detected} {handoff_response} "
    "{handoff_finalized}; prevalidacion: {pre_validacion_detected}; plantillas: {recovery_template_detected} "
    "{consecutive_recovery_templates_count}; persona: {human_transfer}.\n"
    "Ultimo de {last_message_sender} ({last_message_ts}); usuario: {last_user_message_text}; nosotros: {last_kuna_message_text}.\n"
    "Ventana: {IS_WITHIN_REACTIVATION_WINDOW} {IS_RECOVERY_PHASE_ELIGIBLE} {LAST_USER_MESSAGE_TIMESTAMP_TZ} {LAST_MESSAGE_TIMESTAMP_TZ}\n"
    "Conversacion:\n{conversation_text}\n"
    "Responde solo en YAML con las llaves {{summary}} y {{next_action_code}}."
)


PROMPT_BUDGET = 4096  # bytes of a chunk


def prompt_plan(messages: DataFrame, template: str = PROMPT_TEMPLATE, as_of: str = AS_OF_DEFAULT,
                tz: str = "America/Mexico_City", budget: int = CHUNK_BYTES) -> DataFrame:
    """Render one prompt per conversation, as chunk rows, and estimate
    its tokens; the template may name the clock values and every feature column."""
    specs = FT.chain([("temporal", {"timezone": tz}), *[n for n in FT.DEFAULT_CHAIN if n != "temporal"]])
    feats = FT.conversation_features(messages, [*specs, FT.LastTimes()], as_of=as_of)
    as_of_ts = F.to_timestamp(F.lit(as_of))
    since = seconds_between(as_of_ts, F.col("last_message_time"))
    values = {n: as_py_text(F.col(n), t.typeName()) for n, t in FT.feature_columns(specs)}
    values |= {
        "HOY_ES": iso_in_zone(as_of_ts, tz),
        "LAST_QUERY_TIMESTAMP": F.coalesce(iso_in_zone(F.col("last_message_time"), "UTC"), F.lit("N/A")),
        "delta_min": F.coalesce((since / F.lit(60.0)).cast("string"), F.lit("inf")),
        "delta_real_time_formateado": age_text(since),
    }
    texts = feats.select("cleaned_phone", *[c.alias(n) for n, c in values.items()])
    out = prompt_chunks(messages, texts, template, keep=("delta_real_time_formateado",), budget=budget)
    return out.withColumnRenamed("delta_real_time_formateado", "age_text")


def _prompt_oracle() -> str:
    age_h = f"(({O.secs_since('t.last_ts')}) / 60.0 / 60.0)"
    age_m = f"(({O.secs_since('t.last_ts')}) / 60.0)"
    age = (f"CASE WHEN t.last_ts IS NULL THEN 'N/A' WHEN {age_h} < 1.0 THEN printf('%.0f', {age_m}) || ' min' "
           f"WHEN {age_h} < 48.0 THEN printf('%.1f', {age_h}) || ' h' "
           f"ELSE printf('%.1f', {age_h} / 24.0) || ' días' END")
    sel = O.temporal_select("t")
    flags = ["NO_USER_MESSAGES_EXIST", "IS_WITHIN_REACTIVATION_WINDOW", "IS_RECOVERY_PHASE_ELIGIBLE", "human_transfer",
             "handoff_invitation_detected", "handoff_finalized", "pre_validacion_detected", "recovery_template_detected"]
    texts = [n for n, _ in FT.feature_columns(FT.chain(FT.DEFAULT_CHAIN)) if n not in flags]
    vals = {
        "HOY_ES": O.iso_tz(O.AS_OF),
        "LAST_QUERY_TIMESTAMP": O.iso_tz("t.last_ts", "UTC"),
        "delta_min": f"CAST({age_m} AS VARCHAR)",
        "delta_real_time_formateado": age,
        **{n: f"CASE WHEN f.{n} THEN 'True' WHEN NOT f.{n} THEN 'False' ELSE 'None' END" for n in flags},
        **{n: f"coalesce(CAST(f.{n} AS VARCHAR), 'None')" for n in texts},
    }
    import string as _s

    def filled(template: str) -> str:
        parts = []
        for lit, field, _, _ in _s.Formatter().parse(template):
            if lit:
                parts.append(O.q(lit))
            if field is not None:
                parts.append(f"({vals[field]})")
        return " || ".join(parts)

    head, tail = map(filled, around(PROMPT_TEMPLATE, "conversation_text"))
    sys_bytes = len(SYSTEM_MESSAGE.encode("utf-8"))
    half, size, edge = PROMPT_BUDGET // 2, PROMPT_BUDGET // 8, PROMPT_BUDGET // 4
    cut = lambda text: f"unnest(range(0, (length({text}) - 1) // {edge} + 1)) AS i"
    return _with(O.messages_cte(), O.ordinal_cte(), O.temporal_agg_sql(name="t"),
                 """line AS (SELECT cleaned_phone, row_number() OVER (PARTITION BY cleaned_phone ORDER BY creation_time, src_ord) AS rn,
       '\\n[' || strftime(creation_time, '%Y-%m-%d %H:%M:%S') || '] ' || msg_from || ': ' || message AS line FROM msgs)""",
                 f"""piece AS (SELECT cleaned_phone, rn, piece, substr(line, piece * {size} + 1, {size}) AS text
  FROM (SELECT *, unnest(range(0, (length(line) - 1) // {size} + 1)) AS piece FROM line))""",
                 """placed AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY cleaned_phone ORDER BY rn, piece) AS upto FROM piece)""",
                 f"""chunk AS (SELECT cleaned_phone, CAST((upto - 1) // {half} AS BIGINT) AS no,
       string_agg(CASE WHEN rn = 1 AND piece = 0 THEN substr(text, 3) ELSE text END, '' ORDER BY rn, piece) AS text
  FROM placed GROUP BY ALL)""",
                 """x AS (SELECT cleaned_phone, count(DISTINCT rn) AS n_messages, max(upto) - 2 AS n_bytes FROM placed GROUP BY cleaned_phone)""",
                 """c AS (SELECT cleaned_phone, count(*) AS n FROM chunk GROUP BY cleaned_phone)""",
                 O.metadata_agg_sql(), O.handoff_ctes(), O.template_agg_sql(),
                 f"f0 AS (SELECT t.cleaned_phone, {sel} FROM t)",
                 f"f1 AS (SELECT m_agg.cleaned_phone, {O.metadata_select()} FROM m_agg)",
                 f"f2 AS (SELECT h_agg.cleaned_phone, {O.handoff_select()} FROM h_agg)",
                 f"f3 AS (SELECT r_agg.cleaned_phone, {O.template_select()} FROM r_agg)",
                 f"""f4 AS (SELECT cleaned_phone, {O.validation_expr()} AS pre_validacion_detected, {O.transfer_expr()} AS human_transfer
  FROM om GROUP BY cleaned_phone)""",
                 """f AS (SELECT *, CASE WHEN handoff_invitation_detected THEN 'HANDOFF' WHEN pre_validacion_detected THEN 'POST_VALIDACION'
       ELSE 'PRE_VALIDACION' END AS conversation_state
  FROM f0 JOIN f1 USING (cleaned_phone) JOIN f2 USING (cleaned_phone) JOIN f3 USING (cleaned_phone) JOIN f4 USING (cleaned_phone))""",
                 f"""p0 AS (SELECT x.cleaned_phone, x.n_messages, c.n AS middle, x.n_bytes, {age} AS age_text, {head} AS head, {tail} AS tail
  FROM x JOIN t USING (cleaned_phone) JOIN f USING (cleaned_phone) JOIN c USING (cleaned_phone))""",
                 f"""p AS (SELECT *, (length(head) - 1) // {edge} + 1 AS n_head, n_head + middle + (length(tail) - 1) // {edge} + 1 AS n_chunks,
       CAST(strlen(head) + strlen(tail) + n_bytes + {sys_bytes} + 11 AS BIGINT) AS token_estimate FROM p0)""",
                 f"""parts AS (
  SELECT cleaned_phone, i AS chunk_no, substr(head, i * {edge} + 1, {edge}) AS text FROM (SELECT *, {cut("head")} FROM p)
  UNION ALL SELECT cleaned_phone, n_head + no, text FROM chunk JOIN p USING (cleaned_phone)
  UNION ALL SELECT cleaned_phone, n_head + middle + i, substr(tail, i * {edge} + 1, {edge}) FROM (SELECT *, {cut("tail")} FROM p))""") + """
SELECT cleaned_phone, CAST(chunk_no AS BIGINT) AS chunk_no, parts.text, CAST(n_chunks AS BIGINT) AS n_chunks, n_messages, token_estimate, age_text
FROM parts JOIN p USING (cleaned_phone)"""


@register("prompt_render", _prompt_oracle())
def prompt_render(spark, sf_dir):
    """The prompt of each conversation in chunks, age text and token estimate."""
    return prompt_plan(_msgs(spark, sf_dir), budget=PROMPT_BUDGET)


# --------------------------------------------------------------- runs over subsets of conversations
@register(
    "no_conversation_leads",
    _with(O.messages_cte(), O.leads_cte())
    + f"""SELECT lead_id, name, cleaned_phone, {O.q(P.NO_CONVERSATION_SUMMARY)} AS summary,
       {O.q(P.NO_CONVERSATION_DIGEST)} AS conversation_digest
FROM leads WHERE cleaned_phone NOT IN (SELECT cleaned_phone FROM msgs)""",
)
def no_conversation_leads(spark, sf_dir):
    """Leads without any message get the default result row."""
    return RP.no_conversation_rows(
        A.leads_from_customers(spark, sf_dir), _msgs(spark, sf_dir),
        summary=P.NO_CONVERSATION_SUMMARY, conversation_digest=P.NO_CONVERSATION_DIGEST,
    )


LIMIT_CONVERSATIONS = 25


@register(
    "limited_run",
    _with(O.messages_cte(), O.leads_cte(),
          f"k AS (SELECT DISTINCT cleaned_phone FROM msgs ORDER BY cleaned_phone LIMIT {LIMIT_CONVERSATIONS})",
          "n AS (SELECT cleaned_phone, count(*) AS n_messages FROM msgs WHERE cleaned_phone IN (SELECT cleaned_phone FROM k) GROUP BY cleaned_phone)")
    + "SELECT l.lead_id, l.cleaned_phone, n.n_messages FROM leads l LEFT JOIN n USING (cleaned_phone)",
)
def limited_run(spark, sf_dir):
    """Only the first N conversations (key order) are processed, but
    every lead is still reported (the others with no result)."""
    m = MS.limit_conversations(_msgs(spark, sf_dir), LIMIT_CONVERSATIONS)
    n = m.groupBy("cleaned_phone").agg(F.count(F.lit(1)).alias("n_messages"))
    leads = A.leads_from_customers(spark, sf_dir)
    return leads.join(n, "cleaned_phone", "left").select("lead_id", "cleaned_phone", "n_messages")


@register(
    "template_conversations",
    _with(O.messages_cte(),
          f"k AS (SELECT cleaned_phone FROM msgs GROUP BY cleaned_phone HAVING bool_or(message = {O.q(A.BOT_OFFER)}))")
    + "SELECT cleaned_phone, src_ord, msg_from, message FROM msgs WHERE cleaned_phone IN (SELECT cleaned_phone FROM k)",
)
def template_conversations(spark, sf_dir):
    """Whole conversations that contain the given template message."""
    m = MS.content_filter(_msgs(spark, sf_dir), F.col("message") == A.BOT_OFFER)
    return m.select("cleaned_phone", "src_ord", "msg_from", "message")


# --------------------------------------------------------------- decision rules
from convolens.operators import incremental as INC  # noqa: E402
from convolens.operators import labels as LB  # noqa: E402
from convolens.operators import rules as RU  # noqa: E402

CAMPAIGN_START = "2024-01-02 00:00:00"


def _rule_features(spark, sf_dir, extra=()):
    specs = FT.chain(["temporal", "metadata", "recency", *extra])
    return FT.conversation_features(_msgs(spark, sf_dir), specs)


def _transfer_ctx_sql() -> str:
    import re as _re

    hit = O.regex_any(O.strip_acc("message"), [_re.escape(p) for p in P.HUMAN_TRANSFER], ignore_case=True)
    return f"""tr AS (SELECT cleaned_phone, min(i) FILTER (WHERE msg_from = 'bot' AND {hit}) AS first_tr FROM om GROUP BY cleaned_phone),
tc AS (SELECT o.cleaned_phone, arg_max(coalesce(o.message, ''), o.i) FILTER (WHERE o.msg_from = 'user' AND o.i < tr.first_tr) AS ctx,
              {O.transfer_expr()} AS human_transfer
       FROM om o JOIN tr USING (cleaned_phone) GROUP BY o.cleaned_phone)"""


def _initial_sql(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {O.q(c)} THEN {O.q(a)}" for c, a in P.STALL_INITIAL_ACTION) + " END"


@register(
    "next_action",
    _with(O.messages_cte(), O.ordinal_cte(), O.temporal_agg_sql(), O.recency_cte(), O.labels_cte(), _transfer_ctx_sql(),
          f"f AS (SELECT t_agg.cleaned_phone, {O.temporal_select()} FROM t_agg)",
          f"""b AS (SELECT f.cleaned_phone, lab.primary_stall_reason_code, lab.suggested_message_es AS msg,
       CASE WHEN f.NO_USER_MESSAGES_EXIST THEN 'NUNCA_RESPONDIO' WHEN rec.hours_since_last_user_message < 6 THEN 'PROCESO_EN_CURSO'
            WHEN rec.hours_since_last_user_message >= 12 THEN 'GHOSTING' ELSE 'OTRO' END AS silence_band,
       {_initial_sql('lab.primary_stall_reason_code')} AS initial_action,
       f.IS_RECOVERY_PHASE_ELIGIBLE AS elig, tc.human_transfer, tc.ctx
  FROM f JOIN rec USING (cleaned_phone) JOIN lab USING (cleaned_phone) JOIN tc USING (cleaned_phone))""",
          """c AS (SELECT *, CASE WHEN coalesce(elig, false) AND initial_action IS NOT NULL AND initial_action NOT IN ('CERRAR', 'LLAMAR_LEAD')
                         THEN 'ENVIAR_PLANTILLA_RECUPERACION' ELSE initial_action END AS next_action_code FROM b)""")
    + f"""SELECT cleaned_phone, primary_stall_reason_code, silence_band, initial_action, next_action_code,
       CASE WHEN {O.in_list('next_action_code', P.MESSAGE_ACTIONS)} THEN msg ELSE 'N/A' END AS suggested_message_es,
       CASE WHEN coalesce(human_transfer, false) THEN coalesce(ctx, 'N/A') ELSE 'N/A' END AS transfer_context_analysis
FROM c""",
)
def next_action(spark, sf_dir):
    """B1-B5 + B12 + J9: silence band, stall -> initial action (lookup),
    recovery override, message and transfer-context gating."""
    feats = _rule_features(spark, sf_dir, ["human_transfer", "transfer_context"])
    lab = A.latest_labels(spark, sf_dir).select("cleaned_phone", "primary_stall_reason_code", "suggested_message_es")
    dim = RU.lookup_table(spark, P.STALL_INITIAL_ACTION, ["primary_stall_reason_code", "initial_action"])
    j = RU.code_lookup(feats.join(lab, "cleaned_phone"), dim, "primary_stall_reason_code")
    action = RU.next_action("initial_action", "IS_RECOVERY_PHASE_ELIGIBLE")
    return j.select(
        "cleaned_phone", "primary_stall_reason_code",
        RU.silence_band("NO_USER_MESSAGES_EXIST", "hours_since_last_user_message").alias("silence_band"),
        "initial_action",
        action.alias("next_action_code"),
        RU.suggested_message(action, "suggested_message_es").alias("suggested_message_es"),
        RU.transfer_context("human_transfer", "transfer_user_context").alias("transfer_context_analysis"),
    )


def _engagement_sql() -> str:
    u, m = "rec.hours_since_last_user_message", "rec.hours_since_last_message"
    return f"""CASE WHEN coalesce(f.NO_USER_MESSAGES_EXIST, true) THEN 'IGNORED_INITIAL_CONTACT'
            WHEN coalesce(lab.explicit_disinterest, false) THEN 'EXPLICIT_DISINTEREST'
            WHEN coalesce(lab.technical_issue, false) THEN 'TECHNICAL_ISSUE_REPORTED'
            WHEN mm.last_message_sender = 'user' AND {u} < 6.0 THEN 'KUNA_PENDING_RESPONSE'
            WHEN mm.last_message_sender = 'kuna' AND {m} >= 6.0 THEN 'STALLED_AFTER_RESPONSE'
            WHEN mm.last_message_sender = 'kuna' AND {m} < 6.0 THEN 'USER_PENDING_RESPONSE'
            WHEN {m} < 6.0 THEN 'ENGAGED_ACTIVE_CONVO' ELSE 'N/A' END"""


@register(
    "engagement_status",
    _with(O.messages_cte(), O.ordinal_cte(), O.temporal_agg_sql(), O.metadata_agg_sql(), O.recency_cte(), O.labels_cte(),
          f"f AS (SELECT t_agg.cleaned_phone, {O.temporal_select()} FROM t_agg)",
          f"mm AS (SELECT m_agg.cleaned_phone, {O.metadata_select()} FROM m_agg)",
          f"""e AS (SELECT f.cleaned_phone, lab.primary_stall_reason_code AS st, {_engagement_sql()} AS current_engagement_status,
       rec.hours_since_last_message AS mh, rec.hours_since_last_user_message AS uh
  FROM f JOIN mm USING (cleaned_phone) JOIN rec USING (cleaned_phone) JOIN lab USING (cleaned_phone))""")
    + f"""SELECT cleaned_phone, current_engagement_status,
       CASE WHEN st = 'NUNCA_RESPONDIO' THEN 'LLAMAR_LEAD_NUNCA_RESPONDIO'
            WHEN {O.in_list('st', P.INELIGIBLE_CODES)} THEN 'CERRAR_CASO'
            WHEN st = 'DESINTERES_EXPLICITO' AND current_engagement_status = 'EXPLICIT_DISINTEREST' THEN 'CERRAR_CASO'
            WHEN current_engagement_status = 'TECHNICAL_ISSUE_REPORTED' THEN 'ESCALAR_CASO_A_HUMANO'
            WHEN current_engagement_status = 'KUNA_PENDING_RESPONSE' THEN 'RESPONDER_AL_CLIENTE'
            WHEN st = 'PROCESO_EN_CURSO' AND current_engagement_status IN ('ENGAGED_ACTIVE_CONVO', 'KUNA_PENDING_RESPONSE') THEN 'MONITOREAR_CONVERSACION'
            WHEN current_engagement_status = 'USER_PENDING_RESPONSE' THEN 'PROGRAMAR_RECONTACTO_AUTOMATICO'
            WHEN current_engagement_status = 'STALLED_AFTER_RESPONSE' OR st = 'GHOSTING' THEN
                 CASE WHEN (CASE WHEN current_engagement_status = 'STALLED_AFTER_RESPONSE' THEN mh ELSE uh END) > 24.0
                      THEN 'PROGRAMAR_RECONTACTO_ESPECIAL' ELSE 'PROGRAMAR_RECONTACTO_AUTOMATICO' END
            WHEN {O.in_list('st', P.RECONTACT_CODES)} THEN 'PROGRAMAR_RECONTACTO_AUTOMATICO'
            WHEN {O.in_list('st', P.ESCALATE_CODES)} THEN 'ESCALAR_CASO_A_HUMANO'
            ELSE 'REVISAR_MANUALMENTE' END AS next_action_code
FROM e""",
)
def engagement_status(spark, sf_dir):
    """B6 + B7: engagement status and the engagement recipe's next action."""
    feats = _rule_features(spark, sf_dir)
    lab = A.latest_labels(spark, sf_dir)
    j = feats.join(lab, "cleaned_phone")
    status = RU.engagement_status("NO_USER_MESSAGES_EXIST", "last_message_sender", "hours_since_last_user_message",
                                  "hours_since_last_message", "explicit_disinterest", "technical_issue")
    action = RU.engagement_action("primary_stall_reason_code", status, "hours_since_last_message",
                                  "hours_since_last_user_message", silence_hours=24.0)
    return j.select("cleaned_phone", status.alias("current_engagement_status"), action.alias("next_action_code"))


@register(
    "campaign_action",
    _with(O.messages_cte(), O.ordinal_cte(), O.temporal_agg_sql(), O.recency_cte(), O.labels_cte(),
          f"f AS (SELECT t_agg.cleaned_phone, {O.temporal_select()} FROM t_agg)",
          f"""fu AS (SELECT cleaned_phone, count(*) FILTER (WHERE lower(msg_from) = 'operator' AND creation_time >= TIMESTAMP '{CAMPAIGN_START}') AS follow_up_attempts
  FROM msgs GROUP BY cleaned_phone)""",
          "dim(current_engagement_status, next_action_code, next_action_context) AS (VALUES "
          + ", ".join(f"({O.q(s)}, {O.q(a)}, {O.q(c)})" for s, a, c in P.CAMPAIGN_ACTION) + ")",
          """s AS (SELECT f.cleaned_phone, lab.suggested_message_es AS msg, fu.follow_up_attempts,
       CASE WHEN coalesce(f.NO_USER_MESSAGES_EXIST, true) AND starts_with(lab.campaign_label, 'PROCESS_STARTED') THEN 'IGNORED_NO_RESPONSE'
            WHEN starts_with(lab.campaign_label, 'PROCESS_STARTED') AND rec.hours_since_last_user_message > 48.0 THEN 'PROCESS_STARTED_UNFINISHED'
            WHEN starts_with(lab.campaign_label, 'PROCESS_STARTED') THEN 'PROCESS_STARTED_ACTIVE'
            ELSE lab.campaign_label END AS current_engagement_status
  FROM f JOIN rec USING (cleaned_phone) JOIN lab USING (cleaned_phone) JOIN fu USING (cleaned_phone))""")
    + """SELECT s.cleaned_phone, s.current_engagement_status, dim.next_action_code, dim.next_action_context,
       CASE WHEN starts_with(dim.next_action_code, 'RESPOND_') THEN s.msg ELSE 'N/A' END AS suggested_message_es,
       s.follow_up_attempts
FROM s LEFT JOIN dim USING (current_engagement_status)""",
)
def campaign_action(spark, sf_dir):
    """B8 + B9 + B11 + J9: campaign status split at 48 h of user silence,
    status -> action + context lookup, RESPOND_* messages, follow-up count."""
    feats = _rule_features(spark, sf_dir, [("follow_ups", {"campaign_start": CAMPAIGN_START})])
    lab = A.latest_labels(spark, sf_dir).select("cleaned_phone", "campaign_label", "suggested_message_es")
    j = feats.join(lab, "cleaned_phone").withColumn(
        "current_engagement_status",
        RU.campaign_status("campaign_label", "NO_USER_MESSAGES_EXIST", "hours_since_last_user_message"),
    )
    j = RU.code_lookup(j, RU.campaign_table(spark), "current_engagement_status")
    return j.select(
        "cleaned_phone", "current_engagement_status", "next_action_code", "next_action_context",
        RU.campaign_message("next_action_code", "suggested_message_es").alias("suggested_message_es"),
        "follow_up_attempts",
    )


def _smart_summary_sql(d="documentos_enviados_analisis", v="enviado_a_validacion", qq="calidad_atencion_agente",
                       g="gps_instalacion_agendada") -> str:
    dl, vl, ql, gl = (f"lower(coalesce({x}, 'nan'))" for x in (d, v, qq, g))
    return f"""CASE WHEN {d} IS NULL OR {d} = '' THEN {O.q(P.SUMMARY_NO_CONVERSATION)}
            WHEN contains({gl}, 'gps completado') OR contains({gl}, 'completado') THEN {O.q(P.SUMMARY_GPS_DONE)}
            WHEN contains({vl}, 'sí') THEN CASE WHEN contains({gl}, 'agendado') THEN {O.q(P.SUMMARY_VALIDATION_GPS_SCHEDULED)}
                                                WHEN contains({gl}, 'pendiente') THEN {O.q(P.SUMMARY_VALIDATION_GPS_PENDING)}
                                                ELSE {O.q(P.SUMMARY_VALIDATION)} END
            WHEN contains({dl}, 'faltan') THEN CASE WHEN contains({ql}, 'mala') OR contains({ql}, 'regular') THEN {O.q(P.SUMMARY_STUCK)}
                                                    ELSE {O.q(P.SUMMARY_MISSING_DOCS)} END
            WHEN contains({dl}, 'documentos completos') THEN CASE WHEN contains({gl}, 'agendado') THEN {O.q(P.SUMMARY_DOCS_GPS_SCHEDULED)}
                                                                  ELSE {O.q(P.SUMMARY_DOCS_GPS_PENDING)} END
            ELSE {O.q(P.SUMMARY_IN_PROGRESS)} END"""


def _curated_sql() -> str:
    blank = lambda e: f"CASE WHEN CAST({e} AS VARCHAR) IS NULL OR CAST({e} AS VARCHAR) IN ('nan', 'None', 'NaN') THEN '' ELSE CAST({e} AS VARCHAR) END"
    src = {
        "agente": "''", "asset_id": "''", "nombre": "l.name", "correo": "''", "cleaned_phone": "l.cleaned_phone",
        "lead_created_at": "''", "resumen_general": _smart_summary_sql(*[f"lab.{c}" for c in (
            "documentos_enviados_analisis", "enviado_a_validacion", "calidad_atencion_agente", "gps_instalacion_agendada")]),
    }
    for c in ["documentos_enviados_analisis", "enviado_a_validacion", "calidad_atencion_agente",
              "objecion_principal_cliente", "gps_instalacion_agendada"]:
        src[c] = f"lab.{c}"
    cols = ",\n       ".join(f"{blank(src[c])} AS {c}" for c in P.CURATED_COLUMNS)
    return (_with(O.labels_cte(), f"""l AS (SELECT c_name AS name, CAST({A.PHONE_BASE} + c_custkey AS VARCHAR) AS cleaned_phone FROM customer)""")
            + f"SELECT {cols}\nFROM l LEFT JOIN lab USING (cleaned_phone)")


@register("smart_summary", _curated_sql())
def smart_summary(spark, sf_dir):
    """B10 + P18 + F15: smart summary per lead and the curated 12-column report."""
    leads = A.leads_from_customers(spark, sf_dir).select(F.col("name").alias("nombre"), "cleaned_phone")
    lab = A.latest_labels(spark, sf_dir)
    j = leads.join(lab, "cleaned_phone", "left").withColumn(
        "resumen_general",
        RU.smart_summary("documentos_enviados_analisis", "enviado_a_validacion", "calidad_atencion_agente",
                         "gps_instalacion_agendada"),
    )
    return RP.curated_projection(j)


# --------------------------------------------------------------- label repair
_ENUMS = {"primary_stall_reason_code": P.STALL_REASONS, "next_action_code": P.NEXT_ACTIONS}


@register(
    "label_repair",
    _with(O.messages_cte(), O.ordinal_cte(), O.temporal_agg_sql(), O.labels_cte(),
          f"f AS (SELECT t_agg.cleaned_phone, {O.temporal_select()} FROM t_agg)",
          "x AS (SELECT lab.*, f.NO_USER_MESSAGES_EXIST, f.HOURS_MINUTES_SINCE_LAST_MESSAGE FROM lab JOIN f USING (cleaned_phone))")
    + O.repair_sql("x", P.HANDOFF_LABEL_KEYS, _ENUMS, P.CRITICAL_ENUM_KEYS),
)
def label_repair(spark, sf_dir):
    """Validate labels against the recipe keys / enums and repair them."""
    feats = FT.conversation_features(_msgs(spark, sf_dir), [FT.Temporal()])
    lab = A.latest_labels(spark, sf_dir)
    j = lab.join(feats.select("cleaned_phone", "NO_USER_MESSAGES_EXIST", "HOURS_MINUTES_SINCE_LAST_MESSAGE"), "cleaned_phone")
    r = LB.repair_labels(j, P.HANDOFF_LABEL_KEYS, _ENUMS, P.CRITICAL_ENUM_KEYS)
    return r.select("cleaned_phone", *P.HANDOFF_LABEL_KEYS, "inferred_stall_stage", "had_errors")


# FIXED VALUES — raw response shapes; {text} is the conversation's own last text.
RESPONSE_SHAPES = [
    "```yaml\nsummary: {text}\nprimary_stall_reason_code: GHOSTING\nnext_action_code: INSISTIR\n"
    "suggested_message_es: 'Hola'\n```",
    'summary: "Cliente dijo "{text}" ayer"\nprimary_stall_reason_code: OTRO\nnext_action_code: ESPERAR',
    "summary: Valor con: {text}\nprimary_stall_reason_code: 'GHOSTING'\nnext_action_code: true\n"
    "suggested_message_es: null\nsuggested_message_es: {text}",
    "summary: primera linea\n{text}\nnext_action_code: CERRAR\nprimary_stall_reason_code: OTRO\nsuggested_message_es: x",
    "- a\n- {text}",
    "```\nsummary: {text}\ntransfer_context_analysis: nada\nprimary_stall_reason_code: PROCESO_EN_CURSO\n"
    "next_action_code: ESPERAR # seguro\nsuggested_message_es: hola\n```",
    None,
    "summary: |\n  {text}\n  otra linea\n\n  fin\nnext_action_code: ESPERAR\nsuggested_message_es: >-\n  uno\n  dos\n\n"
    "  tres\n    mas\nprimary_stall_reason_code: OTRO",
    "summary:\n  - {text}\n  - 'b c'\n  - 3\n  - true\n  - dos\n    lineas\nnext_action_code: [CERRAR, 2, 'x y']\n"
    "primary_stall_reason_code: GHOSTING\nsuggested_message_es:\n  tono: amable\n  texto: \"hola\"",
    "summary: x\n  next_action_code: CERRAR\n  primary_stall_reason_code:\n  suggested_message_es: {text}",
    "Claro, el analisis:\nsummary: {text}\nnext_action_code: INSISTIR\nprimary_stall_reason_code: OTRO\nsuggested_message_es: hola",
    "summary: 'uno\\tdos'\nnext_action_code: @nadie\nprimary_stall_reason_code: OTRO\nsuggested_message_es: {text}",
    "summary: >\n  {text}\n  sigue\nnext_action_code: |+\n  CERRAR\n\nprimary_stall_reason_code: \"OTRO\"\n"
    "suggested_message_es: \"a\\\\nb \\/ c\"",
]


def raw_responses(spark, sf_dir) -> DataFrame:
    """A raw model response per turn: a shape by conversation and turn around
    the whole text of the turn."""
    shapes = F.array(*[F.lit(s).cast("string") for s in RESPONSE_SHAPES])
    shape = F.element_at(shapes, ((F.col("conv_id") + F.col("turn")) % len(RESPONSE_SHAPES) + 1).cast("int"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return read_table(spark, sf_dir, "conversations").select(
        A.phone_of(F.col("conv_id")).alias("cleaned_phone"), "turn", F.replace(shape, F.lit("{text}"), text).alias("raw_response")
    )


PARSED_KEYS = list(P.HANDOFF_LABEL_KEYS)


@register("label_parse", _with(*O.parse_ctes(RESPONSE_SHAPES, PARSED_KEYS)) + "SELECT * FROM parsed")
def label_parse(spark, sf_dir):
    """Clean and parse raw responses, required keys."""
    p = LB.parse_labels(raw_responses(spark, sf_dir), required=PARSED_KEYS)
    return p.select(
        "cleaned_phone", "turn", "cleaned", "error", F.array_join("missing_keys", ",").alias("missing_keys"),
        *[F.try_element_at("labels", F.lit(k)).alias(k) for k in PARSED_KEYS],
    )


# --------------------------------------------------------------- incremental
def _versions(spark, sf_dir):
    """Every conversation's digest now, and as it was handled before: without
    its last message where ``conv_id % 3 = 0``.  Both from one scan."""
    m = A.message_rows(spark, sf_dir, keep_conv_id=True)
    both = INC.version_digests(m, F.col("conv_id") % 3 == 0)
    current = both.select("cleaned_phone", "conversation_digest", "n_messages")
    old = both.where("old_messages > 0").select(
        "cleaned_phone", F.col("old_digest").alias("conversation_digest"), F.col("old_messages").alias("n_messages")
    )
    return current, old


def _stored(spark, old: DataFrame) -> INC.ResultCache:
    """The results of three earlier runs, stored as they would have been."""
    cache = INC.ResultCache(spark, f"{checkpoint_dir(spark).rstrip('/')}/result-cache/{uuid.uuid4().hex}")
    for run, rows in enumerate(_runs(staged(old, "handled"))):
        cache.add(rows, f"run-{run}")
    return cache


def _runs(old: DataFrame) -> list[DataFrame]:
    """Result rows: all conversations, a later run over some, and corrupt entries."""
    conv = F.col("cleaned_phone").cast("bigint") - F.lit(A.PHONE_BASE)
    as_of = F.to_timestamp(F.lit(AS_OF_DEFAULT))
    base = old.select("cleaned_phone", "conversation_digest", "n_messages", conv.alias("conv_id"))

    def run(where, payload, at):
        return base.where(where).select("cleaned_phone", "conversation_digest", payload.alias("payload"), at.alias("scored_at"))

    text = lambda v: F.concat(F.lit(v), F.col("n_messages").cast("string"))
    return [
        run(F.lit(True), text("v1:"), as_of - F.expr("INTERVAL 1 DAY")),
        run(F.col("conv_id") % 4 == 0, text("v2:"), as_of - F.expr("INTERVAL 1 HOUR")),
        run(F.col("conv_id") % 5 == 1, F.lit(None).cast("string"), as_of),
    ]


_DIGEST_AGG = O.digest_agg()
_VERSION_CTES = [
    O.messages_cte(), O.ordinal_cte(),
    "mx AS (SELECT cleaned_phone, max(i) AS last_i FROM om GROUP BY cleaned_phone)",
    f"cur AS (SELECT cleaned_phone, any_value(conv_id) AS conv_id, {_DIGEST_AGG} AS conversation_digest, count(*) AS n FROM om GROUP BY cleaned_phone)",
    f"""old AS (SELECT cleaned_phone, any_value(conv_id) AS conv_id, {_DIGEST_AGG} AS conversation_digest, count(*) AS n
  FROM om JOIN mx USING (cleaned_phone) WHERE NOT (conv_id % 3 = 0 AND i = last_i) GROUP BY cleaned_phone)""",
    f"""cache AS (
  SELECT cleaned_phone, conversation_digest, 'v1:' || CAST(n AS VARCHAR) AS payload, {O.AS_OF} - INTERVAL 1 DAY AS scored_at FROM old
  UNION ALL SELECT cleaned_phone, conversation_digest, 'v2:' || CAST(n AS VARCHAR), {O.AS_OF} - INTERVAL 1 HOUR FROM old WHERE conv_id % 4 = 0
  UNION ALL SELECT cleaned_phone, conversation_digest, NULL, {O.AS_OF} FROM old WHERE conv_id % 5 = 1)""",
]


@register(
    "score_needed",
    _with(*_VERSION_CTES) + """SELECT cur.cleaned_phone, cur.conversation_digest FROM cur
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.payload IS NOT NULL AND c.cleaned_phone = cur.cleaned_phone
                  AND c.conversation_digest = cur.conversation_digest)""",
)
def score_needed(spark, sf_dir):
    """C2 + J8: conversations whose current digest has no usable cache entry."""
    current, old = _versions(spark, sf_dir)
    return _stored(spark, old).needed(current.select("cleaned_phone", "conversation_digest"))


@register(
    "cache_latest",
    _with(*_VERSION_CTES) + """SELECT conversation_digest, cleaned_phone, payload, strftime(scored_at, '%Y-%m-%d %H:%M:%S') AS scored_at FROM (
  SELECT *, row_number() OVER (PARTITION BY conversation_digest ORDER BY scored_at DESC, cleaned_phone DESC) AS rn FROM cache WHERE payload IS NOT NULL
) WHERE rn = 1""",
)
def cache_latest(spark, sf_dir):
    """Newest usable cache entry per digest (corrupt entries skipped)."""
    _, old = _versions(spark, sf_dir)
    latest = INC.latest_cache(_stored(spark, old).rows(old))
    return latest.select("conversation_digest", "cleaned_phone", "payload",
                         F.date_format("scored_at", "yyyy-MM-dd HH:mm:ss").alias("scored_at"))


def _campaign(conv):
    return F.concat(F.lit("campaign_"), (conv % 3).cast("string"))


def completion_log(old: DataFrame) -> DataFrame:
    """Completion records of every second conversation's earlier version."""
    conv = F.col("cleaned_phone").cast("bigint") - F.lit(A.PHONE_BASE)
    done = F.to_timestamp(F.lit(AS_OF_DEFAULT)) - F.expr("INTERVAL 2 HOURS") - F.make_dt_interval(mins=(conv % 50).cast("int"))
    return old.where(conv % 2 == 0).select(
        "cleaned_phone", _campaign(conv).alias("recipe"), F.col("conversation_digest").alias("digest"),
        F.concat(F.lit("agent_"), (conv % 5).cast("string")).alias("completed_by"),
        F.lit("follow-up done").alias("notes"),
        done.alias("completed_at"),
    )


def _completion(spark, sf_dir):
    current, old = _versions(spark, sf_dir)
    conv = F.col("cleaned_phone").cast("bigint") - F.lit(A.PHONE_BASE)
    old = staged(old, "handled")
    cur = current.select("cleaned_phone", _campaign(conv).alias("recipe"), "conversation_digest")
    return INC.completion_status(cur, completion_log(old))


_COMPLETION_CTES = _VERSION_CTES + [
    """st AS (SELECT cur.cleaned_phone, 'campaign_' || CAST(cur.conv_id % 3 AS VARCHAR) AS recipe,
       CASE WHEN old.cleaned_phone IS NULL THEN 'ACTIVE' WHEN old.conversation_digest = cur.conversation_digest THEN 'COMPLETED'
            ELSE 'REACTIVATED' END AS status,
       CASE WHEN old.cleaned_phone IS NOT NULL THEN 'agent_' || CAST(cur.conv_id % 5 AS VARCHAR) END AS completed_by
  FROM cur LEFT JOIN old ON old.cleaned_phone = cur.cleaned_phone AND old.conv_id % 2 = 0)""",
]


@register(
    "completion_status",
    _with(*_COMPLETION_CTES) + "SELECT cleaned_phone, recipe, status, completed_by, status <> 'COMPLETED' AS needs_processing FROM st",
)
def completion_status(spark, sf_dir):
    """C4 + C6: ACTIVE / COMPLETED / REACTIVATED per lead and campaign; skip rule."""
    s = _completion(spark, sf_dir)
    return s.select("cleaned_phone", "recipe", "status", "completed_by", "needs_processing")


@register(
    "completion_stats",
    _with(*_COMPLETION_CTES) + """SELECT recipe,
       count(*) FILTER (WHERE status <> 'ACTIVE') AS total_tracked,
       count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
       count(*) FILTER (WHERE status = 'REACTIVATED') AS reactivated,
       count(*) FILTER (WHERE status = 'ACTIVE') AS active,
       count(*) FILTER (WHERE status <> 'COMPLETED') AS processed,
       count(*) FILTER (WHERE status = 'COMPLETED') AS skipped,
       round(CASE WHEN count(*) FILTER (WHERE status <> 'ACTIVE') > 0
             THEN count(*) FILTER (WHERE status = 'COMPLETED') / count(*) FILTER (WHERE status <> 'ACTIVE') ELSE 0.0 END, 6) AS completion_rate
FROM st GROUP BY recipe""",
)
def completion_stats(spark, sf_dir):
    """A6 + A7: per campaign completion statistics and processed/skipped counts."""
    return INC.completion_stats(_completion(spark, sf_dir))


# --------------------------------------------------------------- recipe run and report
from convolens.plans.recipe import RECIPES, get_recipe, recipe_errors, run_recipe  # noqa: E402

REPORT_RECIPE = "simulation_to_handoff"
PUBLISH_STAMP = AS_OF_DEFAULT
# Bounds of the recipes moved into the driver's days, where they bite.
DRIVER_START, DRIVER_PHASE = "2024-01-02 00:00:00", A.BOT_RECEIVED.lower()


def driver_recipe(name: str):
    """A recipe with its message start and phase marker moved to the driver's data."""
    r = get_recipe(name)
    return replace(
        r,
        message_start=DRIVER_START if r.message_start else None,
        phase_start_pattern=DRIVER_PHASE if r.phase_start_pattern else None,
    )


def recipe_result(spark, sf_dir, recipe: str = REPORT_RECIPE) -> DataFrame:
    return run_recipe(driver_recipe(recipe), A.leads_from_customers(spark, sf_dir), _msgs(spark, sf_dir),
                      A.label_rows(spark, sf_dir))


def _bounds_sql(r) -> str:
    """Messages of a recipe as ``msgs``: time bounds, leads only, phase cut."""
    where = ["cleaned_phone IN (SELECT cleaned_phone FROM leads)"]
    if r.message_start:
        where.append(f"creation_time >= TIMESTAMP '{r.message_start}'")
    if r.message_end:
        where.append(f"creation_time <= TIMESTAMP '{r.message_end}'")
    if r.lookback_days:
        where.append(f"creation_time >= {O.AS_OF} - INTERVAL {r.lookback_days} DAY")
    sql = f"SELECT * FROM said WHERE {' AND '.join(where)}"
    if r.phase_start_pattern:
        hit = f"contains(lower(coalesce(message, '')), {O.q(r.phase_start_pattern)})"
        sql = (f"SELECT * EXCLUDE phase FROM (SELECT *, min(creation_time) FILTER ({hit}) OVER (PARTITION BY cleaned_phone)"
               f" AS phase FROM ({sql})) WHERE creation_time >= phase")
    return f"msgs AS ({sql})"


_LABEL_TABLE = [
    "summary", "primary_stall_reason_code", "next_action_code", "transfer_context_analysis", "suggested_message_es",
    "documentos_enviados_analisis", "enviado_a_validacion", "calidad_atencion_agente", "gps_instalacion_agendada",
    "objecion_principal_cliente",
]


def _report_oracle(recipe: str, stamp: str | None = None) -> str:
    r = driver_recipe(recipe)
    types = dict(FT.feature_columns(r.features()))
    parts = {
        "temporal": ("NO_USER_MESSAGES_EXIST", f"f AS (SELECT t_agg.cleaned_phone, {O.temporal_select()} FROM t_agg)"),
        "metadata": ("last_message_sender", f"mm AS (SELECT m_agg.cleaned_phone, {O.metadata_select(n=150)} FROM m_agg)"),
        "handoff": ("handoff_response", f"hh AS (SELECT h_agg.cleaned_phone, {O.handoff_select()} FROM h_agg)"),
        "template": ("recovery_template_detected", f"rr AS (SELECT r_agg.cleaned_phone, {O.template_select()} FROM r_agg)"),
        "validation": ("pre_validacion_detected", f"vv AS (SELECT cleaned_phone, {O.validation_expr()} AS pre_validacion_detected FROM om GROUP BY cleaned_phone)"),
        "transfer": ("human_transfer", f"xx AS (SELECT cleaned_phone, {O.transfer_expr()} AS human_transfer FROM om GROUP BY cleaned_phone)"),
    }
    used = [sql for column, sql in parts.values() if column in types]
    feat = "SELECT * FROM (SELECT DISTINCT cleaned_phone FROM om)" + "".join(
        f" JOIN {sql.split(' ')[0]} USING (cleaned_phone)" for sql in used)
    labels = [k.name for k in r.label_keys if k.name not in types and k.name != "conversation_digest"]
    required = [k for k in r.required_keys if k in labels]
    enums = {k: v for k, v in r.enums.items() if k in labels}
    flags = {"NO_USER_MESSAGES_EXIST": "BOOLEAN", "HOURS_MINUTES_SINCE_LAST_MESSAGE": "VARCHAR"}
    x = ", ".join(
        ["lab.cleaned_phone", "lab.error_kind", "lab.inferred_stall_stage"]
        + [f"lab.{k}" if k in _LABEL_TABLE else f"CAST(NULL AS VARCHAR) AS {k}" for k in labels]
        + [f"feat.{k}" if k in types else f"CAST(NULL AS {t}) AS {k}" for k, t in flags.items()])
    kinds = " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in LB.ERROR_SUMMARIES.items())
    over = {"summary": f"CASE x.error_kind {kinds} ELSE x.error_kind END",
            "primary_stall_reason_code": "x.error_kind", "next_action_code": "x.error_kind"}
    lk = []
    for k in dict.fromkeys([*labels, *over]):
        own = f"rep.{k}" if k in required or k in enums else f"x.{k}" if k in labels else "CAST(NULL AS VARCHAR)"
        lk.append(f"CASE WHEN x.error_kind IS NOT NULL THEN {over[k]} ELSE {own} END AS {k}" if k in over else f"{own} AS {k}")
    cols = []
    for c in dict.fromkeys(r.output_columns):
        if c == "summary":
            cols.append(f"coalesce(lk.summary, {O.q(P.NO_CONVERSATION_SUMMARY)}) AS summary")
        elif c == "cache_status":
            cols.append("CASE WHEN feat.cleaned_phone IS NULL THEN '' WHEN lk.error_kind IS NULL THEN 'FRESH' ELSE 'ERROR' END AS cache_status")
        elif c in ("lead_id", "name", "cleaned_phone"):
            cols.append(f"CAST(leads.{c} AS VARCHAR) AS {c}")
        elif c in types and types[c].typeName() == "boolean":
            cols.append(f"CASE WHEN feat.{c} THEN 'True' WHEN NOT feat.{c} THEN 'False' ELSE '' END AS {c}")
        elif c in types:
            cols.append(f"coalesce(CAST(feat.{c} AS VARCHAR), '') AS {c}")
        elif c in labels or c in over:
            cols.append(f"coalesce(CAST(lk.{c} AS VARCHAR), '') AS {c}")
        else:
            cols.append(f"'' AS {c}")
    if stamp:
        cols.append(f"{O.q(stamp)} AS last_updated")
    return _with(
        O.messages_cte("said"), O.leads_cte(), _bounds_sql(r), O.ordinal_cte(), O.temporal_agg_sql(), O.metadata_agg_sql(),
        O.handoff_ctes(), O.template_agg_sql(), O.labels_cte(), *used, f"feat AS ({feat})",
        f"x AS (SELECT {x} FROM lab JOIN feat USING (cleaned_phone))",
        "rep AS (" + O.repair_sql("x", required, enums, P.CRITICAL_ENUM_KEYS) + ")",
        f"lk AS (SELECT x.cleaned_phone, x.error_kind, {', '.join(lk)} FROM x JOIN rep USING (cleaned_phone))",
    ) + "SELECT " + ",\n       ".join(cols) + """
FROM leads LEFT JOIN feat ON feat.cleaned_phone = leads.cleaned_phone LEFT JOIN lk ON lk.cleaned_phone = leads.cleaned_phone"""


def _report(recipe: str) -> QueryFn:
    def run(spark, sf_dir):
        return RP.export_prep(recipe_result(spark, sf_dir, recipe), list(get_recipe(recipe).output_columns))

    run.__name__ = f"report_{recipe}"
    run.__doc__ = f"E4: full run and report of the recipe {recipe}."
    return run


for _name in RECIPES:
    if _name != REPORT_RECIPE:
        register(f"report_{_name}", _report_oracle(_name))(_report(_name))


@register("report_frame", _report_oracle(REPORT_RECIPE))
def report_frame(spark, sf_dir):
    """Full recipe run (simulation_to_handoff) and report step: J6 J7 L13 L14
    P14-P17 P20 over all leads; every column as report text."""
    return _report(REPORT_RECIPE)(spark, sf_dir)


@register("publish_frame", _report_oracle(REPORT_RECIPE, PUBLISH_STAMP))
def publish_frame(spark, sf_dir):
    """K8: the report as all-text columns plus a 'last updated' stamp."""
    r = get_recipe(REPORT_RECIPE)
    out = RP.ordered_projection(recipe_result(spark, sf_dir), list(r.output_columns))
    return RP.publish_frame(out, PUBLISH_STAMP)


@register(
    "error_rows",
    _with(O.messages_cte(), O.labels_cte())
    + """SELECT lab.cleaned_phone, lab.error_kind AS error, 'ERROR' AS cache_status FROM lab
WHERE lab.error_kind IS NOT NULL AND lab.cleaned_phone IN (SELECT cleaned_phone FROM msgs)""",
)
def error_rows(spark, sf_dir):
    """K6 + J7: the error side-output of a recipe run."""
    return recipe_errors(get_recipe(REPORT_RECIPE), A.leads_from_customers(spark, sf_dir), _msgs(spark, sf_dir),
                         A.label_rows(spark, sf_dir))


from convolens.plans import queries_more  # noqa: E402, F401  (registers its queries)
