"""Further registered queries: report selection, defaults, masking, names,
feature switches, label errors, cache and completion reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.functions import mask_sensitive, parse_ts_month_first
from convolens.functions import patterns as P
from convolens.operators import features as FT
from convolens.operators import incremental as INC
from convolens.operators import labels as LB
from convolens.operators import report as RP
from convolens.plans import oracle as O
from convolens.plans import queries as Q
from convolens.plans.queries import _with, register
from convolens.sources import adapters as A
from convolens.sources.tables import read_table

# ------------------------------------------------------------------ selection
INCLUDED = ["last_message_sender", "NO_USER_MESSAGES_EXIST", "not_a_column", "name"]


@register(
    "report_selection",
    f"SELECT cleaned_phone, last_message_sender, NO_USER_MESSAGES_EXIST FROM ({Q._snapshot_oracle()})",
)
def report_selection(spark, sf_dir):
    """P1 + P8 + P15: an include list (the key is added, unknown names are
    ignored), then an exclude list (the key stays)."""
    leads = A.leads_from_customers(spark, sf_dir).withColumnRenamed("cleaned_phone", "cleaned_phone_number")
    leads = RP.require_columns(RP.rename_key(leads), ["cleaned_phone", "name"], "lead table")
    out = Q.lead_snapshot_plan(leads, Q._msgs(spark, sf_dir))
    return RP.include_exclude(out, INCLUDED, ["name", "cleaned_phone"])


@register(
    "no_messages_result",
    _with(O.leads_cte()) + f"SELECT *, {O.q(P.NO_CONVERSATION_AVAILABLE)} AS summary FROM leads",
)
def no_messages_result(spark, sf_dir):
    """The short cut of a run without any message."""
    return RP.no_messages_result(A.leads_from_customers(spark, sf_dir))


UNSCORED = {"lead_name": "Unknown", "summary": "No conversation found", "current_stage": "UNKNOWN"}


@register(
    "scored_and_unscored",
    _with(O.leads_cte(), O.labels_cte())
    + f"""SELECT cleaned_phone, summary, CAST(NULL AS VARCHAR) AS lead_name, CAST(NULL AS VARCHAR) AS current_stage FROM lab
UNION ALL SELECT DISTINCT cleaned_phone, {O.q(UNSCORED["summary"])}, {O.q(UNSCORED["lead_name"])}, {O.q(UNSCORED["current_stage"])}
FROM leads WHERE cleaned_phone NOT IN (SELECT cleaned_phone FROM lab)""",
)
def scored_and_unscored(spark, sf_dir):
    """Scored conversations and a default row for every other lead."""
    scored = A.latest_labels(spark, sf_dir).select("cleaned_phone", "summary")
    return RP.scored_and_unscored(scored, A.leads_from_customers(spark, sf_dir), UNSCORED)


@register(
    "masked_leads",
    "SELECT c_custkey, c_mktsegment, '[REDACTED]' AS phone_number, '[REDACTED]' AS user_email FROM customer",
)
def masked_leads(spark, sf_dir):
    """values of columns named after something sensitive are masked."""
    k = F.col("c_custkey")
    return mask_sensitive(read_table(spark, sf_dir, "customer").select(
        k, "c_mktsegment", A.phone_of(k).alias("phone_number"),
        A.synthetic_email(F.col("c_name"), k).alias("user_email"),
    ))


# ------------------------------------------------------------------ names, dates
_NAME = r"nullif(regexp_extract(message, 'Hola \*(.*?)\*!', 1), '')"


@register(
    "lead_names",
    _with(O.messages_cte(), """g AS (
  SELECT cleaned_phone, src_ord, creation_time, msg_from, message FROM msgs
  UNION ALL
  SELECT cleaned_phone, src_ord + 1000000, creation_time, msg_from, 'Hola *' || msg_from || ' ' || src_ord || '*! Buen día'
  FROM msgs WHERE src_ord % 4 = 0
)""", O.ordinal_cte("g"))
    + f"""SELECT cleaned_phone, arg_min({_NAME}, i) FILTER (msg_from = 'bot' AND {_NAME} IS NOT NULL) AS lead_name
FROM om GROUP BY cleaned_phone""",
)
def lead_names(spark, sf_dir):
    """the name in a conversation's first bot greeting that holds one."""
    m = Q._msgs(spark, sf_dir)
    greeting = F.concat(F.lit("Hola *"), F.col("msg_from"), F.lit(" "), F.col("src_ord").cast("string"), F.lit("*! Buen día"))
    more = m.where("src_ord % 4 = 0").withColumns({"message": greeting, "src_ord": (F.col("src_ord") + 1000000).cast("int")})
    return FT.conversation_features(m.unionByName(more), [FT.LeadName()])


@register(
    "sheet_dates",
    """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate END, '%Y-%m-%d %H:%M') AS parsed
FROM orders""",
)
def sheet_dates(spark, sf_dir):
    """lenient month-first dates; what cannot be read is null."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 3 == 0, F.date_format(d, "M/d/yyyy HH:mm")).when(k % 3 == 1, F.date_format(d, "yyyy-MM-dd"))
    parsed = parse_ts_month_first(F.coalesce(raw, F.lit("no date")))
    orders = read_table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm").alias("parsed"))


# ------------------------------------------------------------------ switches
@register(
    "feature_switches",
    _with(O.messages_cte(), O.ordinal_cte(), O.template_agg_sql())
    + f"""SELECT cleaned_phone, CAST(NULL AS VARCHAR) AS HOURS_MINUTES_SINCE_LAST_USER_MESSAGE,
       CAST(NULL AS VARCHAR) AS HOURS_MINUTES_SINCE_LAST_MESSAGE, false AS IS_WITHIN_REACTIVATION_WINDOW,
       false AS IS_RECOVERY_PHASE_ELIGIBLE, CAST(NULL AS VARCHAR) AS LAST_USER_MESSAGE_TIMESTAMP_TZ,
       CAST(NULL AS VARCHAR) AS LAST_MESSAGE_TIMESTAMP_TZ, true AS NO_USER_MESSAGES_EXIST,
       recovery_template_detected, 0 AS consecutive_recovery_templates_count
FROM (SELECT cleaned_phone, {O.template_select()} FROM r_agg)""",
)
def feature_switches(spark, sf_dir):
    """N2 + T8 + R3: a chain cut to two features, each with a part switched off."""
    chain = FT.chain([
        "metadata", ("temporal", {"skip_detailed_temporal": True}), "handoff",
        ("template", {"skip_consecutive_count": True}),
    ])
    kept = FT.select_chain(chain, skip=["handoff", "MessageMetadataProcessor"])
    return FT.conversation_features(Q._msgs(spark, sf_dir), kept)


@register(
    "message_ordinal",
    _with(O.messages_cte())
    + """SELECT cleaned_phone, src_ord, message,
       row_number() OVER (PARTITION BY cleaned_phone ORDER BY creation_time, src_ord, msg_from, message) - 1 AS msg_idx FROM msgs""",
)
def message_ordinal(spark, sf_dir):
    """The dense place of every message in its conversation."""
    return Q.MS.with_ordinal(Q._msgs(spark, sf_dir)).select("cleaned_phone", "src_ord", "message", "msg_idx")


# ------------------------------------------------------------------ labels
def _label_errors_sql() -> str:
    keys = sorted(P.HANDOFF_LABEL_KEYS)
    absent = ", ".join(f"CASE WHEN {k} IS NULL THEN {O.q(k)} END" for k in keys)
    found = [f"'Missing keys: ' || nullif(concat_ws(', ', {absent}), '')"]
    for k, allowed in Q._ENUMS.items():
        text = O.q(f"Invalid value for '{k}': '")
        found.append(f"CASE WHEN {k} IS NOT NULL AND NOT {O.in_list(k, allowed)} THEN {text} || {k} || chr(39) END")
    return f"SELECT cleaned_phone, turn, nullif(concat_ws('; ', {', '.join(found)}), '') AS errors FROM lab"


@register("label_errors", _with(O.labels_cte(per_turn=True)) + _label_errors_sql())
def label_errors(spark, sf_dir):
    """The validation errors of every label row."""
    errors = LB.validation_errors(P.HANDOFF_LABEL_KEYS, Q._ENUMS)
    lab = A.label_rows(spark, sf_dir)
    return lab.select("cleaned_phone", "turn", F.when(F.size(errors) > 0, F.array_join(errors, "; ")).alias("errors"))


@register(
    "response_run",
    _with(O.messages_cte(), O.leads_cte(), *O.parse_ctes(Q.RESPONSE_SHAPES, Q.PARSED_KEYS))
    + f"""SELECT cleaned_phone, CASE WHEN NOT coalesce(known, false) THEN NULL WHEN p.error IS NULL THEN 'FRESH' ELSE 'ERROR' END AS cache_status,
       CASE WHEN p.error = 'ERROR_LLM_NONE' THEN p.error WHEN p.error IS NOT NULL THEN 'ERROR_PROCESSING' END AS error,
       p.error AS error_details,
       CASE WHEN NOT coalesce(known, false) THEN {O.q(P.NO_CONVERSATION_SUMMARY)}
            WHEN p.error = 'ERROR_LLM_NONE' THEN {O.q(LB.ERROR_SUMMARIES["ERROR_LLM_NONE"])}
            WHEN p.error IS NOT NULL THEN {O.q(LB.ERROR_SUMMARIES["ERROR_PROCESSING"])} ELSE p.summary END AS summary
FROM leads LEFT JOIN (SELECT *, true AS known FROM parsed QUALIFY row_number() OVER (PARTITION BY cleaned_phone ORDER BY turn DESC) = 1) p USING (cleaned_phone)""",
)
def response_run(spark, sf_dir):
    """A recipe run from raw model responses: parse failures and missing keys
    become error rows (L1-L7, L14, K6)."""
    out = Q.run_recipe(Q.driver_recipe(Q.REPORT_RECIPE), A.leads_from_customers(spark, sf_dir), Q._msgs(spark, sf_dir),
                       responses=Q.raw_responses(spark, sf_dir))
    return out.select("cleaned_phone", "cache_status", "error", "error_details", "summary")


# ------------------------------------------------------------------ cache, completion
@register(
    "cache_hits",
    _with(*Q._VERSION_CTES) + """SELECT cur.cleaned_phone, cur.conversation_digest, c.payload FROM cur JOIN (
  SELECT * FROM cache WHERE payload IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conversation_digest ORDER BY scored_at DESC, cleaned_phone DESC) = 1
) c USING (cleaned_phone, conversation_digest)""",
)
def cache_hits(spark, sf_dir):
    """The newest cached result of every unchanged conversation."""
    current, old = Q._versions(spark, sf_dir)
    return Q._stored(spark, old).hits(current).select("cleaned_phone", "conversation_digest", "payload")


def _log(spark, sf_dir) -> DataFrame:
    return Q.completion_log(Q._versions(spark, sf_dir)[1])


_LOG_CTE = f"""log AS (SELECT cleaned_phone, 'campaign_' || CAST(conv_id % 3 AS VARCHAR) AS recipe,
       'agent_' || CAST(conv_id % 5 AS VARCHAR) AS completed_by,
       {O.AS_OF} - INTERVAL 2 HOUR - CAST(conv_id % 50 AS INTEGER) * INTERVAL 1 MINUTE AS done_at
  FROM old WHERE conv_id % 2 = 0)"""


@register(
    "recent_completions",
    _with(*Q._VERSION_CTES, _LOG_CTE)
    + """SELECT recipe, cleaned_phone, completed_by, strftime(done_at, '%Y-%m-%d %H:%M:%S') AS completed_at,
       row_number() OVER (PARTITION BY recipe ORDER BY done_at DESC, cleaned_phone DESC) AS place FROM log QUALIFY place <= 3""",
)
def recent_completions(spark, sf_dir):
    """The last three completions of every campaign."""
    at = F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at")
    return INC.recent_completions(_log(spark, sf_dir)).select("recipe", "cleaned_phone", "completed_by", at, "place")


@register(
    "completed_leads",
    _with(*Q._VERSION_CTES, _LOG_CTE) + "SELECT cleaned_phone, completed_by FROM log WHERE recipe = 'campaign_1'",
)
def completed_leads(spark, sf_dir):
    """The completion records of one campaign."""
    return INC.completed_leads(_log(spark, sf_dir), "campaign_1").select("cleaned_phone", "completed_by")


@register(
    "overall_completion",
    _with(*Q._COMPLETION_CTES) + "SELECT count(*) FILTER (status = 'COMPLETED') AS total_completed FROM st",
)
def overall_completion(spark, sf_dir):
    """Completed leads over all campaigns."""
    return INC.overall_completion(Q._completion(spark, sf_dir))
