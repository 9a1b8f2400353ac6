"""DuckDB SQL twins of the registered queries (the driver's correctness oracle).

The oracle is written independently of the Spark plans: it uses a dense
message ordinal (``row_number``) and DuckDB functions (``arg_max``,
``regexp_matches``, ``string_agg ... ORDER BY``), so agreement is evidence,
not an echo.  Only literal values (patterns, texts) are shared.
"""

from __future__ import annotations

from convolens.functions import patterns as P
from convolens.functions.text import strip_accents_py
from convolens.session import AS_OF_DEFAULT
from convolens.sources import adapters as A

AS_OF = f"TIMESTAMP '{AS_OF_DEFAULT}'"
TZ = "America/Mexico_City"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_acc(expr: str) -> str:
    return f"translate({expr}, {q(P.ACCENTED)}, {q(P.UNACCENTED)})"


def contains_any(expr: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(p)})" for p in phrases) + ")"


def regex_any(expr: str, patterns: list[str], ignore_case: bool = False) -> str:
    alt = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({expr}, {q(('(?i)' if ignore_case else '') + alt)})"


def ts_of_seconds(expr: str) -> str:
    return f"make_timestamp(CAST(({expr}) * 1000000 AS BIGINT))"


# ---------------------------------------------------------------- adapters
def messages_cte(name: str = "msgs") -> str:
    """FIXTURES §3.1 adapter (messages from conversations), with conv_id kept:
    every turn, and the trigger sentences as rows of their own."""
    triggers = " UNION ALL ".join(
        [f"SELECT 'bot', 7, {k}, {q(t)}" for k, t in enumerate(
            [A.BOT_INVITE, A.BOT_OFFER, A.BOT_PREVALIDATION, A.BOT_TRANSFER, A.BOT_RECEIVED])]
        + [f"SELECT 'user', 6, {k}, {q(t)}" for k, t in enumerate(
            [A.USER_YES_WANT, A.USER_NO_THANKS, A.USER_NOT_INTERESTED, A.USER_YES])]
    )
    return f"""{name}_triggers(who, modulus, k, sentence) AS ({triggers}),
{name}_turns AS (
  SELECT *, CAST({A.PHONE_BASE} + conv_id AS VARCHAR) AS cleaned_phone,
         {ts_of_seconds(f"{A.EPOCH_BASE} + (conv_id%100)*3600 + turn*(7+conv_id%5)*60")} AS creation_time,
         CASE WHEN role='assistant' THEN 'bot' WHEN role='user' AND conv_id%10<>7 THEN 'user' ELSE 'operator' END AS msg_from
  FROM conversations
),
{name} AS (
  SELECT cleaned_phone, CAST(turn*2 AS INTEGER) AS src_ord, creation_time, msg_from, text AS message, conv_id FROM {name}_turns
  UNION ALL
  SELECT cleaned_phone, CAST(turn*2+1 AS INTEGER), creation_time, msg_from,
         CASE WHEN msg_from='bot' AND conv_id%10=7 AND turn>=3 THEN {q(A.BOT_OFFER)} ELSE sentence END, conv_id
  FROM {name}_turns LEFT JOIN {name}_triggers
    ON who = msg_from AND k = (CASE modulus WHEN 7 THEN conv_id*3+turn ELSE conv_id+turn END) % modulus
  WHERE sentence IS NOT NULL OR (msg_from='bot' AND conv_id%10=7 AND turn>=3)
)"""


def ordinal_cte(src: str = "msgs", name: str = "om", key: str = "cleaned_phone") -> str:
    """Dense 0-based message ordinal per conversation."""
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY creation_time, src_ord) - 1 AS i
  FROM {src}
)"""


def events_cte(name: str = "emsgs") -> str:
    return f"""{name} AS (
  SELECT CAST(user_id AS VARCHAR) AS cleaned_phone, event_id AS src_ord, ts AS creation_time,
         CASE WHEN event_type IN ('click','purchase') THEN 'user'
              WHEN event_type = 'view' THEN 'operator' ELSE 'bot' END AS msg_from,
         event_type AS message
  FROM events
)"""


def leads_cte(name: str = "leads") -> str:
    return f"""{name} AS (
  SELECT c_custkey AS lead_id, c_name AS name, CAST({A.PHONE_BASE} + c_custkey AS VARCHAR) AS cleaned_phone
  FROM customer
)"""


def synthetic_email(name: str, key: str) -> str:
    return (
        f"replace({name}, '#', '.') || CASE WHEN ({key})%2=0 THEN '+o' || CAST(({key})%3 AS VARCHAR) ELSE '' END"
        " || '@Example.com'"
    )


def digest_agg() -> str:
    """Digest of a conversation: sums over its messages' line hashes."""
    line = ("md5(trim(regexp_replace(strftime(creation_time, '%Y-%m-%d %H:%M:%S') || ' ' || msg_from || ': ' || message,"
            " '\\s+', ' ', 'g')))")
    half = lambda at: f"sum(CAST(CAST('0x' || substr({line}, {at}, 15) AS BIGINT) AS HUGEINT))"
    return f"md5(concat_ws(':', count(*), {half(1)}, {half(16)}))"


# ---------------------------------------------------------------- time text
def hm(sec: str) -> str:
    """'{h}h {m}m' from double seconds, truncation toward zero."""
    h = f"CAST(trunc(({sec})/3600.0) AS BIGINT)"
    m = f"CAST(trunc((({sec})/3600.0 - trunc(({sec})/3600.0))*60) AS BIGINT)"
    return f"(CAST({h} AS VARCHAR) || 'h ' || CAST({m} AS VARCHAR) || 'm')"


def secs_since(ts: str) -> str:
    return f"((epoch_us({AS_OF}) - epoch_us({ts})) / 1000000.0)"


def iso_tz(ts: str, tz: str = TZ) -> str:
    local = f"timezone({q(tz)}, ({ts}) AT TIME ZONE 'UTC')"
    off = f"CAST(round(epoch({local}) - epoch({ts})) AS BIGINT)"
    frac = (
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' ELSE '.' || "
        f"lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0') END"
    )
    offtxt = (
        f"CASE WHEN {off} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({off}) // 3600 AS VARCHAR), 2, '0')"
        f" || ':' || lpad(CAST((abs({off}) % 3600) // 60 AS VARCHAR), 2, '0')"
    )
    return f"CASE WHEN ({ts}) IS NULL THEN NULL ELSE strftime({local}, '%Y-%m-%dT%H:%M:%S') || {frac} || {offtxt} END"


def trunc_text(expr: str, n: int | None) -> str:
    if n is None:
        return expr
    return f"CASE WHEN length({expr}) > {n} THEN substring({expr}, 1, {n}) || '...' ELSE {expr} END"


def ts19(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


# ---------------------------------------------------------------- features
def temporal_agg_sql(src: str = "om", key: str = "cleaned_phone", name: str = "t_agg") -> str:
    return f"""{name} AS (
  SELECT {key},
         max(creation_time) AS last_ts,
         max(creation_time) FILTER (WHERE lower(msg_from) = 'user') AS last_user_ts
  FROM {src} GROUP BY {key}
)"""


def temporal_select(a: str = "t_agg") -> str:
    su = secs_since(f"{a}.last_user_ts")
    s = secs_since(f"{a}.last_ts")
    return f"""{hm(su)} AS HOURS_MINUTES_SINCE_LAST_USER_MESSAGE,
       {hm(s)} AS HOURS_MINUTES_SINCE_LAST_MESSAGE,
       coalesce({su}/3600.0 < 24, false) AS IS_WITHIN_REACTIVATION_WINDOW,
       coalesce({su}/3600.0 >= 24, false) AS IS_RECOVERY_PHASE_ELIGIBLE,
       {iso_tz(f"{a}.last_user_ts")} AS LAST_USER_MESSAGE_TIMESTAMP_TZ,
       {iso_tz(f"{a}.last_ts")} AS LAST_MESSAGE_TIMESTAMP_TZ,
       {a}.last_user_ts IS NULL AS NO_USER_MESSAGES_EXIST"""


def metadata_agg_sql(src: str = "om", key: str = "cleaned_phone", name: str = "m_agg") -> str:
    return f"""{name} AS (
  SELECT {key},
         arg_max(lower(msg_from), i) AS sender,
         arg_max(message, i) FILTER (WHERE lower(msg_from) = 'user') AS user_text,
         arg_max(message, i) FILTER (WHERE lower(msg_from) IN ('bot','operator')) AS kuna_text,
         arg_max(creation_time, i) AS last_row_ts
  FROM {src} GROUP BY {key}
)"""


def metadata_select(a: str = "m_agg", n: int | None = None) -> str:
    return f"""CASE WHEN {a}.sender = 'user' THEN 'user' ELSE 'kuna' END AS last_message_sender,
       {trunc_text(f"coalesce({a}.user_text, 'N/A')", n)} AS last_user_message_text,
       {trunc_text(f"coalesce({a}.kuna_text, 'N/A')", n)} AS last_kuna_message_text,
       {ts19(f"{a}.last_row_ts")} AS last_message_ts"""


def template_agg_sql(src: str = "om", name: str = "r_agg") -> str:
    hit = contains_any("lower(message)", P.RECOVERY_TEMPLATE_PHRASES)
    return f"""{name} AS (
  SELECT cleaned_phone,
         arg_max({hit}, i) FILTER (WHERE msg_from = 'bot') AS last_bot_hit,
         max(i) - coalesce(max(i) FILTER (WHERE NOT (msg_from = 'bot' AND {hit})), -1) AS run
  FROM {src} GROUP BY cleaned_phone
)"""


def template_select(a: str = "r_agg") -> str:
    return f"""coalesce({a}.last_bot_hit, false) AS recovery_template_detected,
       CAST({a}.run AS INTEGER) AS consecutive_recovery_templates_count"""


def validation_expr() -> str:
    hit = contains_any(strip_acc("lower(message)"), P.PRE_VALIDATION_PHRASES)
    return f"coalesce(bool_or(msg_from = 'bot' AND {hit}), false)"


def transfer_expr(strict: bool = False) -> str:
    import re as _re

    phrases = [strip_accents_py(p) for p in P.HUMAN_TRANSFER] if strict else P.HUMAN_TRANSFER
    hit = regex_any(strip_acc("message"), [_re.escape(p) for p in phrases], ignore_case=True)
    return f"coalesce(bool_or(msg_from = 'bot' AND {hit}), false)"


def handoff_ctes(src: str = "om", name: str = "h_agg") -> str:
    inv_hit = regex_any(strip_acc("message"), P.HANDOFF_INVITATION, ignore_case=True)
    done = regex_any(strip_acc("lower(message)"), P.HANDOFF_COMPLETION)
    return f"""h_inv AS (
  SELECT cleaned_phone, min(i) FILTER (WHERE msg_from = 'bot' AND {inv_hit}) AS inv
  FROM {src} GROUP BY cleaned_phone
),
{name} AS (
  SELECT o.cleaned_phone, any_value(h.inv) AS inv,
         arg_min(coalesce(o.message, ''), o.i) FILTER (WHERE o.msg_from = 'user' AND o.i > h.inv) AS reply,
         coalesce(bool_or(o.msg_from = 'bot' AND o.i > h.inv AND {done}), false) AS done
  FROM {src} o JOIN h_inv h USING (cleaned_phone)
  GROUP BY o.cleaned_phone
)"""


def handoff_select(a: str = "h_agg") -> str:
    r = strip_acc(f"lower({a}.reply)")
    resp = f"""CASE WHEN {a}.inv IS NULL THEN 'NO_INVITATION'
            WHEN {a}.reply IS NULL THEN 'NO_RESPONSE'
            WHEN {regex_any(r, P.HANDOFF_ACCEPT)} THEN 'STARTED_HANDOFF'
            WHEN {regex_any(r, P.HANDOFF_DECLINE)} THEN 'DECLINED_HANDOFF'
            ELSE 'UNCLEAR_RESPONSE' END"""
    return f"""{a}.inv IS NOT NULL AS handoff_invitation_detected,
       {resp} AS handoff_response,
       ({resp}) = 'STARTED_HANDOFF' AND {a}.done AS handoff_finalized"""


def pick_sql(expr: str, values: list) -> str:
    parts = " ".join(
        f"WHEN {i} THEN {('NULL' if v is None else q(v))}" for i, v in enumerate(values)
    )
    return f"CAST(CASE ({expr}) {parts} END AS VARCHAR)"


def labels_cte(name: str = "lab", per_turn: bool = False) -> str:
    """Twin of ``adapters.label_rows`` (every turn) or ``latest_labels``."""
    newest = "" if per_turn else "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"
    c = "conv_id"
    return f"""{name} AS (
  SELECT CAST({A.PHONE_BASE} + {c} AS VARCHAR) AS cleaned_phone, {c} AS conv_id, turn,
         CASE WHEN {c} % 17 = 5 THEN NULL ELSE 'Resumen: ' || text END AS summary,
         {pick_sql(f"{c} % {len(A.STALL_VARIANTS)}", A.STALL_VARIANTS)} AS primary_stall_reason_code,
         {pick_sql(f"({c} * 7) % {len(A.ACTION_VARIANTS)}", A.ACTION_VARIANTS)} AS next_action_code,
         CASE WHEN {c} % 4 = 0 THEN 'N/A' ELSE 'Pidió hablar con una persona' END AS transfer_context_analysis,
         'Hola, sobre tu mensaje: ' || text AS suggested_message_es,
         {pick_sql(f"{c} % 3", A.STAGE_VARIANTS)} AS inferred_stall_stage,
         {c} % 9 = 4 AS explicit_disinterest,
         {c} % 11 = 5 AS technical_issue,
         {pick_sql(f"{c} % {len(A.CAMPAIGN_VARIANTS)}", A.CAMPAIGN_VARIANTS)} AS campaign_label,
         {pick_sql(f"{c} % {len(A.DOCUMENT_VARIANTS)}", A.DOCUMENT_VARIANTS)} AS documentos_enviados_analisis,
         {pick_sql(f"({c} // 5) % {len(A.VALIDATION_VARIANTS)}", A.VALIDATION_VARIANTS)} AS enviado_a_validacion,
         {pick_sql(f"{c} % {len(A.QUALITY_VARIANTS)}", A.QUALITY_VARIANTS)} AS calidad_atencion_agente,
         {pick_sql(f"({c} // 2) % {len(A.GPS_VARIANTS)}", A.GPS_VARIANTS)} AS gps_instalacion_agendada,
         {pick_sql(f"{c} % {len(A.OBJECTION_VARIANTS)}", A.OBJECTION_VARIANTS)} AS objecion_principal_cliente,
         CASE WHEN {c} % 13 = 6 THEN 'ERROR_PROCESSING' WHEN {c} % 29 = 11 THEN 'ERROR_LLM_NONE'
              WHEN {c} % 31 = 30 THEN 'ERROR_UNEXPECTED' END AS error_kind
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations {newest})
)"""


def recency_cte(src: str = "om", name: str = "rec") -> str:
    return f"""{name} AS (
  SELECT cleaned_phone,
         {secs_since('max(creation_time)')} / 3600.0 AS hours_since_last_message,
         {secs_since("max(creation_time) FILTER (WHERE lower(msg_from) = 'user')")} / 3600.0 AS hours_since_last_user_message
  FROM {src} GROUP BY cleaned_phone
)"""


def in_list(expr: str, values: list[str]) -> str:
    return f"{expr} IN (" + ", ".join(q(v) for v in values) + ")"


def repair_sql(src: str, required: list[str], enums: dict[str, list[str]], critical: list[str]) -> str:
    """L8-L12 as one SELECT over ``src`` (label columns + NO_USER + HOURS)."""
    missing = " OR ".join(f"{k} IS NULL" for k in required)
    invalid = " OR ".join(f"({k} IS NOT NULL AND NOT {in_list(k, v)})" for k, v in enums.items())
    err = f"(({missing}) OR ({invalid}))"
    nu = "coalesce(NO_USER_MESSAGES_EXIST, false)"
    recent = "(starts_with(coalesce(HOURS_MINUTES_SINCE_LAST_MESSAGE, ''), '0h') OR starts_with(coalesce(HOURS_MINUTES_SINCE_LAST_MESSAGE, ''), '1h'))"
    keys = list(dict.fromkeys(list(required) + list(enums)))
    cols = []
    for k in keys:
        rep = f"coalesce({k}, 'N/A')" if k in required else k
        if k in enums:
            s = f"regexp_replace({rep}, '^\\s+|\\s+$', '', 'g')"
            unq = (f"CASE WHEN length({s}) > 0 AND ((starts_with({s}, '''') AND ends_with({s}, '''')) OR "
                   f"(starts_with({s}, '\"') AND ends_with({s}, '\"'))) THEN substring({s}, 2, length({s}) - 2) ELSE {s} END")
            fb = "'N/A'" if k in critical else q(enums[k][0])
            rep = f"CASE WHEN {rep} IS NULL THEN NULL WHEN {in_list(unq, enums[k])} THEN {unq} ELSE {fb} END"
        if k == "primary_stall_reason_code":
            nuv = f"CASE WHEN {k} IS NOT NULL THEN 'NUNCA_RESPONDIO' END"
        elif k == "next_action_code":
            nuv = f"CASE WHEN {k} IS NOT NULL THEN CASE WHEN {recent} THEN 'ESPERAR' ELSE 'LLAMAR_LEAD_NUNCA_RESPONDIO' END END"
        else:
            nuv = k
        v = f"CASE WHEN NOT {err} THEN {k} WHEN {nu} THEN {nuv} ELSE {rep} END"
        if k in critical and k in enums:
            v = f"CASE WHEN {err} AND ({v}) IS NOT NULL AND NOT {in_list(f'({v})', enums[k])} THEN 'N/A' ELSE {v} END"
        cols.append(f"{v} AS {k}")
    cols.append(f"CASE WHEN {err} AND {nu} THEN 'PRE_VALIDACION' ELSE inferred_stall_stage END AS inferred_stall_stage")
    cols.append(f"{err} AS had_errors")
    return f"SELECT cleaned_phone, " + ",\n       ".join(cols) + f"\nFROM {src}"


def parse_ctes(shapes: list, keys: list[str]) -> list[str]:
    """L1-L7 over one raw response per turn (``rid``), line by line: the lines
    are rows, a window finds the key a line stands under, and every scalar of a
    value (list items and nested values too) is a row of its own."""
    from convolens.operators import labels as LB

    def re_(pattern: str) -> str:
        return q(pattern.replace("(?md)", "(?m)").replace("(?d)", ""))

    def sub(expr: str, pattern: str, by: str) -> str:
        return f"regexp_replace({expr}, {re_(pattern)}, {q(by)}, 'g')"

    def trim_(expr: str) -> str:
        return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"

    quotes = lambda e: sub(e, LB.INNER_QUOTE_LINE, "\\1'\\2'\\3")
    fences = f"regexp_replace(regexp_replace(raw, {q(LB.OPEN_FENCE)}, ''), '```$', '')"
    colons = sub(quotes(trim_(fences)), LB.COLON_VALUE_LINE, '\\1"\\2"\\4')
    later = quotes(sub(sub("t", LB.DOUBLED_SUMMARY, 'summary: "\\2"'), LB.LOOSE_KEY, "\\1: \\2"))
    # the terminator key cuts what an escaped newline sets off behind it
    key, mark = q(LB.TERMINATOR_KEY), q(LB.ESCAPED_NEWLINE + LB.TERMINATOR_KEY)
    behind = (f"CASE WHEN contains(u, {mark}) THEN string_split(u, {mark})[-1] WHEN contains(u, {key}) "
              f"THEN substr(u, instr(u, {key}) + {len(LB.TERMINATOR_KEY)}) ELSE '' END")
    cut = f"replace(substr(u, 1, length(u) - length(behind)) || string_split(behind, {q(LB.ESCAPED_NEWLINE)})[1], {q(LB.ESCAPED_TAB)}, '  ')"
    start = lambda pattern: f"CASE WHEN regexp_matches(x, {re_(pattern)}) THEN chr(1) ELSE '' END || {trim_('x')}"
    parts = lambda pattern: (
        f"list_transform(string_split(array_to_string(list_transform(lines, lambda x: {start(pattern)}), ' '), chr(1))[2:], lambda y: {trim_('y')})"
    )
    plain = "regexp_replace(text, '\\s#.*$', '', 'g')"
    single = "length(text) > 1 AND starts_with(text, chr(39)) AND ends_with(text, chr(39))"
    double = "length(text) > 1 AND starts_with(text, '\"') AND ends_with(text, '\"')"
    inner = "substr(text, 2, length(text) - 2)"
    slash = "chr(92)"
    read = f"replace(replace(replace(replace(x, {slash} || 'n', chr(10)), {slash} || 't', chr(9)), {slash} || chr(34), chr(34)), {slash} || '/', '/')"
    halves = f"string_split({inner}, {slash} || {slash})"
    strange = f"""regexp_matches(x, '\\\\(?:[^nt"/]|$)') OR contains(replace(x, {slash} || chr(34), ''), chr(34))"""
    wanted = "[" + ", ".join(q(k) for k in keys) + "]"
    missing = f"list_sort(list_filter({wanted}, lambda x: NOT list_contains(list(w.k), x)))"
    return [
        f"""raws AS (
  SELECT row_number() OVER () AS rid, conv_id, turn,
         replace({pick_sql(f"(conv_id + turn) % {len(shapes)}", shapes)}, '{{text}}', coalesce(text, '')) AS raw
  FROM conversations
)""",
        f"""moved AS (
  SELECT rid, string_agg(CASE WHEN under AND NOT is_key AND regexp_matches(line, '^\\S') THEN '  ' || line ELSE line END,
                         chr(10) ORDER BY n) AS t
  FROM (SELECT *, regexp_matches(line, {re_(LB.KEY_LINE)}) AS is_key,
               bool_or(regexp_matches(line, {re_(LB.KEY_LINE)})) OVER (PARTITION BY rid ORDER BY n) AS under
        FROM (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS n
              FROM (SELECT rid, string_split({colons}, chr(10)) AS lines FROM raws)))
  GROUP BY rid
)""",
        f"""cleans AS (
  SELECT rid, {trim_(f"CASE WHEN contains(c, 'transfer_context_analysis') THEN c ELSE rtrim(c, ' ' || chr(10) || chr(13) || chr(9)) || chr(10) || {q(P.TRANSFER_DEFAULT_LINE)} END")} AS cleaned
  FROM (SELECT rid, {cut} AS c FROM (SELECT *, {behind} AS behind FROM (SELECT rid, {later} AS u FROM moved WHERE t IS NOT NULL)))
)""",
        f"""split AS (
  SELECT *, count(*) FILTER (WHERE is_top) OVER (PARTITION BY rid ORDER BY n) AS entry
  FROM (SELECT *, regexp_matches(line, {re_(LB.TOP_KEY)}) AS is_top
        FROM (SELECT rid, unnest(string_split(cleaned, chr(10))) AS line,
                     generate_subscripts(string_split(cleaned, chr(10)), 1) AS n FROM cleans))
)""",
        f"""entries AS (
  SELECT rid, entry, max(regexp_extract(line, {re_(LB.TOP_KEY)}, 1)) FILTER (WHERE is_top) AS k,
         {trim_(f"max(regexp_extract(line, {re_(LB.TOP_KEY)}, 2)) FILTER (WHERE is_top)")} AS head,
         coalesce(list(line ORDER BY n) FILTER (WHERE NOT is_top), []) AS rest,
         entry = max(entry) OVER (PARTITION BY rid) AS final
  FROM split WHERE entry > 0 GROUP BY rid, entry
)""",
        f"""kinds AS (
  SELECT *, CASE WHEN regexp_matches(head, {re_(LB.BLOCK_SCALAR)}) THEN 'block'
                 WHEN head = '' AND regexp_matches(lines[1], {re_(LB.LIST_LINE)}) THEN 'list'
                 WHEN head = '' AND regexp_matches(lines[1], {re_(LB.NESTED_KEY)}) THEN 'map'
                 WHEN regexp_matches(head, '^\\[.*\\]$') AND len(lines) = 0 THEN 'flow'
                 WHEN regexp_matches(head, '^\\{{.*\\}}$') AND len(lines) = 0 THEN 'as is' ELSE 'scalar' END AS kind
  FROM (SELECT *, list_filter(rest, lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*#')) AS lines FROM entries)
)""",
        f"""body AS (
  SELECT rid, entry, n, line, lag(line) OVER (PARTITION BY rid, entry ORDER BY n) AS prev
  FROM (SELECT rid, entry, unnest(cut) AS line, generate_subscripts(cut, 1) AS n
        FROM (SELECT rid, entry, list_transform(rest, lambda x: CASE WHEN regexp_matches(x, '\\S') THEN substr(x, indent + 1) ELSE '' END) AS cut
              FROM (SELECT *, length(regexp_extract(list_filter(rest, lambda x: regexp_matches(x, '\\S'))[1], '^( *)', 1)) AS indent
                    FROM kinds WHERE kind = 'block')))
)""",
        """blocks AS (
  SELECT rid, entry, CASE WHEN regexp_matches(head, '^[|>]-') OR bare = '' THEN bare
                          WHEN final AND NOT ends_with(whole, chr(10)) THEN whole
                          WHEN regexp_matches(head, '^[|>][+]') THEN whole || CASE WHEN final THEN '' ELSE chr(10) END ELSE bare || chr(10) END AS v
  FROM (SELECT *, rtrim(whole, chr(10)) AS bare FROM (
    SELECT k.rid, k.entry, any_value(head) AS head, any_value(final) AS final, coalesce(CASE WHEN starts_with(any_value(head), '|') THEN string_agg(line, chr(10) ORDER BY n)
             ELSE string_agg(CASE WHEN line = '' THEN chr(10) WHEN n = 1 OR prev = '' THEN line
                                  WHEN starts_with(line, ' ') OR starts_with(prev, ' ') THEN chr(10) || line ELSE ' ' || line END, '' ORDER BY n) END, '') AS whole
    FROM kinds k LEFT JOIN body b ON b.rid = k.rid AND b.entry = k.entry WHERE kind = 'block' GROUP BY k.rid, k.entry))
)""",
        f"""texts AS (
  SELECT rid, entry, kind, unnest(ts) AS part, generate_subscripts(ts, 1) AS n FROM (
    SELECT rid, entry, kind, CASE kind WHEN 'list' THEN {parts(LB.LIST_LINE)} WHEN 'map' THEN {parts(LB.NESTED_KEY)}
             WHEN 'flow' THEN CASE WHEN trim(substr(head, 2, length(head) - 2)) = '' THEN [] ELSE string_split(substr(head, 2, length(head) - 2), ',') END
             ELSE [array_to_string(list_transform(list_concat([head], lines), lambda x: {trim_('x')}), ' ')] END AS ts
    FROM kinds WHERE kind NOT IN ('block', 'as is'))
)""",
        f"""scalars AS (
  SELECT *, CASE WHEN {single} THEN replace({inner}, chr(39) || chr(39), chr(39))
                 WHEN {double} THEN array_to_string(list_transform({halves}, lambda x: {read}), {slash})
                 WHEN {in_list(plain, LB.NULL_WORDS)} OR starts_with(text, '#') THEN NULL
                 WHEN {in_list(plain, LB.TRUE_WORDS)} THEN 'True' WHEN {in_list(plain, LB.FALSE_WORDS)} THEN 'False'
                 ELSE {trim_(plain)} END AS v,
         CASE WHEN {single} THEN NOT contains(replace({inner}, chr(39) || chr(39), ''), chr(39))
              WHEN {double} THEN len(list_filter({halves}, lambda x: {strange})) = 0
              ELSE NOT (starts_with(text, chr(39)) OR starts_with(text, '"') OR regexp_matches(text, {re_(LB.NO_PLAIN_START)})
                        OR contains({plain}, ': ') OR ends_with({plain}, ':')) END AS ok
  FROM (SELECT rid, entry, kind, n, regexp_extract(part, {re_(LB.LOOSE_ENTRY)}, 1) AS name,
               CASE kind WHEN 'list' THEN regexp_replace(part, '^-\\s*', '') WHEN 'map' THEN regexp_extract(part, {re_(LB.LOOSE_ENTRY)}, 2)
                         ELSE {trim_('part')} END AS text FROM texts)
)""",
        """printed AS (
  SELECT *, CASE WHEN v IS NULL THEN 'None'
                 WHEN NOT regexp_matches(text, '^[''"]') AND (v IN ('True', 'False') OR regexp_matches(v, '^[-+]?\\d+(?:\\.\\d+)?$')) THEN v
                 WHEN contains(v, chr(39)) AND NOT contains(v, '"') THEN '"' || v || '"'
                 ELSE chr(39) || replace(v, chr(39), chr(92) || chr(39)) || chr(39) END AS shown
  FROM scalars
)""",
        """strict AS (
  SELECT k.rid, k.entry, k.k, CASE k.kind WHEN 'block' THEN any_value(b.v) WHEN 'as is' THEN any_value(k.head)
           WHEN 'map' THEN '{' || string_agg(chr(39) || name || chr(39) || ': ' || shown, ', ' ORDER BY n) || '}'
           WHEN 'scalar' THEN any_value(p.v) ELSE '[' || coalesce(string_agg(shown, ', ' ORDER BY n), '') || ']' END AS v,
         k.kind <> 'scalar' OR bool_and(p.ok) AS ok
  FROM kinds k LEFT JOIN blocks b ON b.rid = k.rid AND b.entry = k.entry LEFT JOIN printed p ON p.rid = k.rid AND p.entry = k.entry
  GROUP BY k.rid, k.entry, k.k, k.kind
)""",
        f"""broken AS (
  SELECT rid FROM split WHERE entry = 0 AND NOT regexp_matches(line, {re_(LB.PRELUDE)})
  UNION SELECT rid FROM strict WHERE NOT ok
  UNION SELECT rid FROM cleans WHERE rid NOT IN (SELECT rid FROM entries)
)""",
        f"""vals AS (
  SELECT rid, k, arg_max(struct_pack(x := v), place).x AS v FROM (
    SELECT rid, entry AS place, k, v FROM strict WHERE rid NOT IN (SELECT rid FROM broken)
    UNION ALL
    SELECT rid, n, regexp_extract(line, {re_(LB.LOOSE_ENTRY)}, 1), coalesce(nullif({trim_(f"regexp_extract(line, {re_(LB.LOOSE_ENTRY)}, 2)")}, ''), 'N/A')
    FROM split WHERE rid IN (SELECT rid FROM broken) AND regexp_matches(line, {re_(LB.LOOSE_ENTRY)})
  ) GROUP BY rid, k
)""",
        f"""parsed AS (
  SELECT CAST({A.PHONE_BASE} + any_value(r.conv_id) AS VARCHAR) AS cleaned_phone, any_value(r.turn) AS turn, any_value(c.cleaned) AS cleaned,
         CASE WHEN any_value(r.raw) IS NULL THEN 'ERROR_LLM_NONE' WHEN count(w.k) = 0 THEN 'Expected a mapping'
              WHEN len({missing}) > 0 THEN 'Missing keys: ' || list_aggregate({missing}, 'string_agg', ', ') END AS error,
         CASE WHEN count(w.k) > 0 THEN coalesce(list_aggregate({missing}, 'string_agg', ','), '') END AS missing_keys,
         {", ".join(f"max(w.v) FILTER (w.k = {q(k)}) AS {k}" for k in keys)}
  FROM raws r LEFT JOIN cleans c USING (rid) LEFT JOIN vals w USING (rid)
  GROUP BY r.rid
)""",
    ]
