"""Recipes (E4, S8): a typed description that composes the operators into one
lazy plan, plus schema functions derived from it (N2-N5, P23).

A recipe is validated when it is built (unknown processor, unknown parameter,
wrong schema version, several lead sources are errors before any job runs).
``run_recipe`` returns a single DataFrame whose plan Catalyst optimises as a
whole: time bounds and the target semi-join are pushed to the message scan,
unused feature aggregates are pruned by the projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolens.functions import patterns as P
from convolens.operators import features as FT
from convolens.operators import labels as LB
from convolens.operators import messages as MS
from convolens.operators import report as RP
from convolens.operators.segments import cuts_of
from convolens.session import AS_OF_DEFAULT

SCHEMA_VERSION = 2
LEAD_SOURCES = ("redshift", "bigquery", "csv")
# Lead columns the report may use without a producer (P23 whitelist).
LEAD_COLUMNS = (
    "lead_id", "user_id", "clean_email", "email", "lead_created_at", "name", "last_name", "cleaned_phone",
    "agente", "asset_id", "nombre", "correo", "HOY_ES", "cache_status",
)


@dataclass(frozen=True)
class LabelKey:
    """One expected model-label key: type, optional enum, optional flag."""

    name: str
    type: str = "str"
    enum: tuple[str, ...] = ()
    optional: bool = False

    def __post_init__(self):
        if self.type not in ("str", "int", "float", "bool", "list", "dict"):
            raise ValueError(f"label {self.name}: unknown type {self.type!r}")


@dataclass(frozen=True)
class Recipe:
    """Inputs, message bounds, processors, label keys and report columns."""

    name: str
    lead_source: str = "csv"
    lead_sql: str | None = None
    lead_path: str | None = None
    message_start: str | None = None
    message_end: str | None = None
    lookback_days: int | None = None
    phase_start_pattern: str | None = None
    processors: tuple[tuple[str, tuple], ...] = ()
    label_keys: tuple[LabelKey, ...] = ()
    output_columns: tuple[str, ...] = ()
    include_columns: tuple[str, ...] = ()
    exclude_columns: tuple[str, ...] = ()
    export_formats: tuple[str, ...] = ("csv",)
    version: str = "1"
    schema_version: int = SCHEMA_VERSION
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        if self.schema_version != SCHEMA_VERSION:
            raise ValueError(f"recipe {self.name}: schema version must be {SCHEMA_VERSION}")
        if self.lead_source not in LEAD_SOURCES:
            raise ValueError(f"recipe {self.name}: lead source must be one of {LEAD_SOURCES}")
        if self.lead_source == "csv" and self.lead_sql:
            raise ValueError(f"recipe {self.name}: a csv lead source takes no SQL")
        self.features()  # unknown processors / parameters fail here

    # N1-N3 -------------------------------------------------------------------
    def features(self, skip: list[str] | None = None, only: list[str] | None = None) -> list[FT.Feature]:
        specs = [FT.make_feature(n, dict(p)) for n, p in self.processors]
        return FT.select_chain(specs, skip, only)

    @property
    def required_keys(self) -> list[str]:
        return [k.name for k in self.label_keys if not k.optional]

    @property
    def enums(self) -> dict[str, list[str]]:
        return {k.name: list(k.enum) for k in self.label_keys if k.enum}

    # N4/N5 -------------------------------------------------------------------
    def result_columns(self, lead_columns: list[str] | None = None) -> list[str]:
        """Leads + labels + processor columns, first occurrence kept."""
        cols = list(lead_columns or [])
        cols += [k.name for k in self.label_keys]
        cols += [n for n, _ in FT.feature_columns(self.features())]
        cols += ["conversation_digest", "cache_status", "last_message_ts"]
        return list(dict.fromkeys(cols))

    def columns_for(self, enabled: list[str] | None = None, disabled: list[str] | None = None) -> tuple[list[str], list[str]]:
        """Columns to include / exclude from the enabled / disabled processors."""
        inc, exc = [], []
        for f in self.features():
            names = [n for n, _ in f.columns]
            if enabled and (f.name in enabled or f.alias in enabled):
                inc += names
            if disabled and (f.name in disabled or f.alias in disabled):
                exc += names
        return inc, exc

    def result_schema(self) -> T.StructType:
        fields = {n: t for n, t in FT.feature_columns(self.features())}
        out = [T.StructField(c, fields.get(c, T.StringType()), True) for c in self.result_columns()]
        return T.StructType(out)

    def lint(self) -> list[str]:
        """Output columns that nothing produces."""
        producible = set(self.result_columns(list(LEAD_COLUMNS)))
        return [c for c in self.output_columns if c not in producible]


def _keys(*names, enums: dict | None = None, optional=()) -> tuple[LabelKey, ...]:
    enums = enums or {}
    return tuple(LabelKey(n, enum=tuple(enums.get(n, ())), optional=n in optional) for n in names)


# --- FIXED VALUES: the six recipes ------------------------------------------
_CHAIN_TMHRVCX = (
    ("TemporalProcessor", (("timezone", "America/Mexico_City"),)),
    ("MessageMetadataProcessor", (("max_message_length", 150),)),
    ("HandoffProcessor", ()),
    ("TemplateDetectionProcessor", (("template_type", "recovery"),)),
    ("ValidationProcessor", ()),
    ("ConversationStateProcessor", ()),
    ("HumanTransferProcessor", ()),
)
_CHAIN_TMHXRVC = (
    ("TemporalProcessor", (("timezone", "America/Mexico_City"),)),
    ("MessageMetadataProcessor", (("max_message_length", 150),)),
    ("HandoffProcessor", ()),
    ("HumanTransferProcessor", ()),
    ("TemplateDetectionProcessor", (("template_type", "recovery"),)),
    ("ValidationProcessor", ()),
    ("ConversationStateProcessor", ()),
)
_LIVE_ACTIONS = P.NEXT_ACTIONS + ["LLAMAR_LEAD_NUNCA_RESPONDIO", "PROGRAMAR_RECONTACTO_ESPECIAL"]
_ENGAGEMENT = [
    "IGNORED_INITIAL_CONTACT", "EXPLICIT_DISINTEREST", "TECHNICAL_ISSUE_REPORTED", "KUNA_PENDING_RESPONSE",
    "STALLED_AFTER_RESPONSE", "USER_PENDING_RESPONSE", "ENGAGED_ACTIVE_CONVO", "N/A",
]
_ENGAGEMENT_ACTIONS = [
    "LLAMAR_LEAD_NUNCA_RESPONDIO", "CERRAR_CASO", "ESCALAR_CASO_A_HUMANO", "RESPONDER_AL_CLIENTE",
    "MONITOREAR_CONVERSACION", "PROGRAMAR_RECONTACTO_AUTOMATICO", "PROGRAMAR_RECONTACTO_ESPECIAL",
    "REVISAR_MANUALMENTE",
]
_FORMALIZATION_ENUMS = {
    "documentos_enviados_analisis": [
        "Documentos completos", "Faltan: factura", "Faltan: tenencias", "Faltan: tarjeta circulacion",
        "Faltan: INE", "Faltan: comprobantes ingresos", "Faltan: varios documentos",
    ],
    "enviado_a_validacion": ["Sí", "No"],
    "calidad_atencion_agente": ["Excelente", "Buena", "Regular", "Mala"],
    "objecion_principal_cliente": [
        "Sin objeciones", "Logística GPS", "Documentos faltantes", "Preocupación financiera",
        "Desconfianza proceso", "Disponibilidad tiempo", "Problemas técnicos",
    ],
    "gps_instalacion_agendada": ["GPS agendado", "GPS completado", "GPS no agendado", "GPS pendiente"],
}
_HANDOFF_OUT = (
    "NO_USER_MESSAGES_EXIST", "summary", "primary_stall_reason_code", "next_action_code", "suggested_message_es",
    "HOURS_MINUTES_SINCE_LAST_USER_MESSAGE", "HOURS_MINUTES_SINCE_LAST_MESSAGE", "human_transfer",
    "transfer_context_analysis", "handoff_invitation_detected", "handoff_response", "handoff_finalized",
    "IS_WITHIN_REACTIVATION_WINDOW", "IS_RECOVERY_PHASE_ELIGIBLE", "last_user_message_text",
    "last_kuna_message_text", "last_message_sender",
)

RECIPES: dict[str, Recipe] = {
    "simulation_to_handoff": Recipe(
        name="simulation_to_handoff", version="v17", lead_source="redshift",
        lead_sql="lead_contact", lookback_days=90,
        processors=_CHAIN_TMHRVCX,
        label_keys=_keys("summary", "primary_stall_reason_code", "transfer_context_analysis", "next_action_code",
                         "suggested_message_es", "conversation_digest", "last_message_ts",
                         enums={"primary_stall_reason_code": P.STALL_REASONS, "next_action_code": P.NEXT_ACTIONS},
                         optional=("conversation_digest", "last_message_ts")),
        output_columns=("lead_id", "user_id", "clean_email", "lead_created_at", "name", "last_name", "cleaned_phone")
        + _HANDOFF_OUT,
    ),
    "marzo_cohorts": Recipe(
        name="marzo_cohorts", version="v17", message_end="2025-06-09 23:59:59",
        processors=_CHAIN_TMHRVCX,
        label_keys=_keys("summary", "primary_stall_reason_code", "transfer_context_analysis", "next_action_code",
                         "suggested_message_es", "conversation_digest", "last_message_ts",
                         enums={"primary_stall_reason_code": P.STALL_REASONS, "next_action_code": P.NEXT_ACTIONS},
                         optional=("conversation_digest", "last_message_ts")),
        output_columns=("cleaned_phone",) + _HANDOFF_OUT,
    ),
    "marzo_cohorts_live": Recipe(
        name="marzo_cohorts_live", version="v17", message_start="2025-05-08 00:00:00",
        processors=_CHAIN_TMHRVCX,
        label_keys=_keys("summary", "primary_stall_reason_code", "primary_stall_reason_reason_code",
                         "transfer_context_analysis", "next_action_code", "suggested_message_es",
                         "conversation_digest", "last_message_ts", "follow_up_attempts", "next_action_context",
                         "current_engagement_status",
                         enums={"primary_stall_reason_code": P.STALL_REASONS, "next_action_code": _LIVE_ACTIONS},
                         optional=("primary_stall_reason_reason_code", "suggested_message_es", "conversation_digest",
                                   "last_message_ts", "follow_up_attempts", "next_action_context",
                                   "current_engagement_status")),
        output_columns=("lead_id", "user_id", "lead_created_at", "name", "last_name", "cleaned_phone") + _HANDOFF_OUT,
    ),
    "fede_abril_preperfilamiento": Recipe(
        name="fede_abril_preperfilamiento", version="v17", message_start="2025-04-27 00:00:00",
        processors=_CHAIN_TMHXRVC,
        label_keys=_keys("summary", "current_engagement_status", "primary_stall_reason_code",
                         "transfer_context_analysis", "next_action_code", "follow_up_attempts", "next_action_context",
                         enums={"current_engagement_status": _ENGAGEMENT,
                                "primary_stall_reason_code": P.STALL_REASONS,
                                "next_action_code": _ENGAGEMENT_ACTIONS}),
        output_columns=(
            "cleaned_phone", "name", "email", "HOY_ES", "HOURS_MINUTES_SINCE_LAST_USER_MESSAGE",
            "HOURS_MINUTES_SINCE_LAST_MESSAGE", "NO_USER_MESSAGES_EXIST", "human_transfer", "last_message_sender",
            "summary", "current_engagement_status", "primary_stall_reason_code", "transfer_context_analysis",
            "next_action_code", "follow_up_attempts", "next_action_context", "handoff_invitation_detected",
            "handoff_response", "handoff_finalized", "last_user_message_text", "last_kuna_message_text",
            "last_user_message_text", "last_kuna_message_text", "last_message_sender",
        ),
    ),
    "top_up_may": Recipe(
        name="top_up_may", version="1.0", message_start="2025-04-27 00:00:00",
        processors=(("MessageMetadataProcessor", (("max_message_length", 150),)),),
        label_keys=_keys("lead_name", "summary", "current_engagement_status", "follow_up_attempts",
                         "next_action_code", "next_action_context", "suggested_message_es",
                         "transfer_context_analysis"),
        output_columns=(
            "cleaned_phone", "lead_name", "cache_status", "summary", "current_engagement_status",
            "follow_up_attempts", "last_message_sender", "last_user_message_text", "last_kuna_message_text",
            "next_action_code", "next_action_context", "suggested_message_es", "transfer_context_analysis",
        ),
    ),
    "formalizacion": Recipe(
        name="formalizacion", version="v4", lookback_days=90, phase_start_pattern=P.PHASE_START,
        processors=(
            ("TemporalProcessor", (("timezone", "America/Mexico_City"),)),
            ("MessageMetadataProcessor", (("max_message_length", 150),)),
        ),
        label_keys=_keys("resumen_general", *_FORMALIZATION_ENUMS, "conversation_digest", "last_message_ts",
                         enums=_FORMALIZATION_ENUMS, optional=("conversation_digest", "last_message_ts")),
        output_columns=tuple(P.CURATED_COLUMNS) + (
            "HOURS_MINUTES_SINCE_LAST_USER_MESSAGE", "HOURS_MINUTES_SINCE_LAST_MESSAGE", "NO_USER_MESSAGES_EXIST",
            "last_user_message_text", "last_kuna_message_text", "last_message_sender",
        ),
    ),
}
# --- END FIXED VALUES ---------------------------------------------------------


def get_recipe(name: str) -> Recipe:
    if name not in RECIPES:
        raise KeyError(f"unknown recipe {name!r}; known: {sorted(RECIPES)}")
    return RECIPES[name]


def bounded_messages(recipe: Recipe, messages: DataFrame, as_of: str = AS_OF_DEFAULT) -> DataFrame:
    """P11/P12 + P1/P2/P7: the messages in the recipe's time bounds, with the
    same key rules as the leads."""
    m = MS.time_bounds(messages, start=recipe.message_start, end=recipe.message_end,
                       as_of=as_of if recipe.lookback_days else None, lookback_days=recipe.lookback_days)
    return RP.normalise_keys(m)


def recipe_messages(recipe: Recipe, messages: DataFrame, leads: DataFrame, as_of: str = AS_OF_DEFAULT) -> DataFrame:
    """S2/S3 + J2 + J5 for a recipe: bounded messages, targeted, phase-cut."""
    m = MS.for_targets(bounded_messages(recipe, messages, as_of), leads)
    if recipe.phase_start_pattern:
        is_start = F.lower(F.coalesce(F.col("message"), F.lit(""))).contains(recipe.phase_start_pattern)
        m = MS.from_phase_start(m, is_start).drop("phase_start")
    return m


def recipe_labels(recipe: Recipe, labels: DataFrame | None, responses: DataFrame | None) -> DataFrame | None:
    """The label table of a run: given label columns, or raw responses parsed
    here (L1-L7).  Every label key of the recipe is a column; one that the
    table lacks is null, so that L8/L10 see it as missing.  One row per key is
    left, the newest (``one_per_key``): a lead has one result, also when several
    rows' phones normalise to its key."""
    if responses is not None:
        held = ["cleaned_phone", "raw_response", *RP.NEWEST]
        rows = RP.normalise_keys(responses)
        newest = RP.one_per_key(rows.select(*[c for c in held if c in rows.columns]))
        parsed = LB.parse_labels(newest, required=recipe.required_keys)
        return LB.label_columns(parsed, [k.name for k in recipe.label_keys])
    if labels is None:
        return None
    lab = RP.one_per_key(RP.normalise_keys(labels))
    wanted = [k.name for k in recipe.label_keys]
    extra = [c for c in ("inferred_stall_stage", "error_kind", "error_details") if c in lab.columns and c not in wanted]
    return lab.select(
        "cleaned_phone",
        *[F.col(c) if c in lab.columns else F.lit(None).cast("string").alias(c) for c in wanted],
        *extra,
    )


def run_recipe(
    recipe: Recipe,
    leads: DataFrame,
    messages: DataFrame,
    labels: DataFrame | None = None,
    as_of: str = AS_OF_DEFAULT,
    skip: list[str] | None = None,
    only: list[str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """One lazy plan: leads -> bounded messages -> one feature fold (with the
    digest) -> labels joined once and repaired on that row -> merge onto leads
    -> column selection and back-fill.

    Labels come as a table of label columns (``labels``) or as raw model
    responses (``responses``: key, ``raw_response``).  ``error`` and
    ``error_details`` say why a row has no usable label; ``cache_status`` is
    ERROR for these and FRESH for the other conversations."""
    leads = RP.normalise_lead_keys(leads)
    msgs = recipe_messages(recipe, messages, leads, as_of)
    specs = [*recipe.features(skip, only), FT.make_feature("digest")]
    cuts = None
    if any(f.anchors(FT.Msg()) for f in specs):  # looked for before the targets are met: a scan of the key column
        cuts = cuts_of(bounded_messages(recipe, messages, as_of))
    results = FT.conversation_features(msgs, specs, as_of=as_of, cuts=cuts)
    nothing = F.lit(None).cast("string")
    lab = recipe_labels(recipe, labels, responses)
    if lab is None:
        results = results.withColumns({"error": nothing, "error_details": nothing})
    else:
        # Feature columns win over label columns of the same name
        features = [c for c in results.columns if c != "cleaned_phone"]
        lab = lab.drop(*[c for c in features if c in lab.columns])
        results = results.join(lab.withColumn("__labelled", F.lit(True)), "cleaned_phone", "left")
        flags = [c for c in ("NO_USER_MESSAGES_EXIST", "HOURS_MINUTES_SINCE_LAST_MESSAGE") if c not in results.columns]
        absent = {c: F.lit(None).cast("boolean" if c.startswith("NO_") else "string") for c in flags}
        for c in ("inferred_stall_stage", "error_kind", "error_details"):
            if c not in results.columns:
                absent[c] = nothing
        results = results.withColumns(absent) if absent else results
        required = [k for k in recipe.required_keys if k not in features]
        enums = {k: v for k, v in recipe.enums.items() if k not in features}
        raw = results.columns
        repaired = LB.apply_error_kinds(LB.repair_labels(results, required, enums))
        # a conversation without a label row stays without labels
        keep = F.coalesce(F.col("__labelled"), F.lit(False))
        label_cols = [c for c in repaired.columns if c not in ("cleaned_phone", "__labelled", "had_errors", *features, *flags)]
        results = repaired.select(
            "cleaned_phone",
            *[c for c in raw if c in features],
            *[F.when(keep, F.col(c)).alias(c) for c in label_cols if c != "error_kind"],
            F.col("error_kind").alias("error"),
        )
    status = F.when(F.col("error").isNotNull(), F.lit("ERROR")).otherwise(F.lit("FRESH"))
    results = results.withColumn("cache_status", status)
    out = RP.merge_results(leads, results, as_of=as_of)
    out = RP.include_exclude(out, include or list(recipe.include_columns), exclude or list(recipe.exclude_columns))
    return RP.backfill_columns(out, list(recipe.output_columns))


def recipe_errors(
    recipe: Recipe, leads: DataFrame, messages: DataFrame, labels: DataFrame | None = None,
    responses: DataFrame | None = None, as_of: str = AS_OF_DEFAULT,
) -> DataFrame:
    """K6 + J7: the error side-output alone: labels that failed, for leads with
    messages in the recipe's bounds; neither features nor digest are computed."""
    msgs = recipe_messages(recipe, messages, RP.normalise_lead_keys(leads), as_of)
    lab = recipe_labels(recipe, labels, responses)
    kind = F.col("error_kind") if "error_kind" in lab.columns else F.lit(None).cast("string")
    failed = lab.select("cleaned_phone", kind.alias("error")).where(F.col("error").isNotNull())
    return RP.error_rows(failed.join(msgs.select("cleaned_phone"), "cleaned_phone", "left_semi"))
