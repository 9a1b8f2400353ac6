"""Fixed values that must equal the reference's for equal results.

FIXED VALUES — phrase lists, regular expressions and code tables, written out
plainly in their natural order.  Matching rules (lower-casing, accent
stripping, case-insensitivity) are applied by the detectors, not here.
"""

# --- FIXED VALUES -----------------------------------------------------------

# Accent map used before phrase matching: precomposed characters only.
ACCENTED = "áéíóúÁÉÍÓÚüÜñÑ"
UNACCENTED = "aeiouAEIOUuUnN"

# Recovery template phrases (lower-cased text, accents kept).
RECOVERY_TEMPLATE_PHRASES = [
    "préstamo por tu auto",
    "oferta pre aprobada",
    "aprovecha tu oferta",
    "espera de que nos proporciones tus documentos",
    "template:",
]

# Pre-validation phrases (lower-cased, accent-stripped text).
PRE_VALIDATION_PHRASES = [
    "antes de continuar, necesito confirmar tres detalles importantes sobre tu auto",
    "necesito confirmar algunos detalles sobre tu auto y tu elegibilidad para el credito",
]

# Hand-off invitation alternatives (case-insensitive, accent-stripped text).
HANDOFF_INVITATION = [
    "Estas a un paso de la aprobacion de tu prestamo personal",
    "un paso de la aprobacion",
    "Esta oferta es por tiempo limitado",
    "Completa el proceso ahora",
    "asegura tu prestamo en minutos",
    "No pierdas la oportunidad",
]

# Hand-off acceptance patterns, tried in this order (lower, accent-stripped).
HANDOFF_ACCEPT = [
    r"si(,)?\s+(quisiera|quiero)",
    r"acepto.*oferta",
    r"(quisiera|quiero|gustaria).*mas\s+informacion",
    r"me\s+interesa",
    r"(quisiera|quiero|gustaria).*saber\s+mas",
    r"continuar.*proceso",
    r"^si$",
    r"^si\s+por\s+favor$",
]

# Hand-off decline patterns, tried after acceptance.
HANDOFF_DECLINE = [
    r"no(,)?\s+(quiero|quisiera|me\s+interesa)",
    r"no\s+gracias",
    r"rechaz[oa]",
    r"^no$",
]

# Hand-off completion patterns (lower, accent-stripped bot text).
HANDOFF_COMPLETION = [
    r"tu\s+solicitud\s+ha\s+sido\s+enviada",
    r"tu\s+solicitud\s+ha\s+sido\s+recibida",
    r"tu\s+solicitud\s+ha\s+sido\s+procesada",
    r"gracias\s+por\s+completar\s+el\s+proceso",
    r"hemos\s+recibido\s+tu\s+solicitud",
]

# Human-transfer phrases (case-insensitive, matched on accent-stripped text;
# the accented one therefore never matches unless strict mode strips it too).
HUMAN_TRANSFER = [
    "transferirte con un asesor humano",
    "conectarte con un agente humano",
    "hablar con un asesor",
    "comunicarte con un asesor",
    "transferir con un ejecutivo",
    "un momento, estoy teniendo problemas",
    "un supervisor te asistirá",
    "transferirte con una persona",
]

# Formalisation phase start (lower-cased text, accents kept).
PHASE_START = "y estaré acompañándote en esta última parte del proceso"

# Personal-data patterns: phone runs first, then e-mail addresses.
PII_PHONE = r"\b\d{10,}\b"
PII_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PII_PHONE_TOKEN = "[PHONE_REDACTED]"
PII_EMAIL_TOKEN = "[EMAIL_REDACTED]"

# Lead-name greeting in the first bot message.
LEAD_NAME_GREETING = r"Hola \*(.*?)\*!"

# Default texts.
NO_CONVERSATION_SUMMARY = "No conversation data found"
NO_CONVERSATION_AVAILABLE = "No conversation data available"
NO_CONVERSATION_DIGEST = "no_conversation_data"
TRANSFER_DEFAULT_LINE = 'transfer_context_analysis: "N/A"'

# Stall reason -> initial action.
STALL_INITIAL_ACTION = [
    ("NUNCA_RESPONDIO", "LLAMAR_LEAD"),
    ("FINANCIAMIENTO_ACTIVO", "CERRAR"),
    ("VEHICULO_ANTIGUO_KM", "CERRAR"),
    ("NO_PROPIETARIO", "CERRAR"),
    ("VIN_EXTRANJERO", "CERRAR"),
    ("ZONA_NO_CUBIERTA", "CERRAR"),
    ("USUARIO_SIN_AUTO", "CERRAR"),
    ("RECHAZADO_POR_KUNA", "CERRAR"),
    ("PRODUCTO_INCORRECTO_COMPRADOR", "CERRAR"),
    ("OTRO_PROCESO_DE_NEGOCIO", "CERRAR"),
    ("DESINTERES_EXPLICITO", "CERRAR"),
    ("ADEUDO_VEHICULAR_MULTAS", "MANEJAR_OBJECION"),
    ("PROBLEMA_SEGUNDA_LLAVE", "MANEJAR_OBJECION"),
    ("PROBLEMA_TERMINOS", "MANEJAR_OBJECION"),
    ("OTRO", "MANEJAR_OBJECION"),
    ("ERROR_PROCESO_INTERNO", "CONTACTO_PRIORITARIO"),
    ("PROCESO_EN_CURSO", "ESPERAR"),
    ("GHOSTING", "INSISTIR"),
]

# Actions that keep a suggested message.
MESSAGE_ACTIONS = ["CONTACTO_PRIORITARIO", "MANEJAR_OBJECION", "INSISTIR"]

# Recipe enums (simulation_to_handoff).
STALL_REASONS = [
    "NUNCA_RESPONDIO", "FINANCIAMIENTO_ACTIVO", "VEHICULO_ANTIGUO_KM", "NO_PROPIETARIO",
    "VIN_EXTRANJERO", "ZONA_NO_CUBIERTA", "USUARIO_SIN_AUTO", "RECHAZADO_POR_KUNA",
    "PRODUCTO_INCORRECTO_COMPRADOR", "OTRO_PROCESO_DE_NEGOCIO", "DESINTERES_EXPLICITO",
    "ADEUDO_VEHICULAR_MULTAS", "PROBLEMA_SEGUNDA_LLAVE", "PROBLEMA_TERMINOS",
    "ERROR_PROCESO_INTERNO", "PROCESO_EN_CURSO", "GHOSTING", "OTRO",
]
NEXT_ACTIONS = [
    "CERRAR", "ESPERAR", "LLAMAR_LEAD", "CONTACTO_PRIORITARIO", "MANEJAR_OBJECION",
    "INSISTIR", "ENVIAR_PLANTILLA_RECUPERACION",
]

# Campaign engagement -> action, context.
CAMPAIGN_ACTION = [
    ("IGNORED_NO_RESPONSE", "CLOSE_IGNORED", "Sin reacción al blast"),
    ("CLICKED_BUTTON_ONLY", "MONITOR", "Dio clic, sin chat"),
    ("PROCESS_STARTED_ACTIVE", "WAIT", "Proceso en marcha (<48 h)"),
    ("PROCESS_STARTED_UNFINISHED", "RESPOND_FOLLOW_UP", "Retomar proceso estancado"),
    ("EXPLICITLY_NO", "ACKNOWLEDGE_CLOSE", "Lead no interesado"),
    ("TECHNICAL_ISSUE", "RESPOND_ISSUE", "Resolver inconveniente"),
    ("NOT_ELIGIBLE_BUREAU", "ACKNOWLEDGE_CLOSE", "Lead no elegible (Buró)"),
]

# Engagement-recipe action codes for recontact scheduling.
RECONTACT_CODES = ["PROBLEMA_TERMINOS", "ADEUDO_VEHICULAR_MULTAS", "PROBLEMA_SEGUNDA_LLAVE"]
ESCALATE_CODES = ["OTRO_PROCESO_DE_NEGOCIO", "ERROR_PROCESO_INTERNO"]

# Smart-summary texts (formalisation report), in rule order.
SUMMARY_NO_CONVERSATION = "Sin conversación registrada"
SUMMARY_GPS_DONE = "Proceso fluido: documentos validados y GPS completado"
SUMMARY_VALIDATION_GPS_SCHEDULED = "Documentos en validación, GPS agendado"
SUMMARY_VALIDATION_GPS_PENDING = "Documentos en validación, GPS pendiente"
SUMMARY_VALIDATION = "Documentos en validación"
SUMMARY_STUCK = "Cliente atascado: documentos sin validar, atención deficiente"
SUMMARY_MISSING_DOCS = "Cliente necesita enviar documentos faltantes"
SUMMARY_DOCS_GPS_SCHEDULED = "Documentos completos, GPS agendado"
SUMMARY_DOCS_GPS_PENDING = "Documentos completos, GPS pendiente"
SUMMARY_IN_PROGRESS = "Proceso en curso"

# Label keys of the hand-off recipe and the critical enum keys.
HANDOFF_LABEL_KEYS = [
    "summary", "primary_stall_reason_code", "transfer_context_analysis", "next_action_code",
    "suggested_message_es",
]
CRITICAL_ENUM_KEYS = ["primary_stall_reason_code", "next_action_code"]

# Stall codes that make a lead ineligible (engagement recipe next action).
INELIGIBLE_CODES = [
    "FINANCIAMIENTO_ACTIVO", "VEHICULO_ANTIGUO_KM", "NO_PROPIETARIO", "VIN_EXTRANJERO",
    "ZONA_NO_CUBIERTA", "USUARIO_SIN_AUTO", "RECHAZADO_POR_KUNA",
    "PRODUCTO_INCORRECTO_COMPRADOR",
]

# Curated 12-column projection of the formalisation report.
CURATED_COLUMNS = [
    "agente", "asset_id", "nombre", "correo", "cleaned_phone", "lead_created_at",
    "resumen_general", "documentos_enviados_analisis", "enviado_a_validacion",
    "calidad_atencion_agente", "objecion_principal_cliente", "gps_instalacion_agendada",
]

# Sentinel texts blanked out in curated reports.
SENTINELS = ["nan", "None", "NaN"]

# Parameter names whose values are masked in logs / published frames.
SENSITIVE_NAMES = ["phone", "email", "password"]
# --- END FIXED VALUES -------------------------------------------------------
