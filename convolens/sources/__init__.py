"""Sources (driver tables, adapters, file readers) and sinks."""

from convolens.sources.adapters import (
    event_messages,
    financing_leads,
    intents,
    leads_audit,
    leads_from_customers,
    message_rows,
    raw_message_metrics,
    session_metrics,
)
from convolens.sources.tables import MESSAGE_SCHEMA, TABLES, read_table

__all__ = [
    "MESSAGE_SCHEMA", "TABLES", "event_messages", "financing_leads", "intents", "leads_audit",
    "leads_from_customers", "message_rows", "raw_message_metrics", "read_table", "session_metrics",
]
