"""Operators for large text corpora: deduplication, language, scoring, tokens.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries.py`` holds the thin
registered queries (``opN_*``) and their DuckDB twins.
"""
