"""Prompt rendering (F11) and the token estimate.

A prompt is a sequence of chunk rows, as the transcript it holds: the text
before the transcript, the transcript's chunks, the text after it.  Read in
order they are the prompt; none is over the byte budget.

The template is split once, on the driver, with the standard library's
``string.Formatter`` into literal segments and placeholder names; rendering is
then a single ``concat`` per row (no Python per row), and a placeholder the
plan cannot supply is an error at plan time, not at run time.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.operators.transcript import CHUNK_BYTES, PROMPT, conversation_chunks
from convolens.sources.stage import staged

# FIXED VALUES — system message sent with every prompt (counts toward tokens).
SYSTEM_MESSAGE = (
    "You are a helpful customer‑support summarisation bot that responds ONLY in valid YAML format as requested."
)
TOKENS_PER_MESSAGE = 4
TOKENS_PER_REPLY = 3


def as_py_text(col: Column, dtype: str) -> Column:
    """Text of a column value the way Python's ``str.format`` prints it."""
    if dtype == "boolean":
        return F.when(col.isNull(), "None").when(col, "True").otherwise("False")
    return F.coalesce(col.cast("string"), F.lit("None"))


def render(template: str, values: dict[str, Column]) -> Column:
    """``template.format(**values)`` as one ``concat``; ``{{``/``}}`` unescape."""
    parts: list[Column] = []
    missing = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if spec or conv:
            raise ValueError(f"format specs are not supported in prompt templates: {{{field}!{conv}:{spec}}}")
        if field not in values:
            missing.append(field)
            continue
        parts.append(values[field])
    if missing:
        raise KeyError(f"prompt template needs values the plan does not provide: {missing}")
    return F.concat(*parts) if parts else F.lit("")


def token_estimate(prompt_bytes: Column, system: str = SYSTEM_MESSAGE) -> Column:
    """F10 (byte-count fallback): bytes of the system and user messages, plus
    four per message and three for the reply."""
    return (prompt_bytes + F.lit(len(system.encode("utf-8"))) + F.lit(2 * TOKENS_PER_MESSAGE + TOKENS_PER_REPLY)).cast("bigint")


def around(template: str, field: str) -> tuple[str, str]:
    """What a template has before and after its one ``{field}``, as templates."""
    before, found, after = template.partition("{" + field + "}")
    if not found or "{" + field + "}" in after:
        raise ValueError(f"the prompt template must name {{{field}}} once")
    return before, after


def _cut(text: Column, size: int) -> Column:
    """A text as an array of texts of at most ``size`` characters (empty: none)."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    )


def prompt_chunks(
    messages: DataFrame,
    values: DataFrame,
    template: str,
    keep: tuple[str, ...] = (),
    key: str = "cleaned_phone",
    budget: int = CHUNK_BYTES,
    field: str = "conversation_text",
) -> DataFrame:
    """F8 + F10 + F11: ``(key, chunk_no, text, n_chunks, n_messages,
    token_estimate, *keep)`` for the keys of ``values``, one row per key whose
    columns are the template's values as text (and ``keep``)."""
    columns = {c: F.col(c) for c in values.columns}
    head, tail = (render(part, columns) for part in around(template, field))
    chunks, sums = conversation_chunks(messages, key, PROMPT, budget)
    size = max(budget, 32) // 4
    ends = values.select(key, *keep, head.alias("__head"), tail.alias("__tail")).join(sums, key)
    ends = ends.withColumn("__bytes", F.octet_length("__head") + F.octet_length("__tail") + F.col("n_bytes")).select(
        key, *keep, "n_messages", F.col("n_chunks").alias("__middle"),
        _cut(F.col("__head"), size).alias("__first"), _cut(F.col("__tail"), size).alias("__last"),
        token_estimate(F.col("__bytes")).alias("token_estimate"),
    )
    ends = staged(ends, "prompt-ends")
    n_head = F.size("__first").cast("long")
    ends = ends.withColumn("n_chunks", n_head + F.col("__middle") + F.size("__last"))
    shared = ["n_chunks", "n_messages", "token_estimate", *keep]
    number = lambda parts, at: F.transform(parts, lambda t, i: F.struct((at + i).alias("chunk_no"), t.alias("text")))
    outer = ends.select(
        key, F.inline(F.concat(number(F.col("__first"), F.lit(0).cast("long")), number(F.col("__last"), n_head + F.col("__middle")))), *shared
    )
    inner = chunks.join(ends, key).select(key, (n_head + F.col("chunk_no")).alias("chunk_no"), "text", *shared)
    return outer.unionByName(inner)
