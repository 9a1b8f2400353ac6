"""Conversation transcripts: line rendering (F7/F8) and the digest.

The digest tells whether a conversation changed since it was last handled; it
is only ever compared with itself.  It is built from sums over the hashes of
the conversation's normalised lines (which carry their times), so it is a
plain partial aggregation: a conversation holding most of all messages is
combined map-side, and the order rows arrive in cannot matter.

A transcript is a sequence of chunk rows cut by a byte budget: running sums of
bytes along the sorted messages (``operators/prefix.py``) place every line, so
no cell and no task grows with a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions.text import normalize_ws
from convolens.functions.timefmt import ts_text19
from convolens.operators.prefix import PLACE, with_prefix

PLAIN = "plain"  # "{time19} {from}: {msg}", lines joined by a newline
PROMPT = "prompt"  # F8: "[{time19}] {from}: {msg}", lines joined by the two characters \\n
PROMPT_SEPARATOR = "\\n"
CHUNK_BYTES = 1 << 20


def render_line(style: str = PLAIN) -> Column:
    """One transcript line per message row."""
    t = F.coalesce(ts_text19(F.col("creation_time")), F.lit(""))
    who = F.coalesce(F.col("msg_from"), F.lit(""))
    msg = F.coalesce(F.col("message"), F.lit(""))
    if style == PROMPT:
        return F.concat(F.lit("["), t, F.lit("] "), who, F.lit(": "), msg)
    return F.concat(t, F.lit(" "), who, F.lit(": "), msg)


def line_parts() -> dict[str, Column]:
    """What one line adds to its conversation's digest."""
    line = F.md5(normalize_ws(render_line(PLAIN)))
    half = lambda at: F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(20,0)")
    return {"n": F.lit(1).cast("long"), "high": half(1), "low": half(16)}


def digest_parts() -> dict[str, Column]:
    """Aggregates a digest is made of: rows and two sums of line hashes."""
    return {n: F.sum(c) for n, c in line_parts().items()}


def digest_of(n: Column, high: Column, low: Column) -> Column:
    return F.md5(F.concat_ws(":", n.cast("string"), high.cast("string"), low.cast("string")))


def conversation_digest(messages: DataFrame, key: str = "cleaned_phone") -> DataFrame:
    """``(key, conversation_digest, n_messages)``; a null key is a key."""
    parts = messages.groupBy(key).agg(*[c.alias(f"__{n}") for n, c in digest_parts().items()])
    digest = digest_of(F.col("__n"), F.col("__high"), F.col("__low"))
    return parts.select(key, digest.alias("conversation_digest"), F.col("__n").alias("n_messages"))


def conversation_chunks(
    messages: DataFrame, key: str = "cleaned_phone", style: str = PROMPT, budget: int = CHUNK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The ordered transcript as ``(key, chunk_no, text)``, whose texts
    in a row are the whole, none over ``budget`` bytes; and its sums
    ``(key, n_messages, n_bytes, n_chunks)``.

    A line is placed by the bytes up to its end; lines longer than half the
    budget are cut.  So a chunk is what ends within one half budget, plus at
    most one half before, and chunks have no gaps in their numbers."""
    from convolens.operators.features import order_key

    half = max(budget // 2, 16)
    size = half // 4  # characters of at most four bytes
    separator = PROMPT_SEPARATOR if style == PROMPT else "\n"
    line = F.concat(F.lit(separator), render_line(style))
    rows = messages.select(key, order_key(messages.columns).alias("__o"), line.alias("__line"))
    starts = F.sequence(F.lit(0), F.floor((F.length("__line") - 1) / size).cast("int"))
    pieces = rows.select(key, "__o", F.posexplode(F.transform(starts, lambda i: F.substring("__line", i * size + 1, F.lit(size)))).alias("piece", "text"))
    measures = {
        "n_messages": (F.col("piece") == 0).cast("long"),
        "n_bytes": F.octet_length("text").cast("long"),
    }
    placed, sums = with_prefix(pieces, key, F.struct("__o", "piece"), measures)
    first = (F.col("n_messages") == 0) & (F.col("piece") == 0)  # no separator before the first line
    of = F.floor((F.col("n_bytes") + F.octet_length("text") - 1) / half).cast("long")
    own = F.when(first, F.substring("text", F.lit(len(separator) + 1), F.length("text"))).otherwise(F.col("text"))
    held = placed.select(key, of.alias("chunk_no"), F.struct(PLACE, own.alias("text")).alias("__row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("__row")), lambda r: r["text"]), "")
    sums = sums.select(
        key, "n_messages", (F.col("n_bytes") - len(separator)).alias("n_bytes"),
        (F.floor((F.col("n_bytes") - 1) / half) + 1).cast("long").alias("n_chunks"),
    )
    return held.groupBy(key, "chunk_no").agg(text.alias("text")), sums


def conversation_text(messages: DataFrame, key: str = "cleaned_phone", style: str = PROMPT) -> DataFrame:
    """``(key, conversation_text, n_messages)``, the ordered transcript in
    one cell: for conversations known to be small (see ``conversation_chunks``)."""
    chunks, sums = conversation_chunks(messages, key, style)
    held = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(held, lambda c: c["text"]), "").alias("conversation_text"))
    counted = sums.select(F.col(key).alias("__key"), "n_messages")
    return whole.join(counted, whole[key].eqNullSafe(counted["__key"])).drop("__key")
