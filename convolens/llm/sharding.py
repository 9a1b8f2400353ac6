"""Sharding by jump consistent hashing.

A 64-bit key is mapped to one of ``n`` shards by the jump walk: from shard
``b`` the next candidate is ``floor((b + 1) * 2^31 / (draw + 1))`` with draws
from the 64-bit linear congruential step ``k -> k * 2862933555777941757 + 1``;
the last candidate below ``n`` is the shard.  No ring table is stored, and
growing from ``n`` to ``n + 1`` shards moves keys only into the new shard.

Everything is a column expression.  The walk is one ``aggregate`` over at most
``n`` steps; the key is held as two 32-bit halves, so no product overflows a
signed long (ANSI mode raises on overflow).

Slots number the rows of a shard from 0 without a gap, by id, then text.  They
are running counts along the rows sorted by (shard, id, text), which are
range-partitioned with a number of each row as the last key: neither a shard nor
a hot id nor a group of equal rows is a task (``operators/prefix.py``).

Defined cases: an integer id is its own key, any other (text, say) its 64-bit
hash; a null id has key 0, a null text zero bytes and crc 0; rows that repeat an
id share its shard and get different slots; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolens.operators.prefix import with_prefix

_MASK = 0xFFFFFFFF
_MULTIPLIER = 2862933555777941757  # fixed value of the published algorithm
_HIGH, _LOW = _MULTIPLIER >> 32, _MULTIPLIER & _MASK


def _times(a: Column, b: int) -> tuple[Column, Column]:
    """High and low 32 bits of ``a * b`` for unsigned 32-bit ``a``, ``b``;
    the high part is right modulo 2^32."""
    first = a.bitwiseAND(0xFFFF) * F.lit(b).cast("long")
    second = F.shiftrightunsigned(a, 16) * F.lit(b).cast("long")
    low = first + F.shiftleft(second.bitwiseAND(0xFFFF), 16)
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(second, 16)
    return high, low.bitwiseAND(_MASK)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key among ``shards``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_MASK).cast("long")).alias("lo"),
        F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        carry, low = _times(s["lo"], _LOW)
        grown = low + 1
        _, mid = _times(s["lo"], _HIGH)
        _, top = _times(s["hi"], _LOW)
        high = (carry + mid + top + F.shiftrightunsigned(grown, 32)).bitwiseAND(_MASK)
        nxt = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(high, 1) + 1).cast("double")))
        return F.when(s["j"] >= shards, s).otherwise(
            F.struct(
                high.alias("hi"),
                grown.bitwiseAND(_MASK).alias("lo"),
                s["j"].alias("b"),
                nxt.alias("j"),
            )
        )

    # b takes the candidate of the step before; the walk ends when j >= shards.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def key_of(df: DataFrame, id_col: str) -> Column:
    """The 64-bit key of an id."""
    whole = isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    key = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return F.coalesce(key, F.lit(0).cast("long"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key_of(docs, id_col), shards).alias("shard"),
        jump_hash(key_of(docs, id_col), shards + 1).alias("grown_shard"),
    )
    order = F.struct("doc_id", "text_crc32", "size", F.monotonically_increasing_id())
    placed, _ = with_prefix(rows, "shard", order, {"slot": F.lit(1).cast("long")})
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
