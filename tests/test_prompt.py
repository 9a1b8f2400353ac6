"""Prompt chunks: whole in order, none over the budget."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from convolens.operators.prompt import SYSTEM_MESSAGE, around, prompt_chunks, render
from convolens.operators.transcript import PLAIN, PROMPT, conversation_chunks

SCHEMA = "cleaned_phone string, src_ord int, creation_time timestamp, msg_from string, message string"
T0 = datetime(2024, 1, 4)
ROWS = (
    [("a", i, T0 + timedelta(minutes=i), "user", f"hola número {i} " + "ñ" * (i % 40)) for i in range(120)]
    + [("b", 0, T0, "bot", "x" * 3_000), ("b", 1, T0, "user", "日本語" * 700), ("b", 2, T0, "bot", "end")]
    + [("c", 0, None, None, None), ("d", 0, T0, "user", ""), ("e", 0, T0, "user", "no values")]
)


def transcript(key, style):
    own = [r for r in ROWS if r[0] == key]
    when = lambda t: t.strftime("%Y-%m-%d %H:%M:%S") if t else ""
    if style == PROMPT:
        return "\\n".join(f"[{when(t)}] {w or ''}: {m or ''}" for _, _, t, w, m in own)
    return "\n".join(f"{when(t)} {w or ''}: {m or ''}" for _, _, t, w, m in own)


@pytest.mark.parametrize("style", [PLAIN, PROMPT])
@pytest.mark.parametrize("budget", [40, 333, 1 << 20])
def test_chunks_are_the_transcript(spark, style, budget):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    chunks, sums = conversation_chunks(df, style=style, budget=budget)
    rows, totals = chunks.collect(), {r.cleaned_phone: r for r in sums.collect()}
    assert max(len(r.text.encode()) for r in rows) <= budget
    for key in "abcde":
        own = sorted((r.chunk_no, r.text) for r in rows if r.cleaned_phone == key)
        assert [n for n, _ in own] == list(range(len(own))) and "".join(t for _, t in own) == transcript(key, style)
        assert totals[key].n_chunks == len(own) and totals[key].n_bytes == len(transcript(key, style).encode())
        assert totals[key].n_messages == sum(r[0] == key for r in ROWS)


@pytest.mark.parametrize("budget", [64, 500, 1 << 20])
def test_prompt_chunks_are_the_prompt(spark, budget):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    values = spark.createDataFrame([(k, f"nombre {k} " + "é" * 90, k * 3) for k in "abcd"], "cleaned_phone string, who string, extra string")
    template = "Para {who}:\n{conversation_text}\n{{yaml}} {extra}"
    got = prompt_chunks(df, values, template, keep=("extra",), budget=budget).collect()
    assert {r.cleaned_phone for r in got} == set("abcd") and max(len(r.text.encode()) for r in got) <= budget
    for k in "abcd":
        own = sorted((r for r in got if r.cleaned_phone == k), key=lambda r: r.chunk_no)
        whole = template.format(who=f"nombre {k} " + "é" * 90, conversation_text=transcript(k, PROMPT), extra=k * 3)
        assert "".join(r.text for r in own) == whole and [r.chunk_no for r in own] == list(range(own[0].n_chunks))
        assert {r.token_estimate for r in own} == {len(whole.encode()) + len(SYSTEM_MESSAGE.encode()) + 11} and own[0].extra == k * 3


def test_empty_ends_and_bad_templates(spark):
    df = spark.createDataFrame(ROWS[:3], SCHEMA)
    values = spark.createDataFrame([("a",)], "cleaned_phone string")
    assert "".join(r.text for r in prompt_chunks(df, values, "{conversation_text}").orderBy("chunk_no").collect()).startswith("[2024-01-04")
    assert prompt_chunks(df.limit(0), values, "x {conversation_text}").count() == 0
    for bad in ("no transcript", "{conversation_text} {conversation_text}"):
        with pytest.raises(ValueError):
            around(bad, "conversation_text")
    with pytest.raises(KeyError):
        render("{unknown}", {"a": F.lit("x")})
    with pytest.raises(ValueError):
        render("{a:>5}", {"a": F.lit("x")})
