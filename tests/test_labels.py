"""Mappings as YAML reads them, and line by line where it cannot."""

import random
import re

import pytest

from convolens.operators import labels as LB
from convolens.operators import report as RP
from convolens.plans.recipe import LabelKey, Recipe, run_recipe

yaml = pytest.importorskip("yaml")

CASES = [
    "summary: |\n  line one\n  line two\n\n  para\nnext_action_code: X",
    "summary: >\n  line one\n  line two\n\n  para\n    more\n  back\nx: >-\n  a\n  b\ny: |+\n  k\n\nz: one",
    "a: |-\n    deep\n      deeper\n    back\nb: >+\n  x\n\nc: y",
    "summary:\n  - a\n  - 'b c'\n  - 3\n  - it's\n  - true\n  - dos\n    lineas\nk:\n- u\n- v",
    "m:\n  a: uno\n  b: \"x\"\nf: [a, 2, 'q']\ne: []\ng: [ x ,y ]",
    'a: "x\\ny\\tz \\"q\\" \\\\n"\nb: "c \\/ d"\nc:\nd: ~',
    "a: plain text\n  goes on\n  and on\nb: 'quoted\n  over lines'",
    "a: 'it''s'\nb: x # note\n# comment\nc: # nothing\nd: yes",
    "---\na: b", "# first\n\na: b",
    # no YAML: the fallback
    "key1: v\n  key2: w\n  key3:",
    "Here it is\nsummary: x\nnext: 'open",
    "a: @x\nb: `y`", "a: *ref", "a: %x", '- a\n- b\nk: "N/A"', 'a: "bad \\q"', 'a: "x" y', "a: 'it's'", "a: [open", "a: - b", "a: b: c",
    "no mapping at all", "- a\n- b", "",
]


def expected(text):
    """What safe_load gives, in the reports' text form; line by line if it fails."""
    def shown(v):
        return v if v is None or isinstance(v, str) else str(v)

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        found = (re.match(r"^\s*([a-zA-Z0-9_]+)\s*:\s*(.*)$", line) for line in text.split("\n"))
        return {m[1]: m[2].strip() or "N/A" for m in found if m}
    return {k: shown(v) for k, v in data.items()} if isinstance(data, dict) else {}


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cleaned string")
    rows = LB._with_entries(df, "cleaned").orderBy("i").collect()
    return [{e["k"]: e["v"] for e in r["__entries"]} for r in rows]


def test_entries_are_what_yaml_reads(spark):
    for text, got in zip(CASES, parsed(spark, CASES)):
        assert got == expected(text), text


def test_random_mappings(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["hola", "se fue", "ñandú", "it's", "a-b", "x, y", "fin."])
    def lines(pad):
        return "\n".join(rng.choice(["", pad + word(), pad + "  " + word()]) if i else pad + word() for i in range(rng.randint(1, 5)))

    def value():
        kind = rng.randint(0, 6)
        if kind == 0:
            return " " + word()
        if kind == 1:
            return ' "' + rng.choice(["a\\nb", "\\\\", "say \\\"x\\\"", "plain"]) + '"'
        if kind == 2:
            return " |" + rng.choice(["", "-", "+"]) + "\n" + "\n".join(x for x in lines("  ").split("\n") if x.strip())
        if kind == 3:
            return " >" + rng.choice(["", "-"]) + "\n" + re.sub(r"\n    (?=\S)", "\n  ", lines("  ")).rstrip("\n")
        if kind == 4:
            return "\n" + "\n".join("  - " + w for w in rng.sample(["uno", "dos y tres", "'q'", "7", "no"], 3))
        if kind == 5:
            return "\n  clave: " + word() + "\n  otra: x"
        return rng.choice(["", " null", " true", " [a, b]", " 'it''s'"])

    texts = ["\n".join(f"k{i}:{value()}" for i in range(rng.randint(1, 5))) for _ in range(300)]
    for text, got in zip(texts, parsed(spark, texts)):
        assert got == expected(text), text


def test_one_result_per_phone(spark):
    """Two label rows whose phones normalise to one key: the lead stays one row, with the newest."""
    recipe = Recipe(name="r", processors=(("TemporalProcessor", ()),), label_keys=(LabelKey("summary"),), output_columns=("cleaned_phone", "summary"))
    leads = spark.createDataFrame([("5512345678", "Ana")], "cleaned_phone string, name string")
    messages = spark.sql("SELECT '5512345678' cleaned_phone, timestamp'2024-01-01 00:00:00' creation_time, 'user' msg_from, 'hola' message")
    two = [("+52 5512345678", "old", 1), ("5512345678", "new", 2), ("5512345678 x", "older", 0)]
    for order in (two, two[::-1]):
        labels = spark.createDataFrame(order, "cleaned_phone string, summary string, turn int")
        assert [r.summary for r in run_recipe(recipe, leads, messages, labels).collect()] == ["new"]
        raw = spark.createDataFrame([(p, f"summary: {s}", t) for p, s, t in order], "cleaned_phone string, raw_response string, turn int")
        assert [r.summary for r in run_recipe(recipe, leads, messages, responses=raw).collect()] == ["new"]
        bare = labels.drop("turn")  # without an order: the greatest text, in any input order
        assert [r.summary for r in run_recipe(recipe, leads, messages, bare).collect()] == ["older"]


def test_one_per_key_orders_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "z"), ("a", 1, "y"), (None, 3, "n"), ("b", None, None)], "cleaned_phone string, turn int, v string")
    got = sorted((tuple(r) for r in RP.one_per_key(df.repartition(3)).collect()), key=repr)
    assert got == sorted([("a", 1, "y"), ("b", None, None), (None, 3, "n")], key=repr)
    assert RP.one_per_key(df.limit(0)).count() == 0 and RP.one_per_key(df.select("cleaned_phone")).count() == 3
