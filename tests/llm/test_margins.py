"""Margins are those of all texts given, held against the plain computation."""

import random

from convolens.llm import language_id

SCHEMA = "text string, lang string"
WORDS = {
    "en": "the house and a river of stone with their people under every window of that town".split(),
    "es": "la casa y un rio de piedra con su gente bajo cada ventana de aquel pueblo".split(),
    "de": "das haus und ein fluss aus stein mit ihren leuten unter jedem fenster jener stadt".split(),
}


def brute_margins(rows, model, rate=0.98, slack=0.5, tail=0.01, least=20):
    classify = language_id.Classifier(model)
    by_class = {}
    for text, lang in set(rows):
        if lang is not None and text and any(map(str.isalpha, text)):
            found, score, letters = classify(text)
            by_class.setdefault(max(letters, 1).bit_length(), []).append((score, found == lang))
    margins = {}
    for size, own in by_class.items():
        if len(own) < least:
            continue
        own.sort(reverse=True)
        right = good = 0
        for n, (_, ok) in enumerate(own, 1):
            right += ok
            good = n if right >= rate * n else good
        accurate = 0.0 if good == len(own) else own[good - 1][0] if good else 1.0
        leads = [score for score, ok in own if ok]
        usual = leads[max(0, int(len(leads) * (1 - tail)) - 1)] if leads else 0.0
        margins[size] = max(accurate, slack * usual)
    return margins


def labelled_texts(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        lang = draw.choice(sorted(WORDS))
        text = [draw.choice(WORDS[lang if draw.random() < 0.8 else "es"]) for _ in range(draw.choice([2, 3, 6, 12, 25, 50]))]
        rows.append((" ".join(text) + f" {k}", lang))
    return rows


def test_every_text_counts(spark):
    model = language_id.fit(spark.createDataFrame(labelled_texts(300), SCHEMA))
    rows = labelled_texts(2_600, seed=2)
    hashed = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "lang", "xxhash64(text) as h").orderBy("h").collect()
    turned = {"en": "es", "es": "de", "de": "en"}
    rows = [(r.text, r.lang if i < 2_000 else turned[r.lang]) for i, r in enumerate(hashed)]  # the greatest hashes are labelled wrong
    want = brute_margins(rows, model)
    got = language_id.fit_margins(spark.createDataFrame(rows, SCHEMA).repartition(5), model)
    assert len(want) > 2 and got == want
    assert got != brute_margins(rows[:2_000], model)


def test_odd_tables(spark):
    rows = labelled_texts(400, seed=3)
    model = language_id.fit(spark.createDataFrame(labelled_texts(300), SCHEMA))
    odd = rows + rows[:150] * 3 + [(None, "en"), ("", "en"), ("12 34", "en"), ("the house", None), ("the house", "en")]
    df = spark.createDataFrame(odd, SCHEMA)
    assert language_id.fit_margins(df, model) == brute_margins(odd, model)
    assert language_id.fit_margins(df, model, rate=0.6, tail=0.2, least=5) == brute_margins(odd, model, 0.6, tail=0.2, least=5)
    wrong = [(t, "xx") for t, _ in rows]
    assert language_id.fit_margins(spark.createDataFrame(wrong, SCHEMA), model) == brute_margins(wrong, model)
    assert language_id.fit_margins(df, {}) == {1: 1.0}
    assert language_id.fit_margins(df, model, least=10_000) == {}
    assert language_id.fit_margins(spark.createDataFrame([], SCHEMA), model) == {}
