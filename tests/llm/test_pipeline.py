"""The pipeline against the brute-force version of every stage."""

from test_dedup_shard import brute_dedup, brute_near, tuples
from test_filters import brute_op7
from test_tokens import brute_op6

import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from convolens.llm import language_id

SF = "/root/testdata/sf0.001"


def test_pipeline_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words, held = language_id.learning(docs)
    model = language_id.fit(words)
    margins = language_id.fit_margins(held, model)
    classify = language_id.Classifier(model)
    judged = [(d, t, *classify(t or "")) for d, t in rows]
    rows = [(d, t) for d, t, lang, score, letters in judged if lang != "und" and score >= language_id.margin_for(margins, letters)]
    keep = {r[0] for r in brute_dedup(rows) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    keep = {r[0] for r in brute_near(rows) if r[0] == r[2]}
    rows = [r for r in rows if r[0] in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_op7(rows, items) if not r[5]}
    assert 0 < len(clean) < len(rows)
    rows = [r for r in rows if r[0] in clean]
    got = E.queries()["pipeline"](spark, SF)
    assert tuples(got) == brute_op6(Tokenizer.from_file(P.path("word_bpe_49k.json")), rows)


def test_stages_keep_columns_and_take_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, name string, ids string"
    odd = [
        (1, None, "en", "s", 0, "", ""), (2, "", None, None, None, None, None), (None, "words of a text", "en", "s", 1, "", ""),
        (3, "words of a text again and more", "en", "s", 1, "", ""), (3, "words of a text again and more", "en", "s", 1, "", ""),
    ]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == docs.columns, name
            assert out.count() <= len(rows)


def test_clean_documents_stay_in_the_language_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.count() >= 0.98 * docs.count()
