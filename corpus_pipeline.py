"""A corpus pipeline over ``documents``: language, duplicates, leaks, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last keep the columns of ``docs`` and drop rows:

``language``       documents whose language is rejected go: no letter at all,
                   or none that leads by the margin of its length
``exact``          of equal texts (white space aside) one document stays
``near``           of each group linked by SimHash one row of the smallest id stays
``decontaminate``  documents with a word inside a benchmark window go
``tokens``         the rest, encoded and decoded: digests per document

Empty input gives empty output at every stage; null texts have no letter and
go in the first; rows with a null or repeated id are judged one by one, like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from convolens.llm import chunk_reuse, language_id
from convolens.llm.common import documents
from convolens.llm.decontaminate import uncontaminated
from convolens.llm.exact_dedup import deduplicated
from convolens.llm.queries import MAX_BITS, SHINGLE, SPAN, WORD_BPE
from convolens.llm.simhash import one_per_group
from convolens.llm.vocab import tokenizer_path
from convolens.session import checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words, held = language_id.learning(docs)
    model = language_id.fit(words)
    return language_id.accepted(docs, model, language_id.fit_margins(held, model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, repeats=False)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs, SHINGLE, MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=SPAN)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_reuse.digests(chunk_reuse.encode_decode(docs, tokenizer_path(WORD_BPE)))


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: Compression, XXH64 and BPE are beyond SQL; tests/llm/test_pipeline.py holds
#: the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
