"""Language identification by compression.

Per language a zstandard raw-content dictionary is made from excerpts of
labelled texts.  A text is lower-cased, runs of other characters than letters
become one space, and it is cut into blocks so that every part of a long text
is compressed next to the dictionary.  Each block is compressed with each
language's dictionary; the language with the smallest total wins.  The score
is ``1 - smallest / second smallest`` clipped to 0..1; a text whose score is
below the margin for its length is ``rejected``: no language stands out, as in
a language that was not learned, or in a few letters.

``fit_margins`` finds the margins on labelled texts that are not in the
dictionaries.  Per length (letters, in powers of two) a margin is the least lead
from which on ``rate`` of the texts are right, and at least ``slack`` times the
lead that all but ``tail`` of the right ones have: what leads much less than
known languages do is not one of them.  A length without ``least`` texts takes
the margin of the nearest that has.

``fit`` collects at most ``excerpts`` excerpts of ``excerpt_chars`` code
points for each of at most ``languages`` languages (about 100 KB a language):
a documented bound, not growing with the table.  Which texts are taken is
decided by a hash of the text, equal texts counting once; the excerpt's place
in the text by the same hash.  ``learning`` splits labelled rows for the two.
``fit_margins`` scores every whole text it is given, equal ones counting once; the
rates are running sums along the leads, over range-partitioned rows, and the
driver gets one margin a length.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
rejected; with no learned language every text is; with one, the score is 1;
ties go to the first language by name; repeated ids give repeated rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolens.operators.prefix import with_prefix

from .common import id_and_text, id_type, keep_rows

UNDETERMINED = "und"
BLOCK = 8192  # code points compressed at a time
_OTHER = re.compile(r"[\W\d_]+")


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    excerpts: int = 256,
    excerpt_chars: int = 400,
    languages: int = 400,
) -> dict[str, bytes]:
    """Dictionary content per language, by name."""
    texts = labelled.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.lower(F.col(text_col).cast("string")).alias("text"),
    ).filter("lang is not null and text rlike '\\\\p{L}'")
    room = F.greatest(F.char_length("text") - excerpt_chars, F.lit(0)) + 1
    taken = texts.select("lang", F.xxhash64("text").alias("h"), "text").select(
        "lang", "h", F.substring("text", F.pmod("h", room).cast("int") + 1, F.lit(excerpt_chars)).alias("excerpt")
    )
    taken = taken.withColumn("excerpt", F.regexp_replace("excerpt", r"\P{L}+", " "))
    once = taken.groupBy("lang", "h").agg(F.max("excerpt").alias("excerpt"))
    rows = once.withColumn("salt", F.spark_partition_id() % 16)
    for keys in (["lang", "salt"], ["lang"]):  # the least hashes of each salt first: no task sees a language whole
        least = Window.partitionBy(*keys).orderBy("h")
        rows = rows.withColumn("rank", F.row_number().over(least)).filter(F.col("rank") <= excerpts)
    found: dict[str, list] = {}
    for r in rows.limit(languages * excerpts + 1).collect():
        found.setdefault(r.lang, []).append((r.h, r.excerpt))
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages")
    return {lang: "\n".join(e for _, e in sorted(found[lang])).encode() for lang in sorted(found)}


def learning(labelled: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Labelled rows for the dictionaries (three quarters) and for the margins, by text."""
    fold = F.pmod(F.xxhash64(F.lit(3), F.col(text_col)), F.lit(4))
    return labelled.filter(fold != 0), labelled.filter(fold == 0)


def _size_class(letters: int) -> int:
    return max(letters, 1).bit_length()


def fit_margins(
    labelled: DataFrame,
    model: dict[str, bytes],
    text_col: str = "text",
    lang_col: str = "lang",
    rate: float = 0.98,
    slack: float = 0.5,
    tail: float = 0.01,
    least: int = 20,
) -> dict[int, float]:
    """The margin of each length class there are enough texts of."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(
        F.struct(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h")).alias("doc_id"), F.col(text_col).alias("text")
    )
    scored = predict(rows, model).select("doc_id.*", "lang_pred", "score", "letters").distinct()  # equal texts count once
    by_lead = scored.groupBy(F.length(F.bin(F.greatest("letters", F.lit(1)))).alias("size"), "score").agg(
        F.count("*").alias("n"), F.sum((F.col("lang_pred") == F.col("lang")).cast("long")).alias("right")
    )
    measures = {"n_before": F.col("n"), "right_before": F.col("right")}  # of greater leads
    placed, whole = with_prefix(by_lead, "size", -F.col("score"), measures)
    whole = whole.select("size", F.col("n_before").alias("n_all"), F.col("right_before").alias("right_all"))
    right = F.col("right_before") + F.col("right")
    often = F.when(F.col("right") > 0, right >= F.lit(rate) * (F.col("n_before") + F.col("right"))).otherwise(
        right >= F.lit(rate) * (F.col("n_before") + 1)
    )  # of equal leads the right ones come first
    usual = right >= F.greatest(F.floor(F.col("right_all") * F.lit(1 - tail)), F.lit(1))
    margins = (
        placed.join(F.broadcast(whole), "size")
        .filter(F.col("n_all") >= least)
        .groupBy("size", "n_all", "right_all")
        .agg(F.min(F.when(often, F.col("score"))).alias("accurate"), F.max(F.when(usual, F.col("score"))).alias("usual"))
        .select(
            "size",
            F.greatest(
                F.when(F.col("right_all") >= F.lit(rate) * F.col("n_all"), 0.0).otherwise(F.coalesce("accurate", F.lit(1.0))),
                F.lit(slack) * F.coalesce("usual", F.lit(0.0)),
            ).alias("margin"),
        )
    )
    return {r["size"]: r["margin"] for r in margins.collect()}  # a row per power of two


def margin_for(margins: dict[int, float] | float, letters: int) -> float:
    if isinstance(margins, float):
        return margins
    size = _size_class(letters)
    return margins[min(margins, key=lambda c: (abs(c - size), c))] if margins else 0.0


class Classifier:
    def __init__(self, model: dict[str, bytes], level: int = 9) -> None:
        import zstandard

        self._press = []
        for lang, content in model.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                level, source_size=BLOCK, dict_size=len(content), write_content_size=False, write_dict_id=False
            )
            data.precompute_compress(compression_params=params)
            press = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
            self._press.append((lang, press.compress))

    def __call__(self, text: str) -> tuple[str, float, int]:
        """Language, score, and letters (runs of others count as one)."""
        if not self._press or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0
        text = _OTHER.sub(" ", text.lower())
        if len(self._press) == 1:
            return self._press[0][0], 1.0, len(text)
        blocks = [text[i : i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        sizes = sorted((sum(len(press(b)) for b in blocks), lang) for lang, press in self._press)
        (best, lang), (second, _) = sizes[:2]
        return lang, 1 - best / second, len(text)


def predict(
    docs: DataFrame,
    model: dict[str, bytes],
    margin: dict[int, float] | float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score, rejected, letters`` per row."""
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[0] == UNDETERMINED or f[1] < margin_for(margin, f[2]) for f in found], pa.bool_()),
                pa.array([f[2] for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected", "letters"])

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, lang_pred string, score double, rejected boolean, letters long")


def accepted(docs: DataFrame, model: dict[str, bytes], margin: dict[int, float] | float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        classify = Classifier(shared.value)

        def keep(text: str) -> bool:
            lang, score, letters = classify(text)
            return lang != UNDETERMINED and score >= margin_for(margin, letters)

        return keep

    return keep_rows(docs, text_col, judge)
