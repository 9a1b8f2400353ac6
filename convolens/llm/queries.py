"""Thin registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_reuse, kneser_ney, language_id, token_counts, token_files
from .common import documents
from .decontaminate import contamination, hit_spans
from .exact_dedup import exact_dedup
from .line_dedup import line_counts, line_dedup
from .sharding import shard_documents
from .simhash import near_groups
from .source_divergence import source_divergence
from .token_align import align
from .url_reputation import judge_urls
from .vocab import tokenizer_path

#: Word shingle length and largest bit distance of the near-duplicate contract.
SHINGLE, MAX_BITS = 3, 3
SHARDS = 16
SPAN = 10  # words of a benchmark window
WORD_BPE, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def fold(id_col: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), SHINGLE, MAX_BITS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words, held = language_id.learning(docs.filter(fold("doc_id", 4) != 2))
    model = language_id.fit(words)
    return language_id.predict(docs, model, language_id.fit_margins(held, model)).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = kneser_ney.train(docs.filter(fold("doc_id", 5) != 1))
    return kneser_ney.score(docs, model).withColumn("held_out", fold("doc_id", 5) == 1)


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.digests(chunk_reuse.encode_decode(documents(spark, sf_dir), tokenizer_path(WORD_BPE)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(hit_spans(documents(spark, sf_dir), benchmark, SPAN))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(documents(spark, sf_dir), tokenizer_path(WORD_BPE), END_ID)
    return token_files.read_documents(spark, path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), SHARDS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(
        documents(spark, sf_dir), tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN, ["text"]
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(line_dedup(documents(spark, sf_dir)))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_url_reputation": op5_url_reputation,
    "op6_chunk_bpe": op6_chunk_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_token_files": op8_token_files,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_alignment": op12_token_alignment,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE = {
    "op1_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT norm, count(*) AS group_size, max(chars) AS keep_chars, arg_min(doc_id, (-chars, doc_id)) AS keep_id
  FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND chars = keep_chars AS kept, sha256(norm) AS text_sha256
FROM n JOIN w USING (norm)
""",
    "op5_url_reputation": r"""
WITH parsed AS (
  SELECT page_id,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT s.page_id, s.host, s.path,
         arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS rule_verdict
  FROM (SELECT *, row_number() OVER () AS row_no FROM split) s
  LEFT JOIN rules ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY s.row_no, s.page_id, s.host, s.path
), hosts AS (
  SELECT host, count(rule_verdict) AS n, count(*) FILTER (rule_verdict = 'block') AS bad,
         string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS labels
  FROM judged GROUP BY host
), named AS (
  SELECT host, n, bad, array_to_string(labels[-2:], '.') IN
           ('ac.uk', 'co.jp', 'co.uk', 'com.ar', 'com.au', 'com.br', 'com.mx', 'gov.uk', 'org.uk') AS two,
         array_to_string(CASE WHEN two THEN labels[-3:] ELSE labels[-2:] END, '.') AS domain,
         array_to_string(CASE WHEN two THEN labels[-2:] ELSE labels[-1:] END, '.') AS suffix
  FROM hosts
), base AS (
  SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS m FROM named
), s_units AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT m FROM base) AS m FROM named GROUP BY suffix
), s_strength AS (
  SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
           THEN (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) ELSE 0.5 END, 0.001), 0.999) - 1 AS k
  FROM s_units
), s_rate AS (
  SELECT suffix, (m * k + bad) / (k + n) AS m FROM s_units, s_strength
), d_units AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(r.m) AS m FROM named JOIN s_rate r USING (suffix) GROUP BY domain, suffix
), d_strength AS (
  SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
           THEN (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) ELSE 0.5 END, 0.001), 0.999) - 1 AS k
  FROM d_units
), d_rate AS (
  SELECT domain, suffix, (m * k + bad) / (k + n) AS m FROM d_units, d_strength
), h_units AS (
  SELECT host, n, bad, r.m AS m FROM named JOIN d_rate r USING (domain, suffix)
), h_strength AS (
  SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
           THEN (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) ELSE 0.5 END, 0.001), 0.999) - 1 AS k
  FROM h_units
), h_post AS (
  SELECT host, n AS labelled, bad, m * k + bad AS a, (1 - m) * k + n - bad AS b FROM h_units, h_strength
)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
                                   THEN 'block' ELSE 'allow' END) AS verdict,
       labelled, bad
FROM judged JOIN h_post USING (host)
""",
    "op7_decontamination": r"""
WITH words AS (
  SELECT 'doc' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark
), split AS (
  SELECT row_number() OVER () AS row_no, side, id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM words
), item_windows AS (
  SELECT id AS item_id, n, list_slice(ws, i, i + n - 1) AS win
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM (SELECT id, ws, least(10, len(ws)) AS n FROM split WHERE side = 'item') WHERE n > 0)
), doc_windows AS (
  SELECT row_no, n, i, list_slice(ws, i, i + n - 1) AS win
  FROM (SELECT row_no, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM split, (SELECT DISTINCT n FROM item_windows) WHERE side = 'doc' AND len(ws) >= n)
), met AS (
  SELECT row_no, i, d.n AS n, item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win
), hit AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM met) GROUP BY row_no
), found AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY row_no
)
SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit USING (row_no) LEFT JOIN found USING (row_no) WHERE side = 'doc'
""",
    "op11_source_divergence": r"""
WITH split AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), said AS (
  SELECT row_no, lang, source, term, count(*) AS n FROM (SELECT row_no, lang, source, unnest(ws) AS term FROM split) GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS c FROM said GROUP BY lang, term HAVING count(*) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM split
), counted AS (
  SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS c FROM said JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counted USING (lang, source) GROUP BY g.lang, g.source
), probs AS (
  SELECT s.lang, s.source, k.term, coalesce(d.c, 0) AS c,
         CAST(1 + (1000000000::HUGEINT * (coalesce(d.c, 0) + 1)) // (s.n + l.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS BIGINT) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted d ON d.lang = s.lang AND d.source = s.source AND d.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM probs WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op13_line_dedup": r"""
WITH lines AS (
  SELECT row_no, doc_id, n_lines, unnest(ls) AS line, unnest(range(n_lines)) AS pos
  FROM (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, len(ls) AS n_lines FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row_no) >= 3
), judged AS (
  SELECT k.*, r.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS lost FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY row_no, doc_id, n_lines
""",
}
