"""File and query sources: S1, S4-S10.

All readers return lazy DataFrames with explicit schemas (phones are always
text: no inference that would drop leading zeros).
"""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolens.functions.phones import phone_last10_strict
from convolens.functions.timefmt import parse_ts_month_first
from convolens.sources.stage import staged
from convolens.sources.tables import MESSAGE_SCHEMA
from convolens.sources.versioned import VersionedTable

log = logging.getLogger(__name__)

_PLACEHOLDER = re.compile(r"%\((\w+)\)s")

LEAD_COLUMNS = ["lead_id", "user_id", "clean_email", "name", "last_name", "cleaned_phone", "lead_created_at"]


def parameterised_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """``%(name)s`` placeholders become Spark named parameters (``:name``)
    bound by ``spark.sql(sql, args)`` — values are never spliced into the text.
    A placeholder without a value is an error before anything runs."""
    if not sql or not sql.strip():
        raise ValueError("empty query")
    params = params or {}
    names = _PLACEHOLDER.findall(sql)
    missing = sorted(set(names) - set(params))
    if missing:
        raise KeyError(f"query parameters without a value: {missing}")
    text = _PLACEHOLDER.sub(lambda m: f":{m.group(1)}", sql)
    args = {k: (F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v)
            for k, v in params.items() if k in names}
    return spark.sql(text, args=args) if args else spark.sql(text)


def query_from_file(spark: SparkSession, path: str, params: dict | None = None) -> DataFrame:
    """S1 (file variant): an empty file is an error."""
    with open(path, encoding="utf-8") as fh:
        sql = fh.read()
    if not sql.strip():
        raise ValueError(f"query file {path} is empty")
    return parameterised_query(spark, sql, params)


def fetch_batches(keys: DataFrame, fetch: Callable[[list], Iterable[tuple]], schema: str, batch_size: int = 500,
                  concurrency: int = 10) -> tuple[DataFrame, DataFrame]:
    """S3: rows of a source that is asked by batches of keys.

    ``keys`` (one column) are made distinct and dealt to ``concurrency`` tasks,
    each of which calls ``fetch(batch)`` for up to ``batch_size`` keys at a time;
    it gives tuples of ``schema``.  A batch that raises is logged as a row and
    left out; it is an error only if every batch failed.  Returns the rows and
    the failures ``(keys, error)``.  The result is stored, so the source is asked
    once however often the frames are read (a lost task asks again)."""
    key = keys.columns[0]
    names = T.StructType.fromDDL(schema).fieldNames()
    kept = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct().repartition(concurrency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def asked(batch: list) -> pd.DataFrame:
            try:
                rows = [dict(zip(names, r)) for r in fetch(batch)]
                out = [{"row": r, "keys": None, "error": None} for r in rows]
                return pd.DataFrame([*out, {"row": None, "keys": [str(k) for k in batch], "error": None}])
            except Exception as exc:  # this batch only
                return pd.DataFrame([{"row": None, "keys": [str(k) for k in batch], "error": f"{type(exc).__name__}: {exc}"}])

        for frame in frames:
            held += frame["key"].tolist()
            while len(held) >= batch_size:
                yield asked(held[:batch_size])
                held = held[batch_size:]
        if held:
            yield asked(held)

    answers = staged(kept.mapInPandas(run, f"row struct<{schema}>, keys array<string>, error string"), "fetched")
    batches = answers.where(F.col("keys").isNotNull())
    counts = batches.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"), F.first("error", True).alias("error")).first()
    if counts["n"] and counts["n"] == counts["failed"]:
        raise RuntimeError(f"all {counts['n']} batches failed; one of them: {counts['error']}")
    if counts["failed"]:
        log.warning("%d of %d batches failed; one of them: %s", counts["failed"], counts["n"], counts["error"])
    rows = answers.where(F.col("row").isNotNull()).select("row.*")
    return rows, batches.where(F.col("error").isNotNull()).select("keys", "error")


def read_leads_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Header CSV with every column as text; required columns are checked
    against the header; an empty file gives an empty frame with those columns."""
    required = required or ["cleaned_phone"]
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if not df.columns:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in required]))
    df = df.toDF(*[c.removeprefix("\ufeff").strip() for c in df.columns])
    if "cleaned_phone_number" in df.columns and "cleaned_phone" not in df.columns:
        df = df.withColumnRenamed("cleaned_phone_number", "cleaned_phone")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"lead file {path} lacks required columns {missing}")
    return df


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose quoted fields may hold newlines, split over tasks like any text.

    A line begins a record if the number of quotes before it is even.  Each
    block of the file (a task's byte range) counts its quotes and its possible
    records; running sums over the blocks (one row each) and inside a block tell
    the record every line belongs to.  Text columns as in the header, and
    ``record_no``, ascending in the order of files and records (the header of
    the first file is 0)."""
    names = [c.removeprefix("\ufeff") for c in spark.read.option("header", True).csv(path).columns]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
    place = F.monotonically_increasing_id()
    lines = lines.withColumns({"place": place, "quotes": F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))})

    # quotes before each block, then the records that begin in it
    blocks = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("file", "block").orderBy("place")
    before = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = lines.withColumn("odd", before % 2)
    blank = F.trim("line").isin("", "\r")
    counted = parts.groupBy("file", "block").agg(
        F.sum("quotes").alias("q"),
        F.count_if((F.col("odd") == 0) & ~blank).alias("even"), F.count_if((F.col("odd") == 1) & ~blank).alias("odd"),
    )
    counted = counted.withColumn("inside", F.coalesce(F.sum("q").over(of_file), F.lit(0)) % 2)
    counted = counted.withColumn("n", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    offsets = counted.select("file", "block", "inside", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("earlier"))

    met = parts.join(offsets, ["file", "block"]).withColumn("begins", (F.col("odd") == F.col("inside")) & ~blank)
    inner = (F.col("odd") != F.col("inside"))
    run = F.sum(F.col("begins").cast("long")).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("record_no", F.col("earlier") + run - 1).where(F.col("begins") | inner)
    held = F.array_sort(F.collect_list(F.struct("block", "place", "line")))
    text = F.regexp_replace(F.array_join(F.transform(held, lambda x: x["line"]), "\n"), r"\r$", "")
    records = met.groupBy("file", "record_no").agg(text.alias("text"))
    first = Window.partitionBy("file").orderBy("block")
    heads = offsets.withColumn("place", F.row_number().over(first)).where("place = 1").select("file", F.col("earlier").alias("head"))
    body = records.join(heads, "file").where(F.col("record_no") != F.col("head"))
    fields = F.from_csv("text", ", ".join(f"`{c}` string" for c in names), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return body.select("record_no", fields.alias("f")).select("record_no", "f.*")


def read_messages_csv(spark: SparkSession, path: str) -> DataFrame:
    """Message CSV (quoted fields may hold newlines); ``cleaned_phone``
    as text, ``creation_time`` parsed per value (mixed formats allowed); without
    a ``src_ord`` column rows are numbered in file order."""
    raw = read_quoted_csv(spark, path)
    if "cleaned_phone_number" in raw.columns and "cleaned_phone" not in raw.columns:
        raw = raw.withColumnRenamed("cleaned_phone_number", "cleaned_phone")
    from convolens.functions.timefmt import parse_ts

    position = F.col("src_ord") if "src_ord" in raw.columns else F.col("record_no")  # the file's order
    return raw.select(
        F.col("cleaned_phone").cast("string").alias("cleaned_phone"), position.cast("long").alias("src_ord"),
        parse_ts("creation_time").alias("creation_time"), "msg_from", "message",
    )


def read_records_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON array of objects or a single object (one row); multi-line."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def prepare_sheet_leads(df: DataFrame, date_col: str, phone_col: str, mapping: dict[str, str],
                        as_of: str | None = None, lookback_days: int | None = None) -> DataFrame:
    """S7 + P4 + P12 + P22: drop all-empty rows, trim headers, require the date
    and phone columns, parse dates month-first (unparsable rows dropped),
    normalise phones (rule C, empty rows dropped), map to lead columns (absent -> '')."""
    df = df.toDF(*[c.strip() for c in df.columns]).na.drop(how="all")
    for c in (date_col, phone_col):
        if c not in df.columns:
            raise ValueError(f"sheet lacks required column {c!r}")
    ts = parse_ts_month_first(date_col)
    df = df.withColumn("__ts", ts).where(F.col("__ts").isNotNull())
    if lookback_days is not None and as_of is not None:
        df = df.where(F.col("__ts") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    df = df.withColumn("cleaned_phone", phone_last10_strict(phone_col)).where(F.col("cleaned_phone") != "")
    out = [F.col("cleaned_phone"), F.date_format("__ts", "yyyy-MM-dd HH:mm:ss").alias("lead_created_at")]
    for target, source in mapping.items():
        if target in ("cleaned_phone", "lead_created_at"):
            continue
        out.append((F.coalesce(F.col(source).cast("string"), F.lit("")) if source in df.columns else F.lit("")).alias(target))
    return df.select(*out)


def empty_messages(spark: SparkSession) -> DataFrame:
    """The header-only message table used when there are no target phones."""
    return spark.createDataFrame([], MESSAGE_SCHEMA)


def load_leads(spark: SparkSession, recipe, params: dict | None = None, base_dir: str = ".",
               queries: dict[str, Callable[[], DataFrame]] | None = None) -> DataFrame:
    """Lead source by recipe.  A warehouse recipe names a lead query: one of
    ``queries`` (DataFrame plans by name), a ``.sql`` file under ``base_dir``
    (a missing file is an error) or the SQL text itself; others read a CSV."""
    if recipe.lead_source not in ("redshift", "bigquery"):
        return read_leads_csv(spark, os.path.join(base_dir, recipe.lead_path or "leads.csv"))
    wanted = recipe.lead_sql
    if not wanted:
        raise ValueError(f"recipe {recipe.name}: {recipe.lead_source} source needs a query")
    if queries and wanted in queries:
        return queries[wanted]()
    if wanted.endswith(".sql"):
        return query_from_file(spark, os.path.join(base_dir, wanted), params)
    if len(wanted.split()) < 2:
        raise ValueError(f"recipe {recipe.name}: unknown lead query {wanted!r}")
    return parameterised_query(spark, wanted, params)


def daily_extract(spark: SparkSession, path: str, day: str, compute) -> DataFrame:
    """Reuse the day's stored extract when present; otherwise compute,
    store it as the latest version, and read it back.  If computing fails, fall
    back to the newest stored extract.  An extract is seen whole or not at all."""
    table = VersionedTable(spark, path)
    if table.manifest().notes.get("day") == day:
        return table.read()
    try:
        table.replace(compute(), day=day)
    except AnalysisException:
        raise
    except Exception:
        stored = table.read()
        if stored is None:
            raise
        return stored
    return table.read()


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Concatenate chunks by column name (missing columns become null)."""
    if not chunks:
        raise ValueError("nothing to concatenate")
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
