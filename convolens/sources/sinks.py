"""Sinks: K1-K5, K7, K10.

Writes go through Spark's commit protocol (task output is published once, so
a retried task after a lost executor does not duplicate rows).  "Latest" is the
newest manifest of a versioned table, not a symbolic link: a run is seen whole
or not at all (``sources/versioned.py``).
"""

from __future__ import annotations

import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from convolens.operators.report import export_prep
from convolens.sources.versioned import VersionedTable

log = logging.getLogger(__name__)


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = True) -> str:
    """K1: header, UTF-8 with a byte-order mark (it leads each file's header),
    minimal quoting with '"' escaped by '"', nulls as ''."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", "").csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K2: JSON records (one object per line), ISO timestamps."""
    df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)
    return path


WRITERS = {"csv": write_csv, "json": write_json}


def export_formats(setting) -> list[str]:
    """K4: csv always; 'json' adds json; 'all' = csv + json; a list adds its json."""
    formats = ["csv"]
    if isinstance(setting, str):
        s = setting.lower()
        if s == "all":
            return ["csv", "json"]
        if s == "json":
            formats.append("json")
    elif isinstance(setting, (list, tuple)):
        for f in setting:
            if str(f).lower() == "json" and "json" not in formats:
                formats.append("json")
    return formats


def export_data(df: DataFrame, out_dir: str, base: str, formats: list[str], columns: list[str] | None = None) -> dict[str, str]:
    """K3: write one output per format.  Unknown formats are skipped with a
    warning; none valid is an error; one format failing does not stop the
    others.  The prepared frame is persisted so formats share one computation."""
    valid = [f for f in formats if f in WRITERS]
    for f in formats:
        if f not in WRITERS:
            log.warning("unknown export format %r ignored", f)
    if not valid:
        raise ValueError(f"no valid export format in {formats}")
    prepared = export_prep(df, columns).persist()
    paths = {}
    try:
        for f in valid:
            try:
                paths[f] = WRITERS[f](prepared, f"{out_dir}/{base}.{f}")
            except Exception as exc:  # keep going with the other formats
                log.error("export to %s failed: %s", f, exc)
    finally:
        prepared.unpersist()
    return paths


def run_stamp(now: datetime | None = None) -> str:
    """K5: run id ``YYYY-MM-DDTHH-MM``."""
    now = now or datetime.now(timezone.utc)
    return now.strftime("%Y-%m-%dT%H-%M")


def write_versioned(df: DataFrame, path: str, run_ts: str | None = None) -> str:
    """K5: write one run and make it the latest.  A run that died is never
    seen; one that is written twice under its id is there once."""
    run_ts = run_ts or run_stamp()
    VersionedTable(df.sparkSession, path).replace(df, token=run_ts, run_ts=run_ts)
    return path


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest run."""
    rows = VersionedTable(spark, path).read()
    if rows is None:
        raise FileNotFoundError(f"no run was written to {path}")
    return rows


def read_run(spark: SparkSession, path: str, run_ts: str) -> DataFrame:
    """K5: the run of a given id."""
    table = VersionedTable(spark, path)
    for number in reversed(table.numbers()):
        if table.manifest(number).notes.get("run_ts") == run_ts:
            return table.read(number)
    raise FileNotFoundError(f"no run {run_ts} in {path}")


def write_errors(errors: DataFrame, path: str, run_ts: str) -> str:
    """K6: the error side-output, versioned like the main output."""
    return write_versioned(errors, path, run_ts)


def report_step(spark: SparkSession, results_path: str, out_dir: str, recipe, fmt_setting="csv") -> dict[str, str]:
    """Read the newest merged result, project to the recipe's output
    columns, export."""
    df = read_latest(spark, results_path)
    return export_data(df, out_dir, f"{recipe.name}_report", export_formats(fmt_setting), list(recipe.output_columns))
