"""Session helpers: the runtime settings every plan in this package assumes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# The clock used by every time-relative feature when the caller passes none.
# A plan never reads the wall clock: "now" is a parameter (see SURVEY §7.4 #1).
AS_OF_DEFAULT = "2024-01-05 00:00:00"

# Session-level SQL settings (all runtime-modifiable).  Timestamps without a
# zone are UTC; AQE re-plans joins/aggregations from runtime statistics, splits
# skewed join partitions even when that costs an extra exchange (the exchange
# then only carries partial aggregates), and coalesces small shuffle partitions.
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this package relies on (idempotent)."""
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_spark(
    app: str = "convolens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
) -> SparkSession:
    """Build (or reuse) a session.  On a cluster pass ``master=None`` and let
    spark-submit decide; locally tests use ``local[*]`` with 8 partitions."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune_session(spark)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system path
    the cluster names).  Only a local master may leave it unset, as tests do;
    a scratch folder is then created.  Elsewhere a missing setting is an error:
    executors would not see a folder of the driver's machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder when the master is not local")
        path = tempfile.mkdtemp(prefix="convolens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was
    started from (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_convolens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="convolens-"), "convolens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._convolens_shipped = True
