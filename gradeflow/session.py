"""Spark session helpers.

On a cluster the session is built by the launcher and already names a
shared ``spark.checkpoint.dir``; we only read it.  Tests and local runs get
a scratch checkpoint folder because nothing set one.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DICTIONARY_BYTES = 4 << 20  # of a column's distinct values in a row group of a table of rounded numbers

# Shuffle-partition count is sized for the test box; on a cluster set
# spark.sql.shuffle.partitions from the launcher (AQE coalesces anyway).
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: str | int = "*", app: str = "gradeflow") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder that the session names.  A scratch folder is
    made only for a session whose tasks run in this process (``local[n]``);
    elsewhere a missing setting is an error, as no other folder is shared."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="gradeflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def keep_dictionaries(spark: SparkSession, size: int = DICTIONARY_BYTES) -> None:
    """Where the session names no dictionary size for Parquet, tables written from now
    on keep ``size`` bytes of a column's distinct values in a row group.  Numbers of six
    decimals repeat, but not within the writer's default of 1 MB, beyond which it
    stores each as it is.  A size that the session or the writer names holds."""
    key = "parquet.dictionary.page.size"
    if spark.conf.get(key, None) is None and spark.sparkContext.getConf().get(f"spark.hadoop.{key}", None) is None:
        spark.conf.set(key, str(size))
