"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridtide")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the operators rely on: UTC wall time, AQE and Arrow transfer."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, per_task: int = 128 << 20) -> int:
    """Shuffle partitions for an input size; AQE merges the small ones again.

    The default of 200 leaves gigabytes per task on a large input.
    """
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(100_000, max(current, -(-input_bytes // per_task)))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure reliable checkpoints have a folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local master gets a
    temporary folder when nothing is set; a cluster without one is an error,
    since a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="gridtide-ckpt-")
        context.setCheckpointDir(folder)


def cut_lineage(df):
    """Reliable checkpoint of a DataFrame, for plans that would grow round by round."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
