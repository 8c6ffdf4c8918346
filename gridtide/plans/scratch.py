"""Folders for queries that go through files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared space; a local session may use its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix=f"gridtide-{name}-")
    return f"{shared.rstrip('/')}/gridtide-{name}-{uuid.uuid4().hex}"
