"""Reading tables, shared scratch space and bounded Arrow chunks for the operators of this folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridtide.session import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the reliable checkpoints, which driver and executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/gridtide-{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Later steps neither recompute them nor depend on the executors that made them.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark, name)
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of frames that nothing refers to any more.

    The cleaner acts when the driver's heap is collected, which on an idle driver may be hours away.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts as (first row, UTF-8 bytes, offsets with one more entry than rows).

    A run holds about ``most_bytes``; only a single longer text makes it larger. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def discard(frame: DataFrame) -> None:
    """Deletes the files of a frame made by :func:`stored` once no later step reads it."""
    spark = frame.sparkSession
    own = spark.sparkContext.getCheckpointDir()
    for file in frame.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if "/gridtide-" in folder and own and folder.rsplit("/", 1)[0].split("/")[-1] == own.rstrip("/").split("/")[-1]:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
