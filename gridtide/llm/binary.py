"""Token ids as fixed-stride binary shards in a shuffled training order."""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridtide.llm.tables import discard, release, shared_folder, stored
from gridtide.llm.tokens import encoder
from gridtide.llm.words import mixed

MANIFEST = "slot long, shard long, byte_offset long, doc_id long, piece int, n_tokens int, ids_crc32 long"


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1, entry by entry.

    A balanced Feistel network permutes the next larger power of four; values that land outside are sent
    through again until they land inside (cycle walking), fewer than four times on average.
    """
    half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, end_id: int, tokenizer: str | None = None) -> DataFrame:
    """``split``, ``place``, ``doc_id``, ``piece``, ``n_tokens``, ``ids`` (16-bit): whole texts and ``end_id``, cut every ``length`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        split, place = TaskContext.get().partitionId(), 0
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    wide = np.frombuffer(ids + tail, "<u4")
                    if wide.max() > 0xFFFF:
                        raise ValueError("ids do not fit 16 bits")
                    short = wide.astype("<u2").tobytes()
                    for number, start in enumerate(range(0, len(short), 2 * length)):
                        some = short[start : start + 2 * length]
                        rows.append((split, place, doc, number, len(some) // 2, some))
                        place += 1
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["split", "place", "doc_id", "piece", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "split int, place long, doc_id long, piece int, n_tokens int, ids binary")


def training_shards(
    docs: DataFrame, folder: str, length: int = 256, key: int = 20240607, end_id: int = 50256, per_shard: int = 8192, waves: int = 4, tokenizer: str | None = None
) -> DataFrame:
    """Writes all documents as shards below ``folder`` and returns their manifest, one row per sequence.

    Sequences are numbered once, in a stored table. The permutation sends number i to slot ``feistel(i)`` of
    0..n-1, so the slots are dense and the order follows from ``key`` alone. Shard s holds slots s * ``per_shard``
    onwards, each ``length`` 16-bit little-endian ids wide; shorter sequences are filled up with ``end_id``.
    Reading shards one after another is reading in training order, and a reader resumes at any slot by
    seeking. A shard is a range of slots that one task writes whole. Shards are written in ``waves`` of consecutive ones,
    which bounds what is shuffled at once. A file is written beside its place and moved there; a shard that already lies there
    complete is left, so a job that is run again with the same input goes on where it stopped.

    Null text gives one sequence with the end id alone. Rows without id or with a repeated one are written
    like any other. An empty table gives no file and an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = stored(sequences(docs, length, end_id, tokenizer), "sequences")
    sizes = cut.groupBy("split").agg(F.count("*").alias("n"))  # one row per scan task
    before = sizes.select("split", (F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    before = stored(before.na.fill(0, ["before"]), "sequence-starts")
    n = cut.count()
    shards = -(-n // per_shard)

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    # told to be nondeterministic, it is evaluated once a wave; as part of the filter too it would be twice
    numbered = cut.join(before, "split").withColumn("slot", slot_of.asNondeterministic()(F.col("before") + F.col("place")))
    numbered = numbered.withColumn("shard", F.expr(f"slot div {per_shard}"))
    stride = 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        mine = f"{TaskContext.get().taskAttemptId()}"
        filler = np.array([end_id], "<u2").tobytes()
        now, held = None, bytearray()

        def close() -> None:
            if now is None:
                return
            path = posixpath.join(root, f"shard-{now:08d}.bin")
            if store.get_file_info(path).size == len(held):
                return
            aside = posixpath.join(root, f".shard-{now:08d}-{mine}")
            with store.open_output_stream(aside) as out:
                out.write(bytes(held))
            store.move(aside, path)

        for batch in batches:
            crc = []
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, held = shard, bytearray()
                held += ids + filler * ((stride - len(ids)) // 2)
                crc.append(zlib.crc32(ids))
            slot = batch.column("slot").to_numpy()
            offset = slot % per_shard * stride
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("shard"), pa.array(offset), batch.column("doc_id"), batch.column("piece"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                names=["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "ids_crc32"],
            )
        close()

    _make_folder(spark, folder)
    written = []
    for wave in range(waves):
        low, high = shards * wave // waves, shards * (wave + 1) // waves
        if low < high:
            some = numbered.where((F.col("shard") >= low) & (F.col("shard") < high)).drop("split", "place", "before")
            ordered = some.repartition(min(high - low, 2000), "shard").sortWithinPartitions("slot")
            written.append(stored(ordered.mapInArrow(write, MANIFEST), "manifest"))
            del ordered, some
            release(spark)
    discard(cut)
    result = spark.createDataFrame([], MANIFEST)
    for part in written:
        result = result.union(part)
    return result


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def shards_below_checkpoints(docs: DataFrame, **options) -> DataFrame:
    """:func:`training_shards` into a new folder of the shared space."""
    return training_shards(docs, shared_folder(docs.sparkSession, "shards"), **options)
