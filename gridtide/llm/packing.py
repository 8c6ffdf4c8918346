"""Bound-certified best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.tables import stored
from gridtide.llm.tokens import encoder

GROUP = 8192  # pieces that one task packs together
MERGED = 8  # groups with a gap that exchange their pieces
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", part long, sequence_id long, offset long"


def pieces(
    docs: DataFrame, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """One row per piece of each document: ids of the whole text, then ``end_id``.

    A document of more than ``length`` ids is cut into pieces of exactly ``length``; what does not divide
    goes to its first piece. Null text counts as empty, giving one piece with the end id alone. Rows with
    the same id, or without one, are each cut for themselves. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode.ids(texts), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    start, number = 0, 0
                    stop = (n - 1) % length + 1
                    while start < n:
                        rows.append((doc, number, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, number = stop, stop + length, number + 1
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def least_bins(counts: np.ndarray) -> int:
    """A number of bins that no packing can undercut; ``counts[s]`` items have size s, the last size fills a bin.

    Takes the best of two families of dual-feasible functions. Such a function f keeps the sum of f over
    any full bin at one, so the sum over all items is a lower bound.
    """
    full = len(counts) - 1
    size = np.arange(full + 1)
    items = counts.astype(np.int64)
    best = -(-int((items * size).sum()) // full)
    up = np.cumsum(items[::-1])[::-1]
    mass = np.concatenate([[0], np.cumsum(items * size)])
    for small in range(1, full // 2 + 1):  # sizes over full - small count as full, those under small as none
        large = int(up[full - small + 1])
        between = int(mass[full - small + 1] - mass[small])
        best = max(best, large + -(-between // full))
    for k in range(1, 21):
        grown = (k + 1) * size
        worth = np.where(grown % full == 0, size * k, (grown // full) * full)  # times k
        best = max(best, -(-int((items * worth).sum()) // (full * k)))
    return best


def best_fit(sizes: np.ndarray, full: int) -> np.ndarray:
    """Bin of each size by best-fit decreasing. The fullest bin with room is found from a bit set of the rooms."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(full + 1)]
    rooms, made = 0, 0
    for at, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, number, made = full, made, made + 1
        bins[at] = number
        room -= size
        if room:
            open_bins[room].append(number)
            rooms |= 1 << room
    return bins


def _placed(frame: pd.DataFrame, bins: np.ndarray, part: int) -> pd.DataFrame:
    """Bins and offsets of a group; bins are numbered within ``part``."""
    frame = frame.assign(sequence_id=bins + (np.int64(part) << 24), part=np.int64(part))
    order = np.lexsort((frame["piece"], frame["doc_id"].fillna(-1), -frame["length"], frame["sequence_id"]))
    frame = frame.iloc[order]
    lengths = frame["length"].to_numpy()
    before = np.cumsum(lengths) - lengths
    first = np.concatenate([[True], np.diff(frame["sequence_id"].to_numpy()) != 0])
    return frame.assign(offset=before - np.maximum.accumulate(np.where(first, before, 0)))


def pack(cut: DataFrame, length: int = 1024, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``cut`` (rows of :func:`pieces`) with ``sequence_id`` and gapless ``offset``.

    Pieces are dealt by hash into groups of about ``group`` and packed by best-fit decreasing. A group
    whose bins equal its dual-feasible lower bound is optimal; it gives away only bins that are half empty,
    which the rounding of its bound hides. From the others all bins with room left are opened. Groups are
    merged ``MERGED`` by ``MERGED``, their opened pieces packed again, and the new packing is taken if it has
    fewer bins. Groups stay bounded: a merged group holds the opened bins of ``MERGED`` groups. Hashing also deals the pieces of equal documents apart, so no
    source or copy makes a group large. An empty table gives an empty one.
    """
    parts = max(1, -(-cut.count() // group))
    # equal rows are told apart by their place in the stored table
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))

    def pack_group(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy()
        part = int(frame["part"].iloc[0])
        bins = best_fit(sizes, length)
        gap = bins.max() + 1 - least_bins(np.bincount(sizes, minlength=length + 1))
        return _placed(frame, bins, part).assign(gap=gap)[columns]

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "sequence_id", "offset", "gap"]
    now = stored(dealt.groupBy("part").applyInPandas(pack_group, PACKED + ", gap long"), "pack")
    done = []
    base = parts
    for number in range(rounds):
        parts = max(1, -(-parts // MERGED))
        fill = now.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        marked = now.join(fill, "sequence_id").withColumn("opened", F.expr(f"fill < {length} and (gap > 0 or 2 * fill <= {length})"))
        done.append(marked.where("not opened").select(*columns[:-1]))
        opened = marked.where("opened").withColumn("part", F.lit(base) + F.pmod(F.col("part"), F.lit(parts)))

        def again(frame: pd.DataFrame) -> pd.DataFrame:
            sizes = frame["length"].to_numpy()
            bins = best_fit(sizes, length)
            gap = bins.max() + 1 - least_bins(np.bincount(sizes, minlength=length + 1))
            if bins.max() + 1 < frame["sequence_id"].nunique():
                frame = _placed(frame, bins, int(frame["part"].iloc[0]))
            return frame.assign(gap=gap)[columns]

        now = stored(opened.groupBy("part").applyInPandas(again, PACKED + ", gap long"), "pack")
        base += parts
        if parts == 1:
            break
    result = now.select(*columns[:-1])
    for rest in done:
        result = result.union(rest)
    return result.drop("part")


def packed_documents(docs: DataFrame, length: int = 1024, tokenizer: str | None = None, group: int = GROUP) -> DataFrame:
    return pack(stored(pieces(docs, length, tokenizer=tokenizer), "pieces"), length, group)
