"""SimHash fingerprints, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.components import components
from gridtide.llm.tables import free_name, stored
from gridtide.llm.words import LOWER_BYTES

SMALL = 32  # signatures shared by at most so many fingerprints are joined row by row
BLOCK = 1024  # fingerprints of a crowded signature compared at once


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash (as a signed number) of a text's word shingles, repeats included."""
    found = text.encode().translate(LOWER_BYTES).split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(found) - words + 1)
    spans = map(slice, start[:n].tolist(), end[len(found) - n :].tolist())
    total, done = np.zeros(64, np.int64), 0
    while done < n:  # long texts in pieces, to keep the bits of few shingles in memory
        some = min(n - done, 1 << 16)
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, (next(spans) for _ in range(some))), repeat(42)), np.uint64, some)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += some
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` of whole texts; null and blank texts have fingerprint 0. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                marks = [fingerprint(t or "", words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def signatures(marks: DataFrame) -> DataFrame:
    """``sig``, ``bit``, ``fp`` of distinct fingerprints.

    Three differing bits over two halves leave one half with at most one. So each half is indexed as it is
    and with each of its 32 bits as a wildcard: two fingerprints link only if they agree on a half, or on
    a half with one wildcard where they hold different bits. ``sig`` packs half, wildcard (32: none) and
    the rest of the half; ``bit`` is the value under the wildcard, -1 without one.
    """
    half = F.explode(F.array(F.struct(F.lit(0).alias("no"), F.expr("shiftrightunsigned(fp, 32)").alias("v")), F.struct(F.lit(1).alias("no"), F.expr("fp & 4294967295").alias("v"))))
    rows = marks.select("fp", half.alias("half")).select("fp", "half.*", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("at"))
    wild = F.expr("if(at < 32, v & ~shiftleft(1L, at), v)")
    sig = F.expr("shiftleft(cast(no as bigint), 40)") + F.expr("shiftleft(cast(at as bigint), 33)") + wild
    return rows.select(sig.alias("sig"), F.expr("if(at < 32, cast(shiftright(v, at) & 1 as int), -1)").alias("bit"), "fp")


def links(marks: DataFrame, distance: int = 3) -> DataFrame:
    """``a``, ``b`` edges that connect exactly the fingerprints (distinct, column ``fp``) at ``distance`` 3 or fewer.

    Signatures held by one fingerprint, or with one value under the wildcard, are dropped after a count that
    combines before its shuffle. Up to ``SMALL`` holders are joined pair by pair. More are dealt by hash into
    blocks of about ``BLOCK``; each pair of blocks is a group of its own that is compared in numpy and gives
    a spanning forest of its links, not all pairs. Nothing is capped.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one wildcard find up to 3 differing bits")
    rows = signatures(marks)
    held = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("bit").alias("low"), F.max("bit").alias("high"))
    held = held.where("n > 1 and (low < 0 or low < high)").select("sig", "n")
    # merged: the table of a broadcast would take many times the space its rows do
    shared = stored(rows.join(held.hint("merge"), "sig"), "simhash-shared")
    few = shared.where(F.col("n") <= SMALL).select("sig", "bit", "fp")
    near = few.alias("x").join(few.alias("y"), F.expr(f"x.sig = y.sig and x.fp < y.fp and (x.bit < 0 or x.bit <> y.bit) and bit_count(x.fp ^ y.fp) <= {distance}"))
    near = near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    many = shared.where(F.col("n") > SMALL).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bit", "fp")

    def forest(frame: pd.DataFrame) -> pd.DataFrame:
        return _forest(frame["fp"].to_numpy(np.int64), frame["bit"].to_numpy(), distance)

    crowded = many.groupBy("sig", "i", "j").applyInPandas(forest, "a long, b long")
    return near.union(crowded).distinct()


def _forest(fp: np.ndarray, bit: np.ndarray, distance: int) -> pd.DataFrame:
    """Each fingerprint's smallest reachable one within the group, as edges.

    Goes through one row of the comparison at a time and lowers labels until they stand.
    """
    fp, at = np.unique(fp, return_index=True)
    bit = bit[at]
    label = np.arange(len(fp))
    sides = [(np.arange(len(fp)), np.arange(len(fp)))] if (bit < 0).all() else [(np.flatnonzero(bit == 0), np.flatnonzero(bit == 1))]
    x, y = sides[0]
    if len(x) and len(y):
        near = np.bitwise_count((fp[x][:, None] ^ fp[y][None, :]).view(np.uint64)) <= distance
        row, column = np.nonzero(near)
        u, v = x[row], y[column]
        while True:
            before = label.copy()
            np.minimum.at(label, u, label[v])
            np.minimum.at(label, v, label[u])
            label = label[label]
            if (label == before).all():
                break
    linked = label != np.arange(len(fp))
    return pd.DataFrame({"a": fp[label[linked]], "b": fp[linked]})


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable through links).

    One row per row of ``docs``. Documents with equal fingerprints are one class from the start, so copies are
    never paired. Null and blank texts share fingerprint 0. A row without id takes the component of its
    class but never names it. An empty table gives an empty one.
    """
    marked = stored(fingerprints(docs, words, id_col, text_col), "simhash")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(classes.select("fp"), distance))
    labelled = classes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_mark = labelled.join(named, "label").select("fp", "component_id")
    return marked.join(of_mark, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` (all columns) with one row of each component: the one of the smallest id.

    Judged are rows: one without id or with a repeated one by its own text. A row without id stays only if its whole component
    has none; of several rows with the smallest id any one stays.
    """
    n, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        kept = near_duplicates(docs, words, distance).where("doc_id = component_id").select("doc_id")
        return docs.join(kept.hint("merge"), "doc_id", "left_semi")
    row = free_name(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, words, distance, id_col=row).select(F.col("doc_id").alias("r"), "component_id")
    own = numbered.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("own"))
    least = found.join(own.hint("merge"), "r").groupBy("component_id").agg(F.min(F.struct(F.isnull("own").alias("none"), "own", "r")).alias("least"))
    return numbered.join(least.select(F.col("least.r").alias(row)).hint("merge"), row, "left_semi").select(*docs.columns)
