"""Regular series and their cut into bounded, overlapping chunks.

A long table ``(keys..., ts, value)`` becomes one row per step with a position. Jobs
that need neighbours work on chunks: fixed runs of positions plus a margin on both
sides, so a task sees a bounded array however long the series is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridtide.functions.timeparts import epoch_us, truncate

STEP_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}
CHUNK = 65536
PIECE = 10_000


def expand_runs(runs: DataFrame, start: str, steps: Column, width: Column, out: str) -> DataFrame:
    """One row per step of each run of ``steps`` times from ``start``, with the time as ``out``.

    Runs are cut into pieces first, so no array is longer than ``PIECE`` or the number of pieces.
    """
    pieces = runs.withColumn("_steps", steps.cast("bigint")).where(F.col("_steps") > 0)
    pieces = pieces.withColumn("_done", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_steps") - 1, F.lit(PIECE).cast("bigint"))))
    first = F.col(start) + width * F.col("_done")
    last = F.col(start) + width * (F.least(F.col("_done") + PIECE, F.col("_steps")) - 1)
    return pieces.withColumn(out, F.explode(F.sequence(first, last, width))).drop("_steps", "_done")


def regular_series(df: DataFrame, keys, ts: str, value: str, step: str = "hour", fill: float | None = 0.0) -> DataFrame:
    """Sum per step with absent steps filled: (keys, ts, pos, value, n), n being the series length.

    The table is read and shuffled once. Each summed step then fills the gap up to the
    next one; that window sees at most one row per step of a key's time span.
    """
    keys = list(keys)
    seconds = STEP_SECONDS[step]
    sums = (
        df.select(*keys, truncate(F.col(ts), step).alias("ts"), F.col(value).alias("_v"))
        .na.drop(subset=[*keys, "ts"])
        .groupBy(*keys, "ts")
        .agg(F.coalesce(F.sum("_v"), F.lit(fill)).alias("_sum"))
    )
    line = W.partitionBy(*keys).orderBy("ts")
    width = F.expr(f"interval {seconds} seconds")
    spans = sums.withColumns(
        {
            "_first": F.min("ts").over(line), "_until": F.coalesce(F.lead("ts").over(line) - width, F.col("ts")),
            "_last": F.max("ts").over(W.partitionBy(*keys)),
        },
    )

    def steps(until: str, since: str = "_first") -> Column:
        return ((epoch_us(until) - epoch_us(since)) / (seconds * 1000000)).cast("bigint")

    filled = expand_runs(spans, "ts", steps("_until", "ts") + 1, width, "_at")
    amount = F.when(F.col("_at") == F.col("ts"), F.col("_sum")).otherwise(F.lit(fill))
    return filled.select(
        *keys, F.col("_at").alias("ts"), steps("_at").alias("pos"), amount.alias("value"), (steps("_last") + 1).alias("n"),
    )


def series_size(series: DataFrame, keys) -> DataFrame:
    """Rows per series as ``n``."""
    return series.groupBy(*keys).agg(F.count("*").alias("n"))


def with_size(series: DataFrame, keys) -> DataFrame:
    """(keys, pos, value, n); a series that knows its length is not counted again."""
    keys = list(keys)
    if "n" in series.columns:
        return series.select(*keys, "pos", "value", "n")
    rows = series.select(*keys, "pos", "value")
    return rows.join(series_size(rows, keys), keys)


def spread_chunks(sized: DataFrame, chunk: int, margin: int | Column) -> DataFrame:
    """Copies each row to every chunk whose run or margin holds its position."""
    margin = F.lit(margin) if isinstance(margin, int) else margin
    last = F.floor((F.col("n") - 1) / chunk)
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - margin) / chunk))
    high = F.least(last, F.floor((F.col("pos") + margin) / chunk))
    return sized.withColumn("chunk", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def on_chunks(
    sized: DataFrame, keys, kernel: Callable, schema: str, chunk: int = CHUNK, margin: int | Column = 0, carry=(),
) -> DataFrame:
    """Runs ``kernel(frame, lo, hi)`` per chunk.

    ``frame`` is sorted by position, ``lo:hi`` are the chunk's own rows in it. The kernel
    returns a frame; the key columns and ``chunk`` are put in front.
    """
    keys = list(keys)
    head = ", ".join(f"`{k}` {sized.schema[k].dataType.simpleString()}" for k in keys)
    columns = list(dict.fromkeys([*keys, "pos", "value", "n", *carry]))
    spread = spread_chunks(sized.select(*columns), chunk, margin)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", ignore_index=True)
        number = int(frame["chunk"].iloc[0])
        pos = frame["pos"].to_numpy()
        lo, hi = np.searchsorted(pos, [number * chunk, (number + 1) * chunk])
        out = kernel(frame, int(lo), int(hi))
        for i, k in enumerate(keys):
            out.insert(i, k, [frame[k].iloc[0]] * len(out))
        out.insert(len(keys), "chunk", number)
        return out

    return spread.groupBy(*keys, "chunk").applyInPandas(run, f"{head}, chunk int, {schema}")


def _renewed(df: DataFrame) -> DataFrame:
    """Same rows under fresh column ids, so that a table can meet its own descendants."""
    return df.select(*[F.col(c).alias(f"_{c}") for c in df.columns]).toDF(*df.columns)


def on_chunks_joined(
    sized: DataFrame, keys, side: DataFrame, kernel: Callable, schema: str, chunk: int = CHUNK, margin: int = 0,
) -> DataFrame:
    """``on_chunks`` with the row of ``side`` for each series and ``chunk`` handed to ``kernel(frame, lo, hi, row)``.

    A chunk without a row, or a row without values, calls the kernel with None.
    """
    keys = list(keys)
    head = ", ".join(f"`{k}` {sized.schema[k].dataType.simpleString()}" for k in keys)
    spread = spread_chunks(sized.select(*keys, "pos", "value", "n"), chunk, margin)

    def run(frame: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        source = row if len(row) else frame
        number = int(source["chunk"].iloc[0])
        if not len(frame) or not len(row):
            out = kernel(None, 0, 0, None)
        else:
            frame = frame.sort_values("pos", ignore_index=True)
            lo, hi = np.searchsorted(frame["pos"].to_numpy(), [number * chunk, (number + 1) * chunk])
            out = kernel(frame, int(lo), int(hi), row.iloc[0])
        for i, k in enumerate(keys):
            out.insert(i, k, [source[k].iloc[0]] * len(out))
        return out

    grouped = spread.groupBy(*keys, "chunk").cogroup(_renewed(side).groupBy(*keys, "chunk"))
    return grouped.applyInPandas(run, f"{head}, {schema}")


def on_chunks_with(
    sized: DataFrame, keys, side: DataFrame, kernel: Callable, schema: str, chunk: int = CHUNK, margin: int = 0,
) -> DataFrame:
    """``on_chunks`` with one row of ``side`` per series handed to ``kernel(frame, lo, hi, row)``.

    The row is sent once per chunk, not once per value.
    """
    keys = list(keys)
    last = F.floor((F.col("n") - 1) / chunk).cast("int")
    lengths = sized.groupBy(*keys).agg(F.max("n").alias("n"))
    sent = side.join(lengths, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), last))).drop("n")
    return on_chunks_joined(sized, keys, sent, kernel, schema, chunk, margin)


def fold_series(
    series: DataFrame, keys, state: DataFrame, kernel: Callable, schema: str, chunk: int, chunks: int,
) -> DataFrame:
    """Sequential recursion over bounded pieces of every series.

    ``kernel(values, row)`` advances a series' state by one chunk. All series advance in
    parallel; a series longer than one chunk takes one Spark job per chunk, so no
    task holds more than ``chunk`` rows.
    """
    from gridtide.session import cut_lineage

    keys = list(keys)
    head = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)

    def run(frame: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame(columns=held.columns)
        row = held.iloc[0].to_dict()
        if len(frame):
            values = frame.sort_values("pos")["value"].to_numpy(float)
            row = {**{k: row[k] for k in keys}, **kernel(values, row)}
        return pd.DataFrame([row])

    for c in range(chunks):
        part = series.where(F.col("pos").between(c * chunk, (c + 1) * chunk - 1)).select(*keys, "pos", "value")
        state = part.groupBy(*keys).cogroup(_renewed(state).groupBy(*keys)).applyInPandas(run, f"{head}, {schema}")
        if chunks > 1:
            state = cut_lineage(state)
    return state
