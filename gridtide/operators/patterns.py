"""Average seasonal patterns and their smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F


def _odd_window(window: int, period: int) -> int:
    if window > period:
        raise ValueError("the smoothing window exceeds the period")
    return window + 1 if window % 2 == 0 else window


def seasonal_pattern(df: DataFrame, keys, pos: str, value: str, period: int, out: str = "pattern") -> DataFrame:
    """Mean by position within the period."""
    if period <= 0:
        raise ValueError("the period must be positive")
    return df.groupBy(*keys, (F.col(pos) % period).alias("phase")).agg(F.avg(value).alias(out))


def smooth_moving_average(pattern: DataFrame, keys, period: int, window: int = 5, column: str = "pattern") -> DataFrame:
    """Centred moving average, shortened at the ends (E4); a pattern has ``period`` rows."""
    half = _odd_window(window, period) // 2
    frame = W.partitionBy(*keys).orderBy("phase").rowsBetween(-half, half)
    return pattern.withColumn(column, F.avg(column).over(frame))


def savgol_weights(window: int, order: int) -> np.ndarray:
    """Row t holds the weights that give the fitted polynomial at point t of a window."""
    x = np.arange(window) - window // 2
    basis = np.vander(x, order + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def smooth_savgol(
    pattern: DataFrame, keys, period: int, window: int = 5, order: int = 2, column: str = "pattern",
) -> DataFrame:
    """Savitzky-Golay smoothing with a polynomial fit at the ends (E5)."""
    window = _odd_window(window, period)
    if window < order + 2:
        raise ValueError("the window is too small for the polynomial order")
    if window > period:
        raise ValueError("the smoothing window exceeds the period")
    weights = savgol_weights(window, order)
    table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    start = F.greatest(F.lit(0), F.least(F.col("phase") - window // 2, F.lit(period - window)))
    targets = (
        pattern.select(*keys, "phase", start.cast("int").alias("_start"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
        .withColumn("_w", table[(F.col("phase") - F.col("_start")).cast("int")][F.col("_j")])
        .withColumn("_source", (F.col("_start") + F.col("_j")).cast("bigint"))
        .withColumnRenamed("phase", "_target")
    )
    sources = pattern.select(*keys, F.col("phase").cast("bigint").alias("_source"), F.col(column).alias("_x"))
    return (
        targets.join(sources, [*keys, "_source"])
        .groupBy(*keys, F.col("_target").alias("phase"))
        .agg(F.sum(F.col("_w") * F.col("_x")).alias(column))
    )


def all_patterns(decomposed: DataFrame, columns: list[str], periods: list[int], pos: str = "pos") -> DataFrame:
    """``pattern_{column}_period_{p}`` side by side over the phase.

    ``decomposed`` has ``seasonal_{column}`` (one period) or ``seasonal_{p}_{column}``;
    shorter periods end in nulls.
    """
    single = len(periods) == 1
    entries = []
    for c in columns:
        for p in periods:
            source = f"seasonal_{c}" if single else f"seasonal_{p}_{c}"
            entries.append(
                F.struct(
                    F.lit(f"pattern_{c}_period_{p}").alias("name"),
                    (F.col(pos) % p).cast("bigint").alias("phase"),
                    F.col(source).alias("value"),
                ),
            )
    names = [f"pattern_{c}_period_{p}" for c in columns for p in periods]
    long = decomposed.select(F.inline(F.array(*entries)))
    return long.groupBy("phase").pivot("name", names).agg(F.avg("value"))
