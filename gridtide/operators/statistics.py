"""Statistics as plain aggregates, one pass wherever the maths allows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridtide.functions.columns import numeric_columns
from gridtide.operators.quantiles import attach_one, exact_quantiles
from gridtide.session import cut_lineage

MOST_SHAPES = 10_000
VALUES_AT_ONCE = 4096
VECTORS_HELD = 1000


def _pairs(df: DataFrame, columns, statistic) -> DataFrame:
    columns = list(columns)
    cells = [
        (a, b, statistic(a, b).alias(f"_m{i}_{j}"))
        for (i, a), (j, b) in combinations_with_replacement(list(enumerate(columns)), 2)
    ]
    row = df.agg(*[c for _, _, c in cells])
    entries = []
    for (i, a), (j, b) in combinations_with_replacement(list(enumerate(columns)), 2):
        value = F.col(f"_m{i}_{j}")
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("value")))
        if i != j:
            entries.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), value.alias("value")))
    return row.select(F.inline(F.array(*entries)))


def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Long (a, b, value) correlations, nulls left out pairwise (D14); a single aggregate."""
    return _pairs(df, columns or numeric_columns(df), lambda a, b: F.corr(a, b))


def covariance_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Long (a, b, value) sample covariances, nulls left out pairwise."""
    return _pairs(df, columns or numeric_columns(df), lambda a, b: F.covar_samp(a, b))


def pair_correlation(df: DataFrame, a: str, b: str, out: str = "correlation") -> DataFrame:
    """Correlation of two columns."""
    return df.agg(F.corr(a, b).alias(out))


def variance_by(df: DataFrame, by, value: str, out: str = "variance") -> DataFrame:
    """Sample variance per group."""
    return df.na.drop(subset=list(by)).groupBy(*by).agg(F.var_samp(value).alias(out))


def _with_groups(rows: DataFrame, groups: DataFrame, by) -> DataFrame:
    """Rows joined with one row per group, broadcast while there are at most ``MOST_SHAPES``; few groups shuffled would be gathered in as many tasks."""
    groups = cut_lineage(groups)
    return rows.join(F.broadcast(groups) if groups.count() <= MOST_SHAPES else groups, by)


def box_statistics(df: DataFrame, by, value: str) -> DataFrame:
    """Quartiles, whiskers at most 1.5 IQR away, and outlier count per group."""
    by = list(by)
    rows = df.na.drop(subset=[*by, value])
    boxes = exact_quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x = F.col(value)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fits = x.between(F.col("q1") - reach, F.col("q3") + reach)
    joined = _with_groups(rows, boxes, by)
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(fits, x)).alias("whisker_low"),
        F.max(F.when(fits, x)).alias("whisker_high"),
        F.count_if(~fits).alias("outliers"),
    )


def box_outliers(df: DataFrame, by, value: str) -> DataFrame:
    """The rows outside the whiskers of their group."""
    by = list(by)
    rows = df.na.drop(subset=[*by, value])
    boxes = exact_quantiles(rows, by, value, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return _with_groups(rows, boxes, by).where(
        ~F.col(value).between(F.col("q1") - reach, F.col("q3") + reach),
    ).drop("q1", "q3")


def score_columns(actual: str, predicted: str) -> list[Column]:
    """Aggregates mse, mae and r2 over rows where both values exist.

    A constant truth scores 1 if every residual is zero, else 0; fewer than two rows give null.
    """
    x, y = F.col(actual), F.col(predicted)
    both = x.isNotNull() & y.isNotNull()
    error = F.when(both, x - y)
    truth = F.when(both, x)
    mse = F.avg(error * error)
    spread = F.var_pop(truth)
    r2 = (
        F.when(F.count(error) < 2, F.lit(None).cast("double"))
        .when(F.min(truth) == F.max(truth), F.when(mse == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(mse, spread))
    )
    return [mse.alias("mse"), F.avg(F.abs(error)).alias("mae"), r2.alias("r2")]


def regression_scores(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """mse, mae and r2, optionally per fold or run."""
    return df.groupBy(*by).agg(*score_columns(actual, predicted))


def compare_sources(df: DataFrame) -> DataFrame:
    """Agreement of each ``{c}_df1`` with ``{c}_df2``, one row per column.

    ``_df1`` is the truth. Pairs that sum to zero with equal values do not enter the
    percentage; columns without overlap give no row.
    """
    numeric = set(numeric_columns(df))
    bases = [c[:-4] for c in df.columns if c.endswith("_df1") and {c, c[:-4] + "_df2"} <= numeric]
    if not bases:
        raise ValueError("no numeric column pair with suffixes _df1 and _df2")
    entries = [
        F.struct(
            F.lit(b).alias("column"),
            F.col(f"{b}_df1").cast("double").alias("x"),
            F.col(f"{b}_df2").cast("double").alias("y"),
        )
        for b in bases
    ]
    pairs = df.select(F.inline(F.array(*entries))).na.drop()
    x, y = F.col("x"), F.col("y")
    # Opposite values divide by zero and count as an infinite difference.
    centre = (x + y) / 2
    share = F.when((centre == 0) & (x != y), F.lit(float("inf"))).otherwise(F.abs(F.try_divide(x - y, centre)))
    return pairs.groupBy("column").agg(
        *score_columns("x", "y"),
        F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"),
        F.corr("x", "y").alias("correlation"),
        (F.avg(share) * 100).alias("mean_abs_percent_diff"),
        F.count("*").alias("samples"),
    )


def describe_columns(df: DataFrame, columns=None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column, long form."""
    columns = list(columns or numeric_columns(df))
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "_v")
    basics = long.groupBy("column").agg(
        F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "_v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basics.join(quartiles, "column", "left")


def null_and_duplicate_counts(df: DataFrame) -> DataFrame:
    """Null cells and repeated rows over the whole table."""
    nulls = sum(F.col(c).isNull().cast("bigint") for c in df.columns)
    grouped = df.groupBy(*df.columns).agg(F.count("*").alias("_c"))
    return grouped.agg(
        F.coalesce(F.sum(F.col("_c") * nulls), F.lit(0)).alias("null_cells"),
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicated_rows"),
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    limits = rows.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1))
    return (
        attach_one(rows, limits)
        .select(slot.cast("bigint").alias("bin"), (F.col("_lo") + slot * width).alias("bin_start"))
        .groupBy("bin", "bin_start")
        .agg(F.count("*").alias("n"))
    )


def median_of(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """Exact median of a column."""
    return exact_quantiles(df, [], value, {out: 0.5})


def category_statistics(
    df: DataFrame, category: str, value: str, order_by: str = "mean", ascending: bool = True, top: int | None = None,
) -> DataFrame:
    """count, mean and median per category, ordered, optionally the first ``top``.

    ``order_by`` is count, mean, median, name, or month for calendar-month names.
    """
    rows = df.na.drop(subset=[category])
    stats = rows.groupBy(category).agg(F.count(value).alias("count"), F.avg(value).alias("mean"))
    stats = stats.join(exact_quantiles(rows, [category], value, {"median": 0.5}), category, "left")
    key = {
        "name": F.col(category),
        "month": F.month(F.to_date(F.concat(F.lit("2024 "), F.col(category), F.lit(" 1")), "yyyy MMMM d")),
    }.get(order_by)
    if key is None:
        key = F.col(order_by)
    ordered = stats.orderBy(key.asc() if ascending else key.desc(), F.col(category))
    return ordered if top is None else ordered.limit(top)


def density_curves(
    df: DataFrame, category: str, value: str, points: int = 200, bandwidth: float = 0.5, cut: float = 3.0,
) -> DataFrame:
    """Gaussian kernel density per category on an even evaluation grid.

    Scott's factor ``n ** (-1/5)`` times ``bandwidth`` scales the sample deviation. A task adds
    up one vector of kernel sums per category it meets, so values are not shuffled; grid and
    deviation of each category are broadcast while there are at most ``MOST_SHAPES`` of them.
    """
    rows = df.na.drop(subset=[category, value]).select(category, F.col(value).cast("double").alias("_v"))
    shapes = rows.groupBy(category).agg(
        F.count("*").alias("_n"), F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
    )
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.lit(bandwidth)
    start = F.col("_lo") - cut * F.col("_h")
    step = (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / (points - 1)
    shapes = shapes.withColumn("_h", h).where(F.col("_h") > 0)
    shapes = cut_lineage(shapes.select(category, "_n", "_h", start.alias("_start"), step.alias("_step")))
    known = F.broadcast(shapes) if shapes.count() <= MOST_SHAPES else shapes
    grid = np.arange(points)

    def kernel_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}

        def drained() -> pd.DataFrame:
            parts = [pd.DataFrame({category: name, "point": grid, "x": x, "_n": n, "_h": width, "_w": w}) for name, (x, n, width, w) in held.items()]
            held.clear()
            return pd.concat(parts)

        for frame in frames:
            for name, part in frame.groupby(category):
                if name not in held:
                    first = part.iloc[0]
                    held[name] = (first["_start"] + grid * first["_step"], first["_n"], first["_h"], np.zeros(points))
                x, _, width, w = held[name]
                values, counts = np.unique(part["_v"].to_numpy(), return_counts=True)
                for at in range(0, len(values), VALUES_AT_ONCE):
                    z = (x[:, None] - values[at : at + VALUES_AT_ONCE]) / width
                    w += np.exp(-z * z / 2) @ counts[at : at + VALUES_AT_ONCE]
            if len(held) > VECTORS_HELD:
                yield drained()
        if held:
            yield drained()

    kind = df.schema[category].dataType.simpleString()
    parts = rows.join(known, category).mapInPandas(
        kernel_sums, f"`{category}` {kind}, point bigint, x double, _n bigint, _h double, _w double",
    )
    return parts.groupBy(category, "point", "x", "_n", "_h").agg(F.sum("_w").alias("_w")).select(
        category, "point", "x", (F.col("_w") / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"),
    )


def frequencies(df: DataFrame, column: str, top: int | None = 5) -> DataFrame:
    """Most common values with counts; ties go to the smaller value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))
    return counts if top is None else counts.limit(top)
