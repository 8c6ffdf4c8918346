"""Exact order statistics whose cost per task does not grow with a group.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer. Here the size of the largest group decides. Small groups are counted per value and
ranked in a window. For large ones a sketch brackets each wanted rank; rows outside all
brackets are only counted, so they vanish in the map-side combine, and an exact running
count runs over the few values left, itself cut into slices when they are still many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridtide.operators.ordering import SLICE_ROWS, add_slices, largest_group, running_sum
from gridtide.session import cut_lineage

ACCURACY = 10000  # sketch size; rank error is about n / ACCURACY
MARGIN = 5.0 / ACCURACY
DIRECT_ROWS = 1_000_000  # groups up to this size need no bracket


def attach_one(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Adds the columns of a keyless aggregate (exactly one row) to every row."""
    return rows.join(F.broadcast(single))


def rank_values(
    df: DataFrame, keys, value: str, targets: dict[str, tuple[float, Column]],
    direct_rows: int = DIRECT_ROWS, span: int = 1, slice_rows: int = SLICE_ROWS, largest: int | None = None,
) -> DataFrame:
    """Values at wanted zero-based ranks: one row per keys with ``_n`` and the targets.

    ``targets`` maps an output name to (share of the group the rank lies at, rank as
    a column of ``_n``). With ``span=2`` the next higher value is added as ``{name}_next``.
    ``largest`` is an upper bound of a group's rows if the caller knows one.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    largest = largest_group(rows, keys) if largest is None else largest
    if largest <= direct_rows:
        counted = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c")).withColumn("_skipped", F.lit(0))
        line = W.partitionBy(*keys).orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)
        counted = counted.withColumns(
            {"_cum": F.sum("_c").over(line), "_n": F.sum("_c").over(W.partitionBy(*keys))},
        )
    else:
        counted = _bracketed(rows, keys, [p for p, _ in targets.values()], largest, direct_rows, slice_rows)

    place = F.struct(F.col("_cum").alias("cum"), F.col("_x").alias("x"), F.col("_skipped").alias("skipped"))
    picks, outputs = [], []
    for name, (_, rank) in targets.items():
        for step in range(span):
            label = name if step == 0 else f"{name}_next"
            wanted = F.least(rank + step, F.col("_n") - 1)
            picks.append(F.min(F.when((rank >= 0) & (F.col("_cum") > wanted), place)).alias(f"_p_{label}"))
            found = F.col(f"_p_{label}")
            outputs.append(
                F.when(
                    found.skipped == 1,
                    F.raise_error(F.lit("rank outside its bracket; raise ACCURACY")).cast("double"),
                ).otherwise(found.x).alias(label),
            )
    return counted.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks).select(*keys, "_n", *outputs)


def _bracketed(rows: DataFrame, keys, shares, largest: int, direct_rows: int, slice_rows: int) -> DataFrame:
    """Counts per kept value with running totals; skipped rows are filed between the brackets.

    Only keys with more than ``direct_rows`` rows have brackets. They are at most one in as many rows, so they
    are broadcast: a shuffle of the rows by key would gather all rows of a large key in one task.
    """
    probs = sorted({min(1.0, max(0.0, p + s * MARGIN)) for p in shares for s in (-1, 1)})
    summary = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_x", [float(p) for p in probs], ACCURACY).alias("_s"),
    )
    large = F.col("_n") > direct_rows
    summary = cut_lineage(summary.where(large) if keys else summary)  # one sketch for all uses

    def edge(p: float, sign: int) -> Column:
        return F.col("_s")[probs.index(min(1.0, max(0.0, p + sign * MARGIN)))]

    brackets = [(edge(p, -1), edge(p, 1)) for p in shares]
    kept = reduce(lambda a, b: a | b, [F.col("_x").between(lo, hi) for lo, hi in brackets], ~large)
    kept = F.coalesce(kept, F.lit(True))  # a small key has no summary
    # A skipped value is filed right after the highest bracket end below it.
    ends = [F.when(hi < F.col("_x"), hi) for _, hi in brackets]
    filed = F.greatest(*ends) if len(ends) > 1 else ends[0]

    known = [F.col(k).isNotNull() for k in keys]
    joined = rows.where(reduce(lambda a, b: a & b, known)).join(F.broadcast(summary), keys, "left") if keys else attach_one(rows, summary)
    counted = joined.select(
        *keys,
        F.when(kept, F.col("_x")).otherwise(filed).alias("_x"),
        (~kept).cast("int").alias("_skipped"),
        "_n",
    ).groupBy(*keys, "_x", "_skipped").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    # Rows below all brackets have no value; they come first.
    order = [F.col("_x").asc_nulls_first(), F.col("_skipped")]
    slices: list[str] = []
    if largest * 2 * MARGIN * len(brackets) > slice_rows:
        counted = cut_lineage(counted)
        crowded = largest_group(counted, keys)
        if crowded > slice_rows:
            counted, _ = add_slices(counted, keys, F.col("_x").cast("double"), "_b", crowded, slice_rows=slice_rows)
            slices = ["_b"]
            counted = counted.withColumn("_b", F.when(F.col("_x").isNull(), -1).otherwise(F.col("_b")))
    counted = running_sum(counted, keys, order, {"_cum": F.col("_c")}, slices)
    if not keys:
        return counted
    # A small key is added up in one place, a large one brings its size along.
    whole = W.partitionBy(*keys, *[F.when(F.col("_n").isNotNull(), F.col(s)) for s in slices])
    return counted.withColumn("_n", F.coalesce("_n", F.sum("_c").over(whole)))


def exact_quantiles(
    df: DataFrame, keys, value: str, quantiles: dict[str, float], direct_rows: int = DIRECT_ROWS,
    slice_rows: int = SLICE_ROWS, largest: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per keys, equal to pandas' and NumPy's default."""
    targets = {
        f"_q_{name}": (q, F.floor((F.col("_n") - 1) * F.lit(float(q)))) for name, q in quantiles.items()
    }
    ranked = rank_values(df, keys, value, targets, direct_rows, 2, slice_rows, largest)
    outputs = []
    for name, q in quantiles.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.col(f"_q_{name}").cast("double"), F.col(f"_q_{name}_next").cast("double")
        outputs.append((low + (h - F.floor(h)) * (high - low)).alias(name))
    return ranked.select(*keys, *outputs)
