"""Seasonal-trend decomposition of many series as chunked Spark jobs.

Without robustness weights every step of the method is a finite linear filter, so a
chunk needs only a margin of neighbours as wide as the composed filters reach. Series
of any length are therefore cut into bounded chunks and the result equals the
whole-series one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridtide.operators.loess import bisquare, inner_loop
from gridtide.operators.quantiles import exact_quantiles
from gridtide.operators.series import CHUNK, on_chunks, series_size, with_size
from gridtide.session import cut_lineage


def _next_odd(x: float) -> int:
    k = int(np.ceil(x))
    return k + 1 if k % 2 == 0 else k


def _odd_above(x: int) -> int:
    return x + 1 if (x + 1) % 2 else x + 2


@dataclass(frozen=True)
class StlPlan:
    """Checked windows of one decomposition."""

    period: int
    seasonal: int
    trend: int
    low: int

    @classmethod
    def make(cls, period: int, seasonal: int = 7, trend: int | None = None) -> StlPlan:
        if period < 2:
            raise ValueError("the period must be at least 2")
        for name, w in (("seasonal", seasonal), ("trend", trend)):
            if w is not None and (w < 3 or w % 2 == 0):
                raise ValueError(f"the {name} window must be odd and at least 3")
        if trend is None:
            trend = _next_odd(1.5 * period / (1 - 1.5 / seasonal))
        if trend <= period:
            raise ValueError("the trend window must exceed the period")
        return cls(period, seasonal, trend, _odd_above(period))

    def reach(self, rounds: int) -> int:
        """How far one value can depend on its neighbours."""
        once = (self.seasonal // 2 + 1) * self.period + 2 * self.period + 2 + self.low // 2 + self.trend // 2
        return once * rounds


INNER_PLAIN, INNER_ROBUST, OUTER_ROBUST = 5, 2, 15
STL_SCHEMA = "pos bigint, observed double, trend double, seasonal double, resid double"


def _chunk_size(chunk: int, margin: int) -> int:
    """At least four margins per chunk, so copies stay under half of the rows."""
    return max(chunk, 4 * margin)


def _long_enough(sized: DataFrame, period: int) -> DataFrame:
    return sized.where(F.col("n") >= 2 * period)


def too_short(series: DataFrame, keys, period: int) -> DataFrame:
    """Series that cannot be decomposed, with the reason."""
    short = series_size(series, keys).where(F.col("n") < 2 * period)
    return short.withColumn("error", F.format_string("length %d is below two periods of %d", F.col("n"), F.lit(period)))


def stl(
    series: DataFrame, keys, period: int, seasonal: int = 7, trend: int | None = None, robust: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """Observed, trend, seasonal and resid per position.

    ``series`` has the keys, a gap-free ``pos`` from 0 and ``value``. Series shorter than two
    periods are left out; ``too_short`` lists them.
    """
    plan = StlPlan.make(period, seasonal, trend)
    sized = _long_enough(with_size(series, keys), period)
    if not robust:
        return _stl_plain(sized, keys, plan, chunk)
    return _stl_robust(sized, keys, plan, chunk)


def _place(frame) -> dict:
    """Length of the whole series and where the chunk begins in it."""
    return {"total": int(frame["n"].iloc[0]), "start": int(frame["pos"].iloc[0])}


def _components(pos, y, trend, season, lo, hi) -> pd.DataFrame:
    cut = slice(lo, hi)
    return pd.DataFrame(
        {
            "pos": pos[cut], "observed": y[cut], "trend": trend[cut], "seasonal": season[cut],
            "resid": (y - trend - season)[cut],
        },
    )


def _stl_plain(sized: DataFrame, keys, plan: StlPlan, chunk: int) -> DataFrame:
    margin = plan.reach(INNER_PLAIN)

    def kernel(frame, lo, hi):
        y = frame["value"].to_numpy(float)
        season, trend = inner_loop(
            y, plan.period, plan.seasonal, plan.trend, plan.low, INNER_PLAIN, np.zeros(len(y)), **_place(frame),
        )
        return _components(frame["pos"].to_numpy(), y, trend, season, lo, hi)

    return on_chunks(sized, keys, kernel, STL_SCHEMA, _chunk_size(chunk, margin), margin).drop("chunk")


def _stl_robust(sized: DataFrame, keys, plan: StlPlan, chunk: int) -> DataFrame:
    """Robust form: short series in one task each, long ones by rounds of chunked jobs.

    The weights of a round need the median residual of the whole series, which an
    exact distributed quantile supplies between the rounds.
    """
    margin = plan.reach(INNER_ROBUST)
    size = _chunk_size(chunk, margin)
    windows = (plan.period, plan.seasonal, plan.trend, plan.low, INNER_ROBUST)

    def whole(frame, lo, hi):
        y = frame["value"].to_numpy(float)
        season, trend = inner_loop(y, *windows, np.zeros(len(y)))
        for _ in range(OUTER_ROBUST):
            size_of = np.abs(y - season - trend)
            season, trend = inner_loop(y, *windows, trend, bisquare(size_of, np.median(size_of)))
        return _components(frame["pos"].to_numpy(), y, trend, season, lo, hi)

    short = on_chunks(sized.where(F.col("n") <= size), keys, whole, STL_SCHEMA, size, 0).drop("chunk")
    long = sized.where(F.col("n") > size)
    if not long.select("n").limit(1).count():
        return short

    def one_round(frame, lo, hi):
        y = frame["value"].to_numpy(float)
        weights = frame["weight"].to_numpy(float)
        season, trend = inner_loop(
            y, *windows, frame["trend"].to_numpy(float), None if np.isnan(weights).all() else weights, **_place(frame),
        )
        return _components(frame["pos"].to_numpy(), y, trend, season, lo, hi)

    state = long.withColumns({"trend": F.lit(0.0), "weight": F.lit(None).cast("double")})
    for turn in range(OUTER_ROBUST + 1):
        fit = cut_lineage(
            on_chunks(state, keys, one_round, STL_SCHEMA, size, margin, ("trend", "weight")).drop("chunk"),
        )
        if turn == OUTER_ROBUST:
            break
        away = fit.withColumn("_away", F.abs("resid"))
        medians = exact_quantiles(away, keys, "_away", {"_median": 0.5})
        share = F.try_divide(F.col("_away"), 6 * F.col("_median"))
        weight = (
            F.when((F.col("_median") == 0) | (share <= 0.001), 1.0)
            .when(share > 0.999, 0.0)
            .otherwise(F.pow(1 - F.pow(share, F.lit(2.0)), F.lit(2.0)))
        )
        lengths = long.select(*keys, "n").distinct()
        state = away.join(medians, list(keys)).join(lengths, list(keys)).select(
            *keys, "pos", F.col("observed").alias("value"), "n", "trend", weight.alias("weight"),
        )
    return short.unionByName(fit)


def mstl(series: DataFrame, keys, periods: list[int], windows: list[int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Several seasonal components ``seasonal_{p}`` (G2); one period gives plain ``seasonal``.

    After Bandara et al. (2021): two sweeps over ascending periods, each component
    re-estimated on the series without the others.
    """
    order = sorted(range(len(periods)), key=lambda i: periods[i])
    if windows is None:
        sorted_windows = [7 + 4 * (i + 1) for i in range(len(periods))]
    else:
        if len(windows) != len(periods):
            raise ValueError("one window per period is needed")
        sorted_windows = [windows[i] for i in order]
    ascending = [periods[i] for i in order]
    plans = [StlPlan.make(p, w) for p, w in zip(ascending, sorted_windows)]
    sweeps = 1 if len(plans) == 1 else 2
    margin = sum(p.reach(INNER_PLAIN) for p in plans) * sweeps
    names = ["seasonal"] if len(plans) == 1 else [f"seasonal_{p}" for p in ascending]

    def kernel(frame, lo, hi):
        y = frame["value"].to_numpy(float)
        parts = [np.zeros(len(y)) for _ in plans]
        rest, trend = y.copy(), np.zeros(len(y))
        for _ in range(sweeps):
            for i, p in enumerate(plans):
                rest = rest + parts[i]
                parts[i], trend = inner_loop(
                    rest, p.period, p.seasonal, p.trend, p.low, INNER_PLAIN, np.zeros(len(y)), **_place(frame),
                )
                rest = rest - parts[i]
        cut = slice(lo, hi)
        out = {"pos": frame["pos"].to_numpy()[cut], "observed": y[cut], "trend": trend[cut]}
        out.update({name: part[cut] for name, part in zip(names, parts)})
        out["resid"] = (rest - trend)[cut]
        return pd.DataFrame(out)

    schema = "pos bigint, observed double, trend double, " + ", ".join(f"{s} double" for s in names) + ", resid double"
    sized = _long_enough(with_size(series, keys), max(periods))
    return on_chunks(sized, keys, kernel, schema, _chunk_size(chunk, margin), margin).drop("chunk")


def decompose_columns(df: DataFrame, pos: str, columns: list[str], periods: list[int], carry=(), **options) -> DataFrame:
    """Decompose wide columns side by side into ``{component}_{column}``.

    The columns become series of one long table, so they run in parallel.
    """
    long = df.select(F.col(pos).alias("pos"), *columns).unpivot(["pos"], columns, "series_id", "value")
    if len(periods) == 1:
        windows = options.pop("windows", None)
        if windows:
            options["seasonal"] = windows[0]
        parts = stl(long, ["series_id"], periods[0], **options)
    else:
        parts = mstl(long, ["series_id"], periods, **options)
    components = [c for c in parts.columns if c not in ("series_id", "pos")]
    cells = [
        F.max(F.when(F.col("series_id") == c, F.col(k))).alias(f"{k}_{c}") for c in columns for k in components
    ]
    return parts.groupBy("pos").agg(*cells)
