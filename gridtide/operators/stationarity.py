"""Unit-root and stationarity tests over many series.

Both tests read one record of sums per series: cross products of the unit-root regression,
autocovariances and the squares of the running sum. Chunks yield their parts of it, Spark adds
them up, and one small group per series is solved. A table is read twice: for its mean and
deviation, and for the record.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gridtide.operators.ordering import running_sum
from gridtide.operators.series import CHUNK, on_chunks
from gridtide.operators.spectrum import _key_schema
from gridtide.session import cut_lineage

MIN_ROWS = 10
MIN_RESIDUALS = 20

# MacKinnon (1994) p-value polynomials and limits, constant, one series.
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]

# MacKinnon (2010) critical value polynomials in 1/nobs, constant.
ADF_CRITICAL = {
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}

# Kwiatkowski et al. (1992), level stationarity.
KPSS_CRITICAL = {"10%": 0.347, "5%": 0.463, "2.5%": 0.574, "1%": 0.739}
KPSS_P_VALUES = [0.10, 0.05, 0.025, 0.01]

# Kinds of cells beside the regression's cross products, whose rows count from 0.
HEAD, PRODUCTS, RUNNING, UNFIT = -1, -2, -3, -4
CELLS = "i int, j int, v double, total double, first double, rows double"
SOLVED = (
    "n bigint, adf_statistic double, adf_p double, used_lags int, n_observations bigint, "
    "eta double, variance double, lags bigint"
)


def mackinnon_p(tau: float) -> float:
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coefficients = ADF_SMALL_P if tau <= ADF_TAU_STAR else ADF_LARGE_P
    z = sum(c * tau**i for i, c in enumerate(coefficients))
    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


def _adf_solve(gram: np.ndarray, head: np.ndarray, n: int, top: int, given: bool = False) -> dict:
    """Lag choice by AIC, or the given lag ``top``, and the level's t value from cross products.

    Columns of ``gram``: constant, level, lagged differences 1..top, response.
    """
    used = n - 1 - top
    best, best_score = 0, np.inf
    for p in range(top if given else 0, top + 1):
        k = 2 + p
        beta = np.linalg.lstsq(gram[:k, :k], gram[:k, -1], rcond=None)[0]
        ssr = max(gram[-1, -1] - beta @ gram[:k, -1], 1e-300)
        score = used * (np.log(2 * np.pi * ssr / used) + 1) + 2 * k
        if score < best_score:
            best, best_score = p, score
    keep = [*range(2 + best), gram.shape[0] - 1]
    final = gram[np.ix_(keep, keep)].copy()
    step = np.diff(head)
    for t in range(best + 1, top + 1):  # rows usable with fewer lags
        row = np.concatenate([[1.0, head[t - 1]], [step[t - 1 - i] for i in range(1, best + 1)], [step[t - 1]]])
        final += np.outer(row, row)
    k, rows = 2 + best, n - 1 - best
    inverse = np.linalg.pinv(final[:k, :k])
    beta = inverse @ final[:k, -1]
    variance = max(final[-1, -1] - beta @ final[:k, -1], 0.0) / (rows - k)
    tau = beta[1] / np.sqrt(variance * inverse[1, 1]) if variance > 0 else -np.inf
    return {
        "adf_statistic": float(tau), "adf_p": float(mackinnon_p(tau)), "used_lags": best, "n_observations": rows,
    }


def _lag_sums(z: np.ndarray, lo: int, hi: int, reach: int) -> np.ndarray:
    """Sums of ``z[t] * z[t - lag]`` over t in ``lo:hi`` for lags 0..reach, absent rows being zero."""
    own, start = z[lo:hi], max(lo - reach, 0)
    around = z[start:hi]
    size = 1 << (len(own) + len(around) + reach).bit_length()
    spectrum = np.conj(np.fft.rfft(own, size)) * np.fft.rfft(around, size)
    return np.fft.irfft(spectrum, size)[(lo - start - np.arange(reach + 1)) % size]


def _scaled(series: DataFrame, keys, chunk: int, lags: int | None) -> DataFrame:
    """Rows with mean 0 and deviation 1, and the spans of the sums to take.

    ``_reach`` is the widest window that the KPSS rule asks of a series without negative
    autocovariances, a chunk at most.
    """
    rows = series.select(*keys, "pos", "value")
    scale = rows.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"),
    )
    n = F.col("n").cast("double")
    top = F.least(F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2) if lags is None else F.lit(lags)
    scale = scale.withColumns({
        "_fit": F.coalesce((n >= MIN_ROWS) & (F.col("_sd") > 0) & (top <= F.floor(n / 2) - 2), F.lit(False)),
        "_top": F.greatest(top, F.lit(0)).cast("int"),
        "_reach": F.least(F.ceil(1.1447 * F.pow(n, F.lit(13.0 / 27.0))), n - 1, F.lit(chunk)).cast("int"),
    })
    z = F.when(F.col("_fit"), (F.col("value") - F.col("_mean")) / F.col("_sd"))
    return rows.join(scale, keys).withColumn("value", z)


def _record(scaled: DataFrame, keys, chunk: int, unit_root: bool, level: bool) -> DataFrame:
    """The sums of each series as cells (keys, n, i, j, v)."""

    def kernel(frame, lo, hi):
        z, begins = frame["value"].to_numpy(float), frame["pos"].iloc[0] == 0
        top, reach = int(frame["_top"].iloc[0]), int(frame["_reach"].iloc[0])
        found = []
        if not frame["_fit"].iloc[0]:
            found.append({"i": UNFIT, "j": [0], "v": [0.0]})
        elif unit_root:
            start = max(lo, top + 1) if begins else lo
            if start < hi:
                step = np.diff(z)
                t = np.arange(start, hi)
                x = np.column_stack([np.ones(len(t)), z[t - 1], *[step[t - 1 - i] for i in range(1, top + 1)], step[t - 1]])
                i, j = np.triu_indices(top + 3)
                found.append({"i": i, "j": j, "v": (x.T @ x)[i, j]})
            if begins and lo == 0:
                head = z[: top + 1]
                found.append({"i": HEAD, "j": np.arange(len(head)), "v": head})
        if level and frame["_fit"].iloc[0]:
            found.append({"i": PRODUCTS, "j": np.arange(reach + 1), "v": _lag_sums(z, lo, hi, reach)})
            c = np.cumsum(z[lo:hi])
            total = c[-1] if len(c) else 0.0
            found.append({"i": RUNNING, "j": [frame["chunk"].iloc[0]], "v": [c @ c], "total": total, "first": c.sum(), "rows": len(c)})
        out = pd.concat([pd.DataFrame(f) for f in found]).reindex(columns=["i", "j", "v", "total", "first", "rows"]).fillna(0.0)
        return out.astype({"i": "int32", "j": "int32", "rows": "float64"}).assign(n=int(frame["n"].iloc[0]))

    margin = F.greatest(F.col("_top") + 2 if unit_root else F.lit(0), F.col("_reach") if level else F.lit(0))
    parts = on_chunks(scaled, keys, kernel, f"{CELLS}, n bigint", chunk, margin, ("_top", "_reach", "_fit"))
    cells = parts.groupBy(*keys, "n", "i", "j").agg(*[F.sum(c).alias(c) for c in ("v", "total", "first", "rows")])
    # A chunk's running sum starts from the total of the chunks before it.
    line = W.partitionBy(*keys, "i").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("total").over(line), F.lit(0.0))
    moved = cells.withColumn("v", F.col("v") + before * (2.0 * F.col("first") + before * F.col("rows")))
    place = F.when(F.col("i") == RUNNING, 0).otherwise(F.col("j")).alias("j")
    return moved.groupBy(*keys, "n", "i", place).agg(F.sum("v").alias("v"))


def _level_solve(products: np.ndarray, squares: float, n: int) -> dict:
    """KPSS terms with the data-driven lag; no variance if the window is wider than the products reach."""
    span = np.arange(1, int(n ** (2.0 / 9.0)) + 1)
    near = products[span]
    s0, s1 = products[0] + 2.0 * near.sum(), 2.0 * (span * near).sum()
    ratio = s1 / s0 if s0 else 0.0
    lags = min(int(1.1447 * (ratio * ratio) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1)
    variance = None
    if lags < len(products):
        weight = 1.0 - np.arange(1, lags + 1) / (lags + 1.0)
        variance = float((products[0] + 2.0 * weight @ products[1 : lags + 1]) / n)
    return {"eta": float(squares / n**2), "variance": variance, "lags": lags}


def _solved(series: DataFrame, keys, chunk: int, unit_root: bool, level: bool, lags: int | None = None) -> DataFrame:
    """One row per series with the terms of both tests; a series unfit for them has only ``n``."""
    cells = _record(_scaled(series, keys, chunk, lags), keys, chunk, unit_root, level)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iloc[0])
        row = {**{k: frame[k].iloc[0] for k in keys}, "n": n}
        kind = {i: part.sort_values("j")["v"].to_numpy() for i, part in frame[frame["i"] < 0].groupby("i")}
        gram = frame[frame["i"] >= 0]
        if len(gram):
            top = int(gram["j"].max()) - 2
            full = np.zeros((top + 3, top + 3))
            full[gram["i"], gram["j"]] = gram["v"]
            row |= _adf_solve(np.triu(full) + np.triu(full, 1).T, kind[HEAD], n, top, lags is not None)
        if PRODUCTS in kind:
            row |= _level_solve(kind[PRODUCTS], float(kind[RUNNING][0]), n)
        return pd.DataFrame([row], columns=[*keys, *[part.split()[0] for part in SOLVED.split(", ")]])

    return cells.groupBy(*keys).applyInPandas(solve, f"{_key_schema(series, keys)}, {SOLVED}")


def _verdict(stationary) -> dict:
    return {
        "is_stationary": stationary,
        "interpretation": F.when(stationary, "Stationary").when(~stationary, "Non-stationary"),
    }


def _reason(solved, test: str):
    return F.when(F.col("n") < MIN_ROWS, f"Insufficient data for {test} test").when(
        solved.isNull(), f"{test} test failed: constant series",
    )


def _adf_columns(alpha: float) -> list:
    p, rows = F.col("adf_p"), F.col("n_observations").cast("double")
    limits = []
    for name, polynomial in ADF_CRITICAL.items():
        limits += [F.lit(name), sum((F.lit(c) / F.pow(rows, F.lit(float(i))) for i, c in enumerate(polynomial)), F.lit(0.0))]
    return [
        F.col("adf_statistic").alias("test_statistic"), p.alias("p_value"), "used_lags", "n_observations",
        F.when(p.isNotNull(), F.create_map(*limits)).alias("critical_values"), _reason(F.col("adf_statistic"), "ADF").alias("error"),
        *[c.alias(name) for name, c in _verdict(p < alpha).items()],
    ]


def adf_test(series: DataFrame, keys, alpha: float = 0.05, chunk: int = CHUNK, lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant and the AIC lag, or the lag ``lags``.

    ``series`` has a gap-free ``pos`` and no null values. A given lag must leave half of the rows; a
    shorter series counts as failed.
    """
    keys = list(keys)
    return _solved(series, keys, chunk, True, False, lags).select(*keys, *_adf_columns(alpha))


def _wide_variance(scaled: DataFrame, keys, wide: DataFrame, chunk: int) -> DataFrame:
    """Long-run variance for any window (keys, _wide).

    With running sums C the Bartlett variance for lag L is the mean square of moving sums
    of length L + 1, so any L costs one equi-join on the shifted position.
    """
    rows = scaled.select(*keys, "pos", "value").join(wide, keys).withColumn("_b", F.floor(F.col("pos") / chunk))
    sums = running_sum(rows, keys, ["pos"], {"c": F.col("value")}, ["_b"]).select(*keys, "pos", "n", "lags", "c")
    shifted = sums.select(*keys, (F.col("pos") + F.col("lags") + 1).alias("pos"), F.col("c").alias("_back"))
    moving = sums.join(shifted, [*keys, "pos"], "left")
    jump = F.col("c") - F.coalesce("_back", F.lit(0.0))
    ends = (F.col("pos") >= F.col("n") - 1 - F.col("lags")) & (F.col("pos") < F.col("n") - 1)
    tail = F.when(ends, F.col("c") * F.col("c")).otherwise(0.0)
    window = F.sum(jump * jump) + F.sum(tail)
    return moving.groupBy(*keys, "n", "lags").agg(window.alias("_w")).select(
        *keys, (F.col("_w") / ((F.col("lags") + 1) * F.col("n"))).alias("_wide"),
    )


def _with_wide(solved: DataFrame, series: DataFrame, keys, chunk: int, unit_root_lags: int | None = None) -> DataFrame:
    """Adds the variance of windows that the record does not reach; the table is read again only if there are any."""
    solved = cut_lineage(solved)
    wide = solved.where(F.col("variance").isNull() & F.col("eta").isNotNull()).select(*keys, "n", "lags")
    if wide.isEmpty():
        return solved
    scaled = _scaled(series, keys, chunk, unit_root_lags)
    extra = _wide_variance(scaled, keys, wide, chunk)
    return solved.join(extra, keys, "left").withColumn("variance", F.coalesce("variance", "_wide")).drop("_wide")


def _kpss_columns(alpha: float) -> list:
    stat = F.try_divide("eta", "variance")
    points = list(zip(KPSS_CRITICAL.values(), KPSS_P_VALUES))
    p = F.when(stat <= points[0][0], points[0][1])
    for (x0, p0), (x1, p1) in zip(points, points[1:]):
        p = p.when(stat <= x1, p0 + (stat - x0) / (x1 - x0) * (p1 - p0))
    p = p.when(stat.isNotNull(), points[-1][1])
    critical = F.create_map(*[F.lit(v) for item in KPSS_CRITICAL.items() for v in item])
    return [
        stat.alias("test_statistic"), p.alias("p_value"), F.col("lags").cast("int").alias("lags"),
        F.when(stat.isNotNull(), critical).alias("critical_values"), _reason(stat, "KPSS").alias("error"),
        *[c.alias(name) for name, c in _verdict(p > alpha).items()],
    ]


def kpss_test(series: DataFrame, keys, alpha: float = 0.05, chunk: int = CHUNK) -> DataFrame:
    """KPSS test of level stationarity with the data-driven lag.

    The p-value stays within the published table.
    """
    keys = list(keys)
    solved = _with_wide(_solved(series, keys, chunk, False, True), series, keys, chunk)
    return solved.select(*keys, *_kpss_columns(alpha))


def residual_tests(parts: DataFrame, keys, alpha: float = 0.05, chunk: int = CHUNK) -> DataFrame:
    """Both tests on the ``resid`` column of a decomposition, as structs.

    The residuals are stored once, since both reads would otherwise run the decomposition.
    """
    keys = list(keys)
    if "resid" not in parts.columns:
        raise ValueError("no resid column")
    series = cut_lineage(parts.select(*keys, "pos", F.col("resid").alias("value")).where(F.col("value").isNotNull()))
    solved = _with_wide(_solved(series, keys, chunk, True, True), series, keys, chunk)
    enough = F.col("n") >= MIN_RESIDUALS
    return solved.select(
        *keys, F.when(enough, F.struct(*_adf_columns(alpha))).alias("adf_test"),
        F.when(enough, F.struct(*_kpss_columns(alpha))).alias("kpss_test"),
        F.when(~enough, "Insufficient residual data").alias("error"),
    )
