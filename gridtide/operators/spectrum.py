"""Autocorrelation and spectra of many series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridtide.functions.columns import period_label
from gridtide.operators.ordering import top_rows
from gridtide.operators.series import CHUNK, on_chunks

SINGLE_TASK_STEPS = 65536

# Well-known periods in hours.
COMMON_PERIODS = [
    ("1 day", 24),
    ("1 week", 168),
    ("1 month", 720),
    ("3 months", 2160),
    ("6 months", 4368),
    ("1 year", 8760),
    ("2 years", 17520),
    ("5 years", 43800),
]


def centred(series: DataFrame, keys) -> DataFrame:
    """Adds ``n`` and replaces the value by its deviation from the series mean."""
    keys = list(keys)
    means = series.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("_mean"))
    return series.drop("n").join(means, keys).withColumn("value", F.col("value") - F.col("_mean")).drop("_mean")


def lag_products(sized: DataFrame, keys, lags: int | Column, chunk: int = CHUNK) -> DataFrame:
    """Sums of ``value[t] * value[t - lag]`` for lags 0..L per series.

    A chunk with a margin of L rows yields its part of all sums, so no (row, lag)
    pairs are shuffled. L may differ per series.
    """
    sized = sized.withColumn("_lags", F.lit(lags) if isinstance(lags, int) else lags)

    def kernel(frame, lo, hi):
        e = frame["value"].to_numpy(float)
        top = int(frame["_lags"].iloc[0])
        sums = np.zeros(top + 1)
        for k in range(top + 1):
            start = max(lo, k)
            if start < hi:
                sums[k] = e[start:hi] @ e[start - k : hi - k]
        return pd.DataFrame({"lag": np.arange(top + 1), "product": sums})

    parts = on_chunks(sized, keys, kernel, "lag int, product double", chunk, F.col("_lags"), ("_lags",))
    return parts.groupBy(*keys, "lag").agg(F.sum("product").alias("product"))


def acf(series: DataFrame, keys, lags: int = 200, chunk: int = CHUNK) -> DataFrame:
    """Autocorrelation for lags 0..L."""
    keys = list(keys)
    sized = centred(series, keys)
    top = F.least(F.lit(lags), F.col("n") - 1).cast("int")
    products = lag_products(sized, keys, top, chunk)
    power = products.where(F.col("lag") == 0).select(*keys, F.col("product").alias("_power"))
    return products.join(power, keys).select(
        *keys, "lag", F.try_divide(F.col("product"), F.col("_power")).alias("acf"),
    )


def pacf(series: DataFrame, keys, lags: int = 200, chunk: int = CHUNK) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on the ACF.

    A group holds the L + 1 autocorrelations of one series.
    """
    keys = list(keys)
    rows = acf(series, keys, lags, chunk)

    def levinson(frame: pd.DataFrame) -> pd.DataFrame:
        rho = frame.sort_values("lag")["acf"].to_numpy(float)
        top = len(rho) - 1
        out = np.ones(top + 1)
        coef = np.zeros(0)
        for k in range(1, top + 1):
            below = 1.0 - coef @ rho[1:k]
            last = (rho[k] - coef @ rho[1:k][::-1]) / below if below else np.nan
            coef = np.concatenate([coef - last * coef[::-1], [last]])
            out[k] = last
        head = {k: frame[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, "lag": np.arange(top + 1), "pacf": out})

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(levinson, f"{schema}, lag int, pacf double")


def _key_schema(df: DataFrame, keys) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _fft_step(rows: DataFrame, keys, group: str, slot: str, length: str, out_group: str, out_slot: str, twist: bool):
    """One half of a two-step transform: FFTs along ``slot`` within (keys, group)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        size = int(frame[length].iloc[0])
        here = int(frame[group].iloc[0])
        vector = np.zeros(size, complex)
        vector[frame[slot].to_numpy()] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
        done = np.fft.fft(vector)
        at = np.arange(size)
        if twist:
            total = int(frame["rows_"].iloc[0]) * int(frame["cols_"].iloc[0])
            done = done * np.exp(-2j * np.pi * ((here * at) % total) / total)
        fixed = {c: frame[c].iloc[0] for c in (*keys, "n", "rows_", "cols_")}
        return pd.DataFrame({**fixed, out_group: at, out_slot: here, "re": done.real, "im": done.imag})

    schema = (
        f"{_key_schema(rows, keys)}, n bigint, rows_ bigint, cols_ bigint, "
        f"{out_group} bigint, {out_slot} bigint, re double, im double"
    )
    return rows.groupBy(*keys, group).applyInPandas(run, schema)


def _fft(rows: DataFrame, keys) -> DataFrame:
    """Transform of length rows_ * cols_ in two shuffles; no group exceeds the longer side."""
    split = rows.withColumns({"_j1": F.floor(F.col("j") / F.col("cols_")), "_j2": F.col("j") % F.col("cols_")})
    first = _fft_step(split, keys, "_j2", "_j1", "rows_", "_k1", "_j2", True)
    second = _fft_step(first, keys, "_k1", "_j2", "cols_", "_k2", "_k1", False)
    index = (F.col("_k1") + F.col("rows_") * F.col("_k2")).alias("j")
    return second.select(*keys, "n", "rows_", "cols_", index, "re", "im")


def _times(re: Column, im: Column, c: Column, s: Column):
    return re * c - im * s, re * s + im * c


def _long_transform(sized: DataFrame, keys) -> DataFrame:
    """Chirp transform (Bluestein) of any length, built from two-step FFTs of a power of two."""
    keys = list(keys)
    bits = F.ceil(F.log2(2.0 * F.col("n")))
    low = F.floor(bits / 2)
    n = F.col("n")
    rows = sized.select(
        *keys, "n", F.col("pos").alias("j"), "value",
        F.pow(F.lit(2.0), low).cast("bigint").alias("rows_"),
        F.pow(F.lit(2.0), bits - low).cast("bigint").alias("cols_"),
    )
    angle = F.pi() * ((F.col("j") * F.col("j")) % (2 * n)) / n
    cos, sin = F.cos(angle), F.sin(angle)
    head = [*keys, "n", "rows_", "cols_"]
    signal = rows.select(*head, "j", (F.col("value") * cos).alias("re"), (-F.col("value") * sin).alias("im"))
    total = F.col("rows_") * F.col("cols_")
    chirp = rows.select(*head, "j", cos.alias("re"), sin.alias("im"))
    mirrored = rows.where(F.col("j") > 0).select(*head, (total - F.col("j")).alias("j"), cos.alias("re"), sin.alias("im"))
    a = _fft(signal, keys)
    b = _fft(chirp.unionByName(mirrored), keys).select(*keys, "j", F.col("re").alias("_c"), F.col("im").alias("_s"))
    re, im = _times(F.col("re"), F.col("im"), F.col("_c"), F.col("_s"))
    product = a.join(b, [*keys, "j"]).select(*head, "j", re.alias("re"), (-im).alias("im"))
    back = _fft(product, keys).where(F.col("j") <= F.col("n") / 2)
    re, im = _times(F.col("re") / total, -F.col("im") / total, cos, -sin)
    return back.select(*keys, "n", F.col("j").alias("k"), re.alias("re"), im.alias("im"))


def transform(series: DataFrame, keys, single_task_steps: int = SINGLE_TASK_STEPS) -> DataFrame:
    """Fourier coefficients k = 0..n/2 of the mean-free series.

    Series up to ``single_task_steps`` are transformed in one task each; longer ones
    are spread over tasks of about the square root of their length.
    """
    keys = list(keys)
    sized = centred(series, keys)

    def whole(frame, lo, hi):
        z = np.fft.rfft(frame["value"].to_numpy(float))
        n = len(frame)
        return pd.DataFrame({"n": n, "k": np.arange(len(z)), "re": z.real, "im": z.imag})

    short = on_chunks(
        sized.where(F.col("n") <= single_task_steps), keys, whole, "n bigint, k bigint, re double, im double",
        single_task_steps, 0,
    ).drop("chunk")
    long = sized.where(F.col("n") > single_task_steps)
    if not long.select("n").limit(1).count():
        return short
    return short.unionByName(_long_transform(long, keys))


def periodogram(
    series: DataFrame, keys, fs: float = 1.0, single_task_steps: int = SINGLE_TASK_STEPS,
) -> DataFrame:
    """One-sided power density without the zero frequency."""
    rows = transform(series, keys, single_task_steps).where(F.col("k") > 0)
    n = F.col("n")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (fs * n)
    doubled = F.when(F.col("k") * 2 == n, power).otherwise(2 * power)
    return rows.select(
        *keys, "k", (F.col("k") * fs / n).alias("frequency"), doubled.alias("power"), (n / (F.col("k") * fs)).alias("period"),
    )


def top_periods(spectrum: DataFrame, keys, top: int = 5) -> DataFrame:
    """Strongest periods with a readable label."""
    ranked = top_rows(spectrum, [F.desc("power"), F.asc("k")], top, list(keys))
    return ranked.withColumn("label", period_label("period"))


def spectrum_view(spectrum: DataFrame, unit: str = "hour", longest: float | None = None) -> DataFrame:
    """Positive periods up to a cap, with the name of a common period next to it."""
    scale = {"hour": 1.0, "day": 24.0}.get(unit)
    if scale is None:
        raise ValueError("the unit is hour or day")
    named = [(label, hours / scale) for label, hours in COMMON_PERIODS]
    cap = 1.1 * max(p for _, p in named) if longest is None else longest
    shown = spectrum.where((F.col("period") > 0) & (F.col("period") <= cap))
    nearest = F.array_min(
        F.array(
            *[
                F.struct(F.abs(F.col("period") - F.lit(p)).alias("off"), F.lit(label).alias("label"), F.lit(p).alias("hours"))
                for label, p in named
            ],
        ),
    )
    return shown.withColumn("_near", nearest).withColumns(
        {"common_period": F.col("_near.label"), "common_length": F.col("_near.hours")},
    ).drop("_near")


def common_periods(spectrum: DataFrame, keys, unit: str = "hour") -> DataFrame:
    """Common periods within each spectrum's range and the power at the closest period."""
    keys = list(keys)
    scale = {"hour": 1.0, "day": 24.0}[unit]
    limits = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(hours / scale).alias("length"))
            for label, hours in COMMON_PERIODS
        ],
    )
    spread = spectrum.select(*keys, "period", "power", F.inline(limits))
    closest = spread.groupBy(*keys, "label", "length").agg(
        F.min("period").alias("_lo"), F.max("period").alias("_hi"),
        F.min_by(F.struct("period", "power"), F.struct(F.abs(F.col("period") - F.col("length")), F.col("period"))).alias("_c"),
    )
    return closest.where(F.col("length").between(F.col("_lo"), F.col("_hi"))).select(
        *keys, "label", "length", F.col("_c.period").alias("period"), F.col("_c.power").alias("power"),
    )
