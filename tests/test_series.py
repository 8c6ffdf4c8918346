import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.operators import decomposition as D, patterns as P, spectrum as S, stationarity as Z
from gridtide.operators.loess import bisquare, inner_loop

KEYS = ["s"]


def series(spark, **arrays):
    return spark.createDataFrame(
        pd.concat([pd.DataFrame({"s": k, "pos": np.arange(len(v)), "value": np.asarray(v, float)}) for k, v in arrays.items()]),
    )


def known_cycle(n=1104):
    t = np.arange(n)
    return np.linspace(0, 10, n) + 15 * np.sin(2 * np.pi * t / 24) + 5 * np.sin(2 * np.pi * t / 168)


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(5)
    return known_cycle(1500) + rng.normal(0, 2, 1500)


def columns(df, names):
    return df.orderBy("s", "pos").toPandas()[names].to_numpy()


def test_chunked_stl_equals_whole(spark, noisy, monkeypatch):
    monkeypatch.setattr(D, "_chunk_size", lambda chunk, margin: chunk)
    df = series(spark, a=noisy, b=noisy[::-1])
    names = ["observed", "trend", "seasonal", "resid"]
    whole = columns(D.stl(df, KEYS, 12), names)
    cut = columns(D.stl(df, KEYS, 12, chunk=400), names)
    np.testing.assert_allclose(cut, whole, atol=1e-9)
    np.testing.assert_allclose(whole[:, 0], whole[:, 1:].sum(axis=1), atol=1e-9)


@pytest.mark.parametrize("n, seed", [(70_128, 1), (87_672, 2), (200_000, 3)])
def test_long_series_are_cut_without_a_trace(spark, n, seed):
    """At the real chunk size, against the whole series in one piece."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 10 * np.sin(2 * np.pi * t / 24) + 4 * np.sin(2 * np.pi * t / 168) + rng.normal(0, 3, n) + t / n
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "pos": t, "value": y})).repartition(4)
    plan = D.StlPlan.make(24, 7, None)
    season, trend = inner_loop(y, plan.period, plan.seasonal, plan.trend, plan.low, D.INNER_PLAIN, np.zeros(n))
    got = D.stl(df, KEYS, 24).orderBy("pos").toPandas()
    np.testing.assert_allclose(got.seasonal, season, atol=1e-8)
    np.testing.assert_allclose(got.trend, trend, atol=1e-8)
    if n < 100_000:
        names = ["trend", "seasonal_24", "seasonal_168"]
        np.testing.assert_allclose(columns(D.mstl(df, KEYS, [24, 168]), names), columns(D.mstl(df, KEYS, [24, 168], chunk=1 << 20), names), atol=1e-8)
    else:
        one = inner_loop(y, plan.period, plan.seasonal, plan.trend, plan.low, D.INNER_ROBUST, np.zeros(n))
        size = np.abs(y - one[0] - one[1])
        want = inner_loop(y, plan.period, plan.seasonal, plan.trend, plan.low, D.INNER_ROBUST, one[1], bisquare(size, np.median(size)))
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(D, "OUTER_ROBUST", 1)
            got = D.stl(df, KEYS, 24, robust=True).orderBy("pos").toPandas()
        np.testing.assert_allclose(got.seasonal, want[0], atol=1e-8)
        np.testing.assert_allclose(got.trend, want[1], atol=1e-8)


def test_chunked_mstl_equals_whole(spark, noisy, monkeypatch):
    monkeypatch.setattr(D, "_chunk_size", lambda chunk, margin: chunk)
    df = series(spark, a=noisy)
    names = ["trend", "seasonal_6", "seasonal_24", "resid"]
    np.testing.assert_allclose(
        columns(D.mstl(df, KEYS, [24, 6], chunk=500), names), columns(D.mstl(df, KEYS, [24, 6]), names), atol=1e-9,
    )


def test_robust_rounds_equal_single_task(spark, noisy, monkeypatch):
    spiky = noisy[:400].copy()
    spiky[::37] += 60
    df = series(spark, a=spiky)
    names = ["trend", "seasonal", "resid"]
    one = columns(D.stl(df, KEYS, 6, robust=True), names)
    monkeypatch.setattr(D, "_chunk_size", lambda chunk, margin: chunk)
    monkeypatch.setattr(D, "OUTER_ROBUST", 3)
    short = columns(D.stl(df, KEYS, 6, robust=True), names)
    spread = columns(D.stl(df, KEYS, 6, robust=True, chunk=150), names)
    np.testing.assert_allclose(spread, short, atol=1e-8)
    assert np.abs(one).max() < 1e6


def test_cycle_is_recovered(spark):
    got = D.mstl(series(spark, a=known_cycle()), KEYS, [24, 168]).orderBy("pos").toPandas()
    t = got.pos.to_numpy()
    assert np.abs(got.resid).mean() < 0.2
    assert np.corrcoef(got.seasonal_24, np.sin(2 * np.pi * t / 24))[0, 1] > 0.99


def test_parameters_are_checked(spark):
    df = series(spark, a=known_cycle(60))
    for period, seasonal, trend in ((1, 7, None), (12, 2, None), (12, 8, None), (12, 7, 20), (12, 7, 11)):
        with pytest.raises(ValueError):
            D.stl(df, KEYS, period, seasonal, trend)
    with pytest.raises(ValueError):
        D.mstl(df, KEYS, [6, 12], [7])
    assert D.stl(df, KEYS, 31).count() == 0
    assert D.too_short(df, KEYS, 31).first().error == "length 60 is below two periods of 31"
    assert D.mstl(df, KEYS, [12]).columns.count("seasonal") == 1


def test_wide_columns(spark):
    wide = spark.createDataFrame(pd.DataFrame({"pos": np.arange(120), "a": known_cycle(120), "b": known_cycle(120) * 2}))
    parts = D.decompose_columns(wide, "pos", ["a", "b"], [6, 24])
    assert {"trend_a", "seasonal_6_b", "seasonal_24_a", "resid_b", "observed_a"} < set(parts.columns)
    patterns = P.all_patterns(parts, ["a", "b"], [6, 24]).orderBy("phase").toPandas()
    assert len(patterns) == 24 and patterns.pattern_a_period_6.notna().sum() == 6


def test_periodogram(spark, noisy):
    odd = noisy[:1201]
    df = series(spark, even=noisy, odd=odd)
    for limit in (65536, 64):
        got = S.periodogram(df, KEYS, single_task_steps=limit).orderBy("s", "k").toPandas()
        for name, y in (("even", noisy), ("odd", odd)):
            z = np.abs(np.fft.rfft(y - y.mean())) ** 2 / len(y)
            z[1:] *= 2
            if len(y) % 2 == 0:
                z[-1] /= 2
            np.testing.assert_allclose(got[got.s == name].power, z[1:], rtol=1e-6, atol=1e-8 * z.max())


def test_top_period_of_known_cycle(spark):
    spectrum = S.periodogram(series(spark, a=known_cycle(1008)), KEYS)
    top = S.top_periods(spectrum, KEYS).orderBy("rank").collect()
    assert len(top) == 5 and top[0].period == pytest.approx(24) and top[0].label == "1.00 days"
    assert {r.label for r in S.common_periods(spectrum, KEYS).collect()} == {"1 day", "1 week", "1 month"}
    assert S.spectrum_view(spectrum, "day", 10).agg(F.max("period")).first()[0] <= 10


def test_acf_and_pacf(spark, noisy):
    df = series(spark, a=noisy)
    e = noisy - noisy.mean()
    want = np.array([1.0] + [e[k:] @ e[:-k] / (e @ e) for k in range(1, 41)])
    for chunk in (65536, 130):
        got = S.acf(df, KEYS, 40, chunk).orderBy("lag").toPandas()
        np.testing.assert_allclose(got.acf, want, atol=1e-10)
    partial = S.pacf(df, KEYS, 40).orderBy("lag").toPandas().pacf.to_numpy()
    for order in (1, 5, 40):
        toeplitz = want[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))]
        assert partial[order] == pytest.approx(np.linalg.solve(toeplitz, want[1 : order + 1])[-1])


def direct_adf(x):
    n, d = len(x), np.diff(x)
    top = int(np.ceil(12 * (n / 100) ** 0.25))

    def design(p, m):
        t = np.arange(m + 1, n)
        return np.column_stack([np.ones(len(t)), x[t - 1]] + [d[t - 1 - i] for i in range(1, p + 1)]), d[t - 1]

    scores = []
    for p in range(top + 1):
        X, y = design(p, top)
        b = np.linalg.lstsq(X, y, rcond=None)[0]
        scores.append(len(y) * (np.log(2 * np.pi * ((y - X @ b) ** 2).sum() / len(y)) + 1) + 2 * X.shape[1])
    p = int(np.argmin(scores))
    X, y = design(p, p)
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    s2 = ((y - X @ b) ** 2).sum() / (len(y) - X.shape[1])
    return b[1] / np.sqrt(s2 * np.linalg.inv(X.T @ X)[1, 1]), p, len(y)


def test_adf(spark, noisy):
    rng = np.random.default_rng(8)
    walk = np.cumsum(rng.normal(size=700))
    df = series(spark, season=noisy, walk=walk, flat=np.ones(40), few=np.arange(5))
    for chunk in (65536, 90):
        got = {r.s: r for r in Z.adf_test(df, KEYS, chunk=chunk).collect()}
        for name, x in (("season", noisy), ("walk", walk)):
            stat, lags, rows = direct_adf(x)
            assert got[name].test_statistic == pytest.approx(stat, rel=1e-6)
            assert (got[name].used_lags, got[name].n_observations) == (lags, rows)
        assert got["walk"].interpretation == "Non-stationary" and got["walk"].p_value > 0.05
        assert "constant" in got["flat"].error and "Insufficient" in got["few"].error


def test_adf_at_a_given_lag(spark, noisy):
    df = series(spark, season=noisy, few=np.arange(12.0) ** 2)
    for chunk in (65536, 90):
        got = {r.s: r for r in Z.adf_test(df, KEYS, chunk=chunk, lags=5).collect()}
        d = np.diff(noisy)
        t = np.arange(6, len(noisy))
        x = np.column_stack([np.ones(len(t)), noisy[t - 1], *[d[t - 1 - i] for i in range(1, 6)]])
        b = np.linalg.lstsq(x, d[t - 1], rcond=None)[0]
        s2 = ((d[t - 1] - x @ b) ** 2).sum() / (len(t) - 7)
        want = b[1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
        assert got["season"].test_statistic == pytest.approx(want, rel=1e-6)
        assert (got["season"].used_lags, got["season"].n_observations) == (5, len(t))
        assert got["few"].error and got["few"].test_statistic is None


def test_adf_tables():
    # Published asymptotic critical values have their nominal p-values.
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert Z.mackinnon_p(tau) == pytest.approx(p, abs=0.002)


def direct_kpss(x):
    e, n = x - x.mean(), len(x)
    s0, s1 = (e**2).sum() / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        product = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + product, s1 + i * product
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = ((e**2).sum() + sum(2 * (e[i:] @ e[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n**2 / variance, lags


def test_kpss(spark, noisy):
    walk = np.cumsum(np.random.default_rng(8).normal(size=700))
    df = series(spark, season=noisy, walk=walk, flat=np.ones(40), few=np.arange(5))
    for chunk in (65536, 90):
        got = {r.s: r for r in Z.kpss_test(df, KEYS, chunk=chunk).collect()}
        for name, x in (("season", noisy), ("walk", walk)):
            stat, lags = direct_kpss(x)
            assert got[name].test_statistic == pytest.approx(stat, rel=1e-6) and got[name].lags == lags
        assert got["walk"].interpretation == "Non-stationary" and got["walk"].p_value == 0.01
        assert "constant" in got["flat"].error and "Insufficient" in got["few"].error


def test_kpss_window_beyond_the_record(spark):
    # Alternating signs make the lag rule ask for windows far wider than the root of the length.
    x = np.tile([1.0, -1.0], 150) + 0.02 * np.random.default_rng(3).normal(size=300).cumsum()
    far = series(spark, a=x, b=np.random.default_rng(4).normal(size=300))
    for chunk in (65536, 40):
        got = {r.s: r for r in Z.kpss_test(far, KEYS, chunk=chunk).collect()}
        stat, lags = direct_kpss(x)
        assert lags > 1.1447 * 300 ** (13 / 27)
        assert got["a"].lags == lags and got["a"].test_statistic == pytest.approx(stat, rel=1e-6)
        assert got["b"].test_statistic is not None


def test_tests_read_a_table_twice(spark, tmp_path, noisy):
    path = str(tmp_path / "series")
    series(spark, a=noisy).write.parquet(path)
    plan = Z._solved(spark.read.parquet(path), KEYS, 65536, True, True)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert plan.count("FlatMapGroupsInPandas") == 2


def test_residual_suite(spark, noisy):
    parts = D.stl(series(spark, a=noisy), KEYS, 24)
    row = Z.residual_tests(parts, KEYS).first()
    assert row.error is None and row.adf_test.is_stationary and row.kpss_test.is_stationary
    with pytest.raises(ValueError):
        Z.residual_tests(parts.drop("resid"), KEYS)
    few = parts.limit(12)
    assert Z.residual_tests(few.withColumn("pos", F.monotonically_increasing_id()), KEYS).first().error


def test_long_windows():
    from gridtide.operators import loess

    y = np.random.default_rng(4).normal(size=3000).cumsum()
    w = np.random.default_rng(5).random(501)
    np.testing.assert_allclose(loess._weighted_runs(y, w), np.convolve(y, w[::-1], mode="valid"), rtol=1e-9, atol=1e-9)
    fast = loess.smooth(y, 601)
    slow, _ = loess.smooth_at(y, 601, np.arange(3000))
    np.testing.assert_allclose(fast, slow, atol=1e-9)


def test_shuffle_size(spark):
    from gridtide.session import size_shuffles

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 1 << 30, 64 << 20) == 16
        assert size_shuffles(spark, 1, 64 << 20) == 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
