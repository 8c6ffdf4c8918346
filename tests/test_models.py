import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.operators import boosting, models as M, univariate as U, validation as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 240
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, -3]
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, pos=np.arange(n))
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.pos, unit="h")
    return pdf, spark.createDataFrame(pdf).persist()


def standardised(pdf):
    x = pdf[["a", "b", "c"]].to_numpy()
    return (x - x.mean(0)) / x.std(0), pdf.y.to_numpy()


def coordinate_descent(z, y, alpha, ratio, rounds=2000):
    w, n, e = np.zeros(z.shape[1]), len(y), y - y.mean()
    for _ in range(rounds):
        for j in range(z.shape[1]):
            rho = z[:, j] @ (e - z @ w + z[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / ((z[:, j] ** 2).mean() + alpha * (1 - ratio))
    return w


def test_ridge_closed_form(data):
    pdf, df = data
    z, y = standardised(pdf)
    model = M.make_model("Ridge", alpha=30.0).fit(df, ["a", "b", "c"], "y")
    want = np.linalg.solve(z.T @ z + 30 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(model.weights, want, rtol=1e-9)


@pytest.mark.parametrize("name, params", [("lasso", {"alpha": 0.7}), ("elasticnet", {"alpha": 1.5, "l1_ratio": 0.3})])
def test_l1_models(data, name, params):
    pdf, df = data
    z, y = standardised(pdf)
    model = M.make_model(name, **params).fit(df, ["a", "b", "c"], "y")
    want = coordinate_descent(z, y, params["alpha"], params.get("l1_ratio", 1.0))
    np.testing.assert_allclose(model.weights, want, atol=1e-9)


@pytest.mark.parametrize("name", ["ridge", "lasso", "elasticnet"])
def test_folds_and_grids_equal_one_fit_each(data, name):
    pdf, df = data
    ratio = {"l1_ratio": 0.4} if name == "elasticnet" else {}
    settings = [{"alpha": a, **ratio} for a in (0.01, 0.5, 20.0)]
    got = V._scores(df, ["a", "b", "c"], "y", name, settings, 4, len(pdf))
    assert [(s, i) for s, i, _ in got] == [(s, i) for s in range(3) for i in range(4)]
    for s, i, scores in got:
        begin, end = V.fold_bounds(len(pdf), 4)[i]
        model = M.make_model(name, **settings[s]).fit(df.where(F.col("pos") < begin), ["a", "b", "c"], "y")
        x = pdf[["a", "b", "c"]].to_numpy()[begin:end]
        e = pdf.y.to_numpy()[begin:end] - model.intercept - (x - model.centers) / model.scales @ np.array(model.weights)
        want = {"mse": (e**2).mean(), "mae": np.abs(e).mean(), "r2": 1 - (e**2).mean() / pdf.y.to_numpy()[begin:end].var()}
        assert scores == pytest.approx(want, rel=1e-9)


def test_linear_edge_rows(data, spark, tmp_path):
    _, df = data
    odd = df.withColumns({"flat": F.lit(7.3), "far": F.col("a") + 1e7, "y": F.when(F.col("pos") % 9 > 0, F.col("y"))})
    model = M.make_model("ridge", alpha=1e-6).fit(odd, ["flat", "far", "b"], "y")
    plain = M.make_model("ridge", alpha=1e-6).fit(odd, ["a", "b"], "y")
    assert model.weights[0] == 0.0 and model.weights[1:] == pytest.approx(plain.weights, rel=1e-6)
    M.save_bundle(model, str(tmp_path / "linear"), spark)
    loaded, _ = M.load_bundle(str(tmp_path / "linear"), spark)
    assert loaded == model
    with pytest.raises(ValueError, match="null features: a"):
        M.make_model("ridge").fit(df.withColumn("a", F.when(F.col("pos") > 3, F.col("a"))), ["a", "b"], "y")
    with pytest.raises(ValueError, match="no training rows"):
        M.make_model("ridge").fit(df.where("pos < 0"), ["a", "b"], "y")


def test_linear_attributions_add_up(data):
    _, df = data
    model = M.make_model("ridge").fit(df, ["a", "b", "c"], "y")
    out = model.attributions(df).withColumn(
        "sum", F.col("base_value") + F.col("attribution_a") + F.col("attribution_b") + F.col("attribution_c"),
    )
    assert out.agg(F.max(F.abs(F.col("sum") - F.col("predicted")))).first()[0] < 1e-8


def test_boosted_family(data, spark, tmp_path):
    _, df = data
    model = M.make_model("CatBoost", n_estimators=5, depth=3).fit(df, ["a", "b", "c"], "y")
    assert model.max_depth == 3 and isinstance(model, M.Forecaster)
    importance = M.top_importances(model.importance(spark), 2).collect()
    assert len(importance) == 2 and importance[0].importance >= importance[1].importance
    M.save_bundle(model, str(tmp_path / "gbt"), spark, {"metrics": {"mae": 1.0}})
    loaded, meta = M.load_bundle(str(tmp_path / "gbt"), spark)
    assert meta["metrics"] == {"mae": 1.0}
    scored = M.score_table(loaded, meta, df, keep=["pos"])
    first = model.predict(df).orderBy("pos").first().predicted
    assert scored.orderBy("pos").first().prediction == pytest.approx(first)
    with pytest.raises(ValueError, match="missing features: c"):
        M.score_table(loaded, meta, df.drop("c"))
    assert M.load_bundle(str(tmp_path / "none"), spark) == (None, None)


def plain_shapley(predict, x, background):
    """By all subsets of the features."""
    d = x.shape[1]
    out = np.zeros(x.shape)
    for mask in range(1 << d):
        taken = np.array([mask >> i & 1 for i in range(d)], bool)
        value = np.array([predict(np.where(taken, row, background)).mean() for row in x])
        size = int(taken.sum())
        for i in range(d):
            if taken[i]:
                out[:, i] += value * math.factorial(size - 1) * math.factorial(d - size) / math.factorial(d)
            else:
                out[:, i] -= value * math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
    return out


@pytest.mark.parametrize("name", ["xgboost", "lightgbm", "catboost"])
def test_attributions_equal_all_subsets(spark, name):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (300, 5)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    filled = np.nan_to_num(x, nan=11.0)
    y = filled[:, 0] * filled[:, 1] + 5 * (filled[:, 2] > 4) - filled[:, 3] + rng.normal(size=300)
    names = list("abcde")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y, pos=range(300))).repartition(3)
    model = M.make_model(name, n_estimators=4, max_depth=4, learning_rate=0.5).fit(df, names, "y")
    out = M.shapley_attributions(model, df.where("pos < 20"), df.where("pos >= 100"), "pos").toPandas()
    assert len(out) == 100
    got = out.pivot(index="pos", columns="feature", values="attribution").sort_index()[names].to_numpy()
    trees = model.trees["predicted"]
    np.testing.assert_allclose(got, plain_shapley(trees.predict, x[:20], x[100:]), atol=1e-9)
    np.testing.assert_allclose(out.base_value, trees.predict(x[100:]).mean())
    np.testing.assert_allclose(got.sum(axis=1) + out.base_value[0], trees.predict(x[:20]))
    with pytest.raises(ValueError):
        M.shapley_attributions(M.make_model("arima"), df, df, "pos")
    with pytest.raises(ValueError):
        M.shapley_attributions(model, df, df.where("pos < 0"), "pos")


@pytest.mark.parametrize("name, quantiles", [("xgboost", (None,)), ("lightgbm", (None, 0.3)), ("catboost", (None,))])
def test_boosting_is_the_same_in_passes_over_rows(data, name, quantiles):
    _, df = data
    a, b = (boosting.fit(df, ["a", "b", "c"], "y", name, 3, 3, 0.4, quantiles, n) for n in (10_000, 10))
    for one, other in zip(a, b):
        assert one.feature == other.feature and one.threshold == other.threshold
        assert one.value == pytest.approx(other.value) and one.start == pytest.approx(other.start)


def test_more_values_than_bins(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=3000)
    x[:40] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.where(np.isnan(x), 9.0, np.sin(x)), "pos": range(3000)}))
    (trees,) = boosting.fit(df, ["x"], "y", "xgboost", 20, 5, 0.3)
    assert np.abs(trees.predict(x[40:, None]) - np.sin(x[40:])).mean() < 0.1
    assert len(boosting.bin_cuts(df, ["x"])[0]) == boosting.BINS - 1
    with pytest.raises(ValueError):
        boosting.fit(df.where("pos < 0"), ["x"], "y", "xgboost", 1, 1, 0.3)


def test_families_grow_differently(data):
    pdf, df = data
    x = pdf[["a", "b", "c"]].to_numpy()
    found = {}
    for name in boosting.FAMILIES:
        model = M.make_model(name, n_estimators=30, max_depth=4, learning_rate=0.3).fit(df, ["a", "b", "c"], "y")
        trees = model.trees["predicted"]
        found[name] = trees.predict(x)
        assert ((found[name] - pdf.y) ** 2).mean() < 0.2 * pdf.y.var()
        np.testing.assert_allclose(model.predict(df).orderBy("pos").toPandas().predicted, found[name])
        if name == "catboost":  # one condition a level
            level = [trees.roots[0]]
            while trees.feature[level[0]] >= 0:
                assert len({(trees.feature[n], trees.threshold[n]) for n in level}) == 1
                level = [c for n in level for c in (trees.left[n], trees.right[n])]
        if name == "lightgbm":
            node = trees.leaves_of(x)[:, 0]
            assert min(np.bincount(node)[np.unique(node)]) >= 20
    assert len({round(float(np.abs(f).sum()), 6) for f in found.values()}) == 3


def test_quantile_intervals(data, spark, tmp_path):
    _, df = data
    model = M.make_model("lightgbm", n_estimators=5, max_depth=3, learning_rate=0.7, alpha=0.2).fit(df, ["a", "b", "c"], "y")
    out = model.predict(df)
    inside = out.agg(F.avg(F.col("y").between(F.col("predicted_lower"), F.col("predicted_upper")).cast("int"))).first()[0]
    assert 0.7 < inside < 0.95
    M.save_bundle(model, str(tmp_path / "q"), spark)
    loaded, _ = M.load_bundle(str(tmp_path / "q"), spark)
    both = out.join(loaded.predict(df).select("pos", F.col("predicted_upper").alias("again")), "pos")
    assert both.agg(F.max(F.abs(F.col("again") - F.col("predicted_upper")))).first()[0] < 1e-12


def test_unknown_model():
    with pytest.raises(ValueError):
        M.make_model("prophet")
    assert isinstance(M.make_model("Holt Winters"), U.HoltWinters)


def test_fold_bounds():
    assert V.fold_bounds(10, 3) == [(4, 6), (6, 8), (8, 10)]
    for n, k in ((10, 1), (2, 5)):
        with pytest.raises(ValueError):
            V.fold_bounds(n, k)


def test_session_with_grid(data, spark, tmp_path):
    _, df = data
    done = V.training_session(df, "ts", ["a", "b"], "y", "ridge", grid={"alpha": [1.0, 1e5]}, cv_folds=3)
    assert done["params"] == {"alpha": 1.0}
    ranks = done["search"].orderBy("rank_test_score").collect()
    assert json.loads(ranks[0].params) == {"alpha": 1.0} and ranks[0].mean_test_score > ranks[1].mean_test_score
    assert done["predictions"].count() == 240 - int(240 * 0.8)
    V.append_run(done["run"], str(tmp_path / "runs"))
    plain = V.training_session(df, "ts", ["b"], "y", "ridge", run_name="b only", cv_folds=2)
    assert plain["folds"].first().cv_folds == 2
    V.append_run(plain["run"], str(tmp_path / "runs"))
    assert [r.run for r in V.compare_runs(spark.read.parquet(str(tmp_path / "runs"))).collect()] == ["ridge", "b only"]


def test_default_grids():
    assert len(V.expand_grid(V.default_grid("arima"))) == 32
    assert V.default_grid("ridge") == {}


def walks(spark):
    rng = np.random.default_rng(0)
    n = 600
    e = rng.normal(size=n + 1)
    w = np.zeros(n)
    for i in range(1, n):
        w[i] = 0.6 * w[i - 1] + e[i + 1] + 0.4 * e[i]
    t = np.arange(n)
    season = 50 + 0.05 * t + 10 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.5, n)
    frames = [pd.DataFrame({"s": k, "pos": t, "value": v}) for k, v in (("arima", np.cumsum(w)), ("season", season))]
    return spark.createDataFrame(pd.concat(frames)), season


def test_arima(spark):
    df, _ = walks(spark)
    whole = {r.s: r for r in U.fit_arima(df, ["s"], (1, 1, 1)).collect()}
    cut = {r.s: r for r in U.fit_arima(df, ["s"], (1, 1, 1), chunk=250).collect()}
    assert whole["arima"].coefficients == pytest.approx([0.6, 0.4], abs=0.12)
    assert whole["arima"].variance == pytest.approx(1.0, abs=0.15)
    for s in whole:
        assert cut[s].coefficients == pytest.approx(whole[s].coefficients, abs=1e-6)


def residuals(y, theta, order):
    """The recursion of conditional least squares, step by step."""
    p, d, q = order
    w, c = np.diff(y, d) if d else y, theta[-1] if d == 0 else 0.0
    e = np.zeros(len(w))
    for t in range(p, len(w)):
        e[t] = w[t] - c - sum(theta[i] * (w[t - 1 - i] - c) for i in range(p)) - sum(theta[p + j] * e[t - 1 - j] for j in range(min(q, t - p)))
    return e


@pytest.mark.parametrize("order", [(0, 1, 1), (1, 1, 1), (2, 0, 2), (2, 1, 0), (0, 1, 3)])
def test_arima_is_a_least_squares_solution(spark, order):
    """Whole and in chunks: the loss is that of the plain recursion, no step aside lowers it, forecasts agree."""
    df, _ = walks(spark)
    y = df.where("s = 'arima'").orderBy("pos").toPandas()["value"].to_numpy()
    df = df.where("s = 'arima'")
    whole, cut = (U.fit_arima(df, ["s"], order, chunk=c) for c in (10_000, 130))
    a, b = whole.first(), cut.first()
    assert b.coefficients == pytest.approx(a.coefficients, abs=1e-6) and b.rows == a.rows and b.tail == pytest.approx(a.tail)
    theta = np.array(a.coefficients)
    e = residuals(y, theta, order)
    assert a.sse == pytest.approx(e @ e, rel=1e-9) and a.gradient < 1e-5 and b.gradient < 1e-5
    assert a.residuals == pytest.approx(e[::-1][: order[2]])
    for i in range(len(theta)):
        for step in (-1e-3, 1e-3):
            aside = residuals(y, theta + step * np.eye(len(theta))[i], order)
            assert aside @ aside > a.sse
    steps = [U.forecast_arima(f, ["s"], order, 5).orderBy("h").toPandas()["predicted_upper"].to_numpy() for f in (whole, cut)]
    np.testing.assert_allclose(steps[0], steps[1], rtol=1e-6)


def test_given_coefficients(spark):
    df, _ = walks(spark)
    df = df.where("s = 'arima'")
    y = df.orderBy("pos").toPandas()["value"].to_numpy()
    for chunk in (10_000, 100):
        one = U.fit_arima(df, ["s"], (1, 1, 1), chunk, coefficients=(0.5, 0.25)).first()
        e = residuals(y, np.array([0.5, 0.25]), (1, 1, 1))
        assert one.coefficients == [0.5, 0.25] and one.sse == pytest.approx(e @ e) and one.residuals == pytest.approx([e[-1]])
    with pytest.raises(ValueError):
        U.fit_arima(df, ["s"], (1, 1, 1), coefficients=(0.5,))


@pytest.mark.parametrize("trend, seasonal, period", [("add", "add", 12), (None, "add", 7), ("add", None, 12), (None, None, 2)])
def test_smoothing_in_chunks_equals_the_recursion(spark, trend, seasonal, period):
    df, season = walks(spark)
    df = df.where("s = 'season'")
    a, b, g = 0.3, 0.2, 0.4
    cycle = period if seasonal else 10
    level, slope = season[:cycle].mean(), (season[cycle : 2 * cycle].mean() - season[:cycle].mean()) / cycle if trend else 0.0
    states, sse = list(season[:cycle] - level) if seasonal else [0.0], 0.0
    for t, y in enumerate(season):
        now, base = states[t % len(states)], level + slope
        sse += (y - base - now) ** 2
        new = a * (y - now) + (1 - a) * base
        slope = b * (new - level) + (1 - b) * slope if trend else 0.0
        if seasonal:
            states[t % len(states)] = g * (y - base) + (1 - g) * now
        level = new
    for chunk in (10_000, 50):
        got = U.fit_holt_winters(df, ["s"], trend, seasonal, period, chunk=chunk, parameters=(a, b, g)).first()
        assert (got.sse, got.level, got.slope, got.rows) == pytest.approx((sse, level, slope, 600), rel=1e-9)
        assert got.season == pytest.approx(states)
    searched = [U.fit_holt_winters(df, ["s"], trend, seasonal, period, chunk=c).first() for c in (10_000, 100)]
    assert searched[0][1:4] == pytest.approx(searched[1][1:4]) and searched[0].sse == pytest.approx(searched[1].sse) and searched[0].sse <= sse


def test_multiplicative_season(spark):
    t = np.arange(240)
    y = (20 + 0.1 * t) * (1 + 0.5 * np.sin(2 * np.pi * t / 12))
    df = spark.createDataFrame(pd.DataFrame({"s": "m", "pos": t, "value": y}))
    whole, cut = (U.fit_holt_winters(df, ["s"], "add", "mul", 12, chunk=c) for c in (1000, 60))
    assert whole.first().sse == pytest.approx(cut.first().sse)
    fc = U.forecast_holt_winters(whole, ["s"], 12, "add", "mul", 12).orderBy("h").toPandas().predicted
    h = np.arange(240, 252)
    assert np.abs(fc - (20 + 0.1 * h) * (1 + 0.5 * np.sin(2 * np.pi * h / 12))).max() < 1


def test_grid_is_the_same_in_memory_and_by_chunks(spark):
    df, _ = walks(spark)
    settings = [{"order": o} for o in ((1, 0, 0), (1, 1, 1))]
    a, b = (U.grid_forecasts(df, ["s"], settings, "arima", 0.1, chunk=c).orderBy("s").collect() for c in (1000, 200))
    assert [r.setting for r in a] == [r.setting for r in b] and [r.mse for r in a] == pytest.approx([r.mse for r in b], rel=1e-4)
    smooth = [{"trend": t, "seasonal": s, "seasonal_periods": 12} for t, s in (("add", "add"), (None, None), (None, "mul"))]
    best = {r.s: r.setting for r in U.grid_forecasts(df, ["s"], smooth, "holt-winters", 0.1).collect()}
    assert "'add', 'seasonal': 'add'" in best["season"]


def test_random_walk_interval(spark):
    df, _ = walks(spark)
    fitted = U.fit_arima(df, ["s"], (0, 1, 0))
    got = U.forecast_arima(fitted, ["s"], (0, 1, 0), 4).where("s = 'arima'").orderBy("h").collect()
    half = [(r.predicted_upper - r.predicted_lower) / 2 for r in got]
    assert half[3] == pytest.approx(2 * half[0])
    assert len({r.predicted for r in got}) == 1


def test_holt_winters(spark):
    df, season = walks(spark)
    whole = U.fit_holt_winters(df, ["s"]).orderBy("s").toPandas()
    cut = U.fit_holt_winters(df, ["s"], chunk=200).orderBy("s").toPandas()
    np.testing.assert_allclose(cut.sse, whole.sse, rtol=1e-9)
    fc = U.forecast_holt_winters(U.fit_holt_winters(df, ["s"]), ["s"], 24).where("s = 'season'").orderBy("h").toPandas()
    h = np.arange(600, 624)
    truth = 50 + 0.05 * h + 10 * np.sin(2 * np.pi * h / 12)
    assert np.abs(fc.predicted - truth).max() < 2
    assert (fc.predicted_upper - fc.predicted_lower).is_monotonic_increasing
    with pytest.raises(ValueError):
        U.fit_holt_winters(df, ["s"], trend="log")


def test_univariate_session(spark, tmp_path):
    df, _ = walks(spark)
    rows = df.where("s = 'season'").select(F.timestamp_seconds(F.col("pos") * 3600).cast("timestamp_ntz").alias("ts"), "value")
    done = V.training_session(rows, "ts", [], "value", "holt-winters")
    assert done["run"].first().mae < 2
    table = done["predictions"].orderBy("ts").first()
    assert table.predicted_lower < table.predicted < table.predicted_upper
    M.save_bundle(done["model"], str(tmp_path / "hw"), spark)
    loaded, _ = M.load_bundle(str(tmp_path / "hw"), spark)
    assert loaded.forecast(spark, 1).first().predicted == pytest.approx(table.predicted)
