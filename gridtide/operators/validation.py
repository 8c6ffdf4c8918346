"""Chronological training sessions: split, cross-validation, grid search, run records."""

from __future__ import annotations

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import DataFrame, Window as W, functions as F

from gridtide.operators import linear
from gridtide.operators.models import LOWER, PREDICTED, UPPER, LinearForecaster, make_model
from gridtide.operators.ordering import position_in_order
from gridtide.operators.statistics import regression_scores
from gridtide.session import cut_lineage

PARALLEL_JOBS = 4


def placed(df: DataFrame, ts: str, order=()) -> DataFrame:
    """Adds ``pos`` in time order, the basis of splits and folds."""
    return position_in_order(df, [], ts, order)


def split_at(frame: DataFrame, n: int, test_size: float) -> tuple[DataFrame, DataFrame]:
    """Train and test by position."""
    cut = int(n * (1 - test_size))
    return frame.where(F.col("pos") < cut), frame.where(F.col("pos") >= cut)


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """(first test position, end) of each expanding fold."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    size = n // (k + 1)
    if size == 0:
        raise ValueError("too few rows for the folds")
    return [(n - (k - i) * size, n - (k - i) * size + size) for i in range(k)]


def _fold_score(frame, features, target, name, params, bounds) -> dict:
    begin, end = bounds
    model = make_model(name, **params).fit(frame.where(F.col("pos") < begin), features, target)
    scored = model.predict(frame.where((F.col("pos") >= begin) & (F.col("pos") < end)))
    return regression_scores(scored, target, PREDICTED).first().asDict()


def _scores(frame, features, target, name, settings, k, n) -> list[tuple[int, int, dict]]:
    """(setting, fold, scores) of all fits.

    Linear models share three passes over the rows; other models are fitted one by one, in jobs from a small thread pool.
    """
    bounds = fold_bounds(n, k)
    models = [make_model(name, **s) for s in settings]
    if all(isinstance(m, LinearForecaster) for m in models):
        return linear.fold_scores(frame, features, target, [(m.kind, m.alpha, m.l1_ratio) for m in models], bounds)
    jobs = [(s, i) for s in range(len(settings)) for i in range(k)]
    with ThreadPoolExecutor(PARALLEL_JOBS) as pool:
        done = pool.map(lambda j: _fold_score(frame, features, target, name, settings[j[0]], bounds[j[1]]), jobs)
        return [(s, i, scores) for (s, i), scores in zip(jobs, done)]


def cross_validate(
    frame: DataFrame, features: list[str], target: str, name: str, params: dict | None = None, k: int = 5,
    n: int | None = None,
) -> DataFrame:
    """Mean mae, mse, r2 over folds and the population deviation of mae (M9)."""
    n = frame.count() if n is None else n
    rows = _scores(frame, features, target, name, [params or {}], k, n)
    table = frame.sparkSession.createDataFrame(
        [(i, s["mae"], s["mse"], s["r2"]) for _, i, s in rows], "fold int, mae double, mse double, r2 double",
    )
    return table.agg(
        F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.avg("r2").alias("r2"), F.stddev_pop("mae").alias("mae_std"),
    ).withColumn("cv_folds", F.lit(k))


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """All combinations of a parameter grid."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_search(
    frame: DataFrame, features: list[str], target: str, name: str, grid: dict[str, list], k: int = 5,
    base: dict | None = None, n: int | None = None,
) -> tuple[dict, DataFrame]:
    """Best parameters by mean squared error over folds, and the ranked results."""
    n = frame.count() if n is None else n
    settings = [{**(base or {}), **s} for s in expand_grid(grid)]
    rows = _scores(frame, features, target, name, settings, k, n)
    spark = frame.sparkSession
    table = spark.createDataFrame(
        [(s, i, -scores["mse"]) for s, i, scores in rows], "setting int, fold int, score double",
    )
    means = table.groupBy("setting").agg(
        F.avg("score").alias("mean_test_score"), F.stddev_pop("score").alias("std_test_score"),
    )
    labels = spark.createDataFrame(
        [(s, json.dumps(p, sort_keys=True, default=str)) for s, p in enumerate(settings)], "setting int, params string",
    )
    ranked = means.join(labels, "setting").withColumn(
        "rank_test_score", F.rank().over(W.orderBy(F.desc("mean_test_score"))),  # one row per setting
    )
    best = ranked.orderBy("rank_test_score", "setting").first()["setting"]
    return settings[best], ranked.drop("setting")


# Default parameter ranges by model family.
DEFAULT_GRIDS = {
    "xgboost": {"n_estimators": list(range(100, 501, 50)), "max_depth": list(range(4, 11)), "learning_rate": [0.01, 0.2]},
    "lightgbm": {"n_estimators": list(range(100, 501, 50)), "max_depth": list(range(4, 11)), "learning_rate": [0.01, 0.2]},
    "catboost": {"n_estimators": list(range(100, 501, 50)), "depth": list(range(4, 11)), "learning_rate": [0.01, 0.2]},
    "arima": {"order": [(p, d, q) for p in range(4) for d in range(2) for q in range(4)]},
    "holt-winters": {"seasonal_periods": list(range(6, 13)), "trend": ["add", None], "seasonal": ["add", None]},
}


def default_grid(name: str) -> dict[str, list]:
    """Parameter ranges offered for a model; linear models have none."""
    return dict(DEFAULT_GRIDS.get(name.lower().replace(" ", "-"), {}))


def forecast_table(scored: DataFrame, ts: str, target: str) -> DataFrame:
    """Time, actual, predicted and bounds where the model gives them."""
    bounds = [c for c in (LOWER, UPPER) if c in scored.columns]
    return scored.select(ts, F.col(target).alias("actual"), PREDICTED, *bounds)


def training_session(
    df: DataFrame, ts: str, features: list[str], target: str, name: str, params: dict | None = None,
    test_size: float = 0.2, cv_folds: int | None = None, grid: dict | None = None, run_name: str | None = None,
) -> dict:
    """Split, validate or search, fit, predict and score.

    Returns the model, the test predictions, a one-row run record and any search results.
    """
    frame = cut_lineage(placed(df.select(ts, *features, target).na.drop(), ts))
    n = frame.count()
    train, test = split_at(frame, n, test_size)
    cut = int(n * (1 - test_size))
    chosen, search, folds = dict(params or {}), None, None
    if grid:
        best, search = grid_search(train, features, target, name, grid, cv_folds or 5, chosen, cut)
        chosen.update(best)
    elif cv_folds:
        folds = cross_validate(train, features, target, name, chosen, cv_folds, cut)
    model = make_model(name, **chosen).fit(train, features, target)
    scored = model.predict(test)
    scores = regression_scores(scored, target, PREDICTED)
    record = scores.select(
        F.lit(run_name or name).alias("run"), F.lit(name).alias("model"),
        F.lit("grid" if grid else "cv" if cv_folds else "plain").alias("training"),
        F.lit(dt.datetime.now(dt.timezone.utc).isoformat()).alias("trained_at_utc"),
        F.lit(json.dumps(chosen, sort_keys=True, default=str)).alias("params"), F.lit(json.dumps(features)).alias("features"),
        "mae", "mse", "r2",
    )
    return {"model": model, "predictions": forecast_table(scored, ts, target), "run": record, "search": search, "folds": folds,
            "params": chosen, "frame": frame}


def append_run(record: DataFrame, path: str) -> None:
    """Adds a run to the stored run table."""
    record.write.mode("append").parquet(path)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Runs, best first."""
    return runs.orderBy("mae", "run")
