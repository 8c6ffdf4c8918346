"""Regression models behind one small protocol."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridtide.operators import boosting, linear

PREDICTED, LOWER, UPPER = "predicted", "predicted_lower", "predicted_upper"


@runtime_checkable
class Forecaster(Protocol):
    """What a model offers."""

    needs_scaling: bool
    supports_grid: bool
    supports_attribution: bool

    def fit(self, train: DataFrame, features: list[str], target: str): ...

    def predict(self, df: DataFrame) -> DataFrame: ...

    def importance(self, spark) -> DataFrame: ...


def _importance_frame(spark, features, values) -> DataFrame:
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double",
    )


@dataclass
class LinearForecaster:
    """Ridge, lasso or elastic net on standardised features (M4, M7).

    ``alpha`` and ``l1_ratio`` are those of the usual coordinate-descent formulation. ``weights`` belong to the
    standardised features; features are standardised by their population deviation in the training rows.
    """

    kind: str = "ridge"
    alpha: float = 1.0
    l1_ratio: float = 0.5
    needs_scaling = True
    supports_grid = True
    supports_attribution = True
    features: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    centers: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, train: DataFrame, features: list[str], target: str):
        self.features = list(features)
        found = linear.fit(train, self.features, target, self.kind, self.alpha, self.l1_ratio)
        self.weights, self.centers, self.scales = (x.tolist() for x in (found.weights, found.centers, found.scales))
        self.intercept = found.intercept
        return self

    def _found(self) -> linear.LinearFit:
        return linear.LinearFit(*(np.array(x) for x in (self.weights, self.centers, self.scales)), self.intercept)

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTED, linear.predicted(self._found(), self.features))

    def importance(self, spark) -> DataFrame:
        return _importance_frame(spark, self.features, [abs(w) for w in self.weights])

    def attributions(self, df: DataFrame) -> DataFrame:
        """Exact additive parts ``weight * (x - mean) / deviation`` per feature and the base value."""
        parts = linear.parts(self._found(), self.features)
        return self.predict(df).withColumns({**{f"attribution_{f}": c for f, c in zip(self.features, parts)}, "base_value": F.lit(self.intercept)})


@dataclass
class BoostedForecaster:
    """Boosted trees of one of three families; with ``alpha`` three quantile models give an interval (M2, M3).

    Quantile models grow on the slopes of the pinball loss and set every leaf to the quantile of its residuals.
    """

    family: str = "xgboost"
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    alpha: float | None = None
    needs_scaling = False
    supports_grid = True
    supports_attribution = True
    features: list[str] = field(default_factory=list)
    trees: dict[str, boosting.Trees] = field(default_factory=dict)

    def _levels(self) -> dict[str, float | None]:
        return {PREDICTED: 0.5, LOWER: self.alpha / 2, UPPER: 1 - self.alpha / 2} if self.alpha else {PREDICTED: None}

    def fit(self, train: DataFrame, features: list[str], target: str):
        self.features = list(features)
        levels = self._levels()
        made = boosting.fit(train, self.features, target, self.family, self.n_estimators, self.max_depth, self.learning_rate, tuple(levels.values()))
        self.trees = dict(zip(levels, made))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf(", ".join(f"{name} double" for name in trees))
        def score(x: pd.DataFrame) -> pd.DataFrame:
            values = x.to_numpy(float)
            return pd.DataFrame({name: t.predict(values) for name, t in trees.items()})

        inputs = F.struct(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(self.features)])
        scored = df.withColumn("scored_", score(inputs))
        return scored.withColumns({name: F.col(f"scored_.{name}") for name in trees}).drop("scored_")

    def importance(self, spark) -> DataFrame:
        return _importance_frame(spark, self.features, self.trees[PREDICTED].importances(len(self.features)))


def _write_json(spark, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _linear(kind):
    return lambda **p: LinearForecaster(kind, **p)


def _boosted(family):
    def build(**p):
        if "depth" in p:
            p["max_depth"] = p.pop("depth")
        return BoostedForecaster(family, **p)

    return build


MODELS = {
    "xgboost": _boosted("xgboost"),
    "lightgbm": _boosted("lightgbm"),
    "catboost": _boosted("catboost"),
    "ridge": _linear("ridge"),
    "lasso": _linear("lasso"),
    "elasticnet": _linear("elasticnet"),
}
UNIVARIATE = ("holt-winters", "arima")


def make_model(name: str, **params):
    """Model by name, case and spaces ignored (M1)."""
    key = name.lower().replace(" ", "-")
    if key in UNIVARIATE:
        from gridtide.operators.univariate import Arima, HoltWinters

        return (HoltWinters if key == "holt-winters" else Arima)(**params)
    if key not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join([*MODELS, *UNIVARIATE])}")
    return MODELS[key](**params)


def top_importances(importance: DataFrame, top: int = 20) -> DataFrame:
    """Largest importances first."""
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(top)


def shapley_attributions(model, df: DataFrame, background: DataFrame, row_id: str) -> DataFrame:
    """Exact Shapley values against all rows of ``background``, long form.

    ``base_value`` is the mean prediction of the background; it and the row's parts sum to the row's prediction.
    """
    if isinstance(model, BoostedForecaster):
        return boosting.attributions(model.trees[PREDICTED], df, background, model.features, row_id)
    if not isinstance(model, LinearForecaster):
        raise ValueError("this model has no attributions")
    means = background.agg(F.count("*"), *[F.avg(f) for f in model.features]).first()
    if not means[0]:
        raise ValueError("no background rows")
    weights = [w / s for w, s in zip(model.weights, model.scales)]
    base = model.intercept + sum(w * (m - c) for w, m, c in zip(weights, means[1:], model.centers))
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), ((F.col(f) - F.lit(m)) * F.lit(w)).alias("attribution")) for f, m, w in zip(model.features, means[1:], weights)])
    return df.select(row_id, F.explode(parts).alias("p")).select(row_id, "p.feature", "p.attribution", F.lit(float(base)).alias("base_value"))


def save_bundle(model, path: str, spark, metadata: dict | None = None) -> None:
    """Model directory plus one metadata record."""
    meta = {
        "kind": type(model).__name__, "features": getattr(model, "features", []),
        "params": {k: v for k, v in vars(model).items() if isinstance(v, (int, float, str, bool, list, tuple, type(None)))},
        **(metadata or {}),
    }
    if hasattr(model, "state"):
        meta["state"] = model.state
    for name, trees in getattr(model, "trees", {}).items():
        _write_json(spark, trees.to_json(), f"{path}/{name}")
    _write_json(spark, meta, f"{path}/metadata")


def load_bundle(path: str, spark):
    """(model, metadata), or (None, None) where there is no bundle."""
    try:
        meta = _read_json(spark, f"{path}/metadata")
    except Exception as error:  # only a missing path means "no bundle"
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, None
    params = {k: v for k, v in meta["params"].items() if k != "features"}
    if meta["kind"] == "LinearForecaster":
        model = LinearForecaster(**params)
    elif meta["kind"] == "BoostedForecaster":
        model = BoostedForecaster(**params)
        model.trees = {name: boosting.Trees(**_read_json(spark, f"{path}/{name}")) for name in model._levels()}
    else:
        from gridtide.operators import univariate

        return univariate.load(meta, path, spark), meta
    model.features = meta["features"]
    return model, meta


def score_table(model, metadata: dict, df: DataFrame, keep=()) -> DataFrame:
    """Predictions for new rows from a loaded bundle (M19); a missing feature is an error."""
    lacking = [f for f in metadata["features"] if f not in df.columns]
    if lacking:
        raise ValueError(f"missing features: {', '.join(lacking)}")
    wanted = list(dict.fromkeys([*keep, *metadata["features"]]))
    return model.predict(df.select(*wanted)).withColumnRenamed(PREDICTED, "prediction")
