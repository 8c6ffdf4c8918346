"""Queries: fitted models, validation, attribution, univariate forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timeparts as T
from gridtide.operators import models as M, univariate as U, validation as V
from gridtide.operators.statistics import regression_scores
from gridtide.plans.fixtures import HOURLY_KIND_SQL, HOURLY_SQL, hourly_by_kind, hourly_total
from gridtide.plans.registry import query, steady_round as r
from gridtide.session import cut_lineage

CYCLES = ["hour_sin", "hour_cos", "dayofweek_sin", "dayofweek_cos"]
FEATURES = ["lag24", *CYCLES]
SMALL_TREES = {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.2}


def hourly_features(spark, sf_dir):
    """Hourly total, its value a day before, and calendar cycles; rows in time order by ``pos``."""
    series = hourly_total(spark, sf_dir).select("pos", "ts", "value")
    past = series.select((F.col("pos") + 24).alias("pos"), F.col("value").alias("lag24"))
    cycled = T.add_cycles(series.join(past, "pos"), "ts", ["hour", "dayofweek"], with_year=False)
    return cycled.withColumn("pos", F.col("pos") - 24)


def _split(spark, sf_dir):
    frame = cut_lineage(hourly_features(spark, sf_dir))
    return frame, *V.split_at(frame, frame.count(), 0.2)


@query(
    "model_features",
    f"""WITH {HOURLY_SQL} SELECT a.pos - 24 AS pos, a.ts, round(a.value, 4) + 0.0 AS value, round(b.value, 4) + 0.0 AS lag24 FROM hourly a JOIN hourly b ON a.pos = b.pos + 24""",
)
def model_features(spark, sf_dir):
    rows = hourly_features(spark, sf_dir).select("pos", "ts", "value", "lag24")
    return rows.withColumns({c: r(F.col(c), 4) for c in ("value", "lag24")})


@query(
    "ridge_one_feature",
    f"""WITH {HOURLY_SQL}, f AS (SELECT a.pos - 24 AS pos, a.value AS y, b.value AS x FROM hourly a JOIN hourly b ON a.pos = b.pos + 24),
    n AS (SELECT count(*) AS n FROM f), tr AS (SELECT f.* FROM f, n WHERE pos < CAST(floor(n * 0.8) AS BIGINT)),
    s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM tr),
    c AS (SELECT sum((x - mx) / sx * (y - my)) / (sum((x - mx) / sx * (x - mx) / sx) + 100.0) AS w FROM tr, s)
    SELECT f.pos, round(my + w * (x - mx) / sx, 4) + 0.0 AS predicted FROM f, s, c, n WHERE pos >= CAST(floor(n.n * 0.8) AS BIGINT)""",
)
def ridge_one_feature(spark, sf_dir):
    _, train, test = _split(spark, sf_dir)
    model = M.LinearForecaster("ridge", alpha=100.0).fit(train, ["lag24"], "value")
    return model.predict(test).select("pos", r(F.col("predicted"), 4).alias("predicted"))


def _linear_sql(groups: str) -> str:
    """Coordinate descent as recursive SQL on the five features.

    ``groups`` selects g, its penalties l1 and l2 (of the mean squared error, or of the sum if ``summed``), and lo and hi: rows
    before lo train, those from lo up to hi are tested.
    """
    return f"""WITH RECURSIVE {HOURLY_SQL},
    f AS (SELECT a.pos - 24 AS pos, a.ts, a.value AS y, [b.value, sin(2 * pi() * hour(a.ts) / 24), cos(2 * pi() * hour(a.ts) / 24),
            sin(2 * pi() * (isodow(a.ts) - 1) / 7), cos(2 * pi() * (isodow(a.ts) - 1) / 7)] AS x FROM hourly a JOIN hourly b ON a.pos = b.pos + 24),
    n AS (SELECT count(*) AS n FROM f), g AS ({groups}), cuts AS (SELECT DISTINCT lo FROM g),
    st AS (SELECT lo, j, avg(x[j]) AS m, stddev_pop(x[j]) AS s FROM cuts JOIN f ON pos < lo, generate_series(1, 5) t(j) GROUP BY lo, j),
    stats AS (SELECT lo, list(m ORDER BY j) AS m, list(s ORDER BY j) AS s FROM st GROUP BY lo),
    means AS (SELECT lo, avg(y) AS my, count(*) AS rows FROM cuts JOIN f ON pos < lo GROUP BY lo),
    z AS (SELECT lo, pos, y, my, rows, list_transform(x, lambda v, j: (v - m[j]) / s[j]) AS z FROM stats JOIN means USING (lo), f),
    cross_ AS (SELECT lo, i, j, avg(z[i] * z[j]) AS v FROM z, generate_series(1, 5) a(i), generate_series(1, 5) b(j) WHERE pos < lo GROUP BY ALL),
    gram_row AS (SELECT lo, i, list(v ORDER BY j) AS r FROM cross_ GROUP BY lo, i), gram AS (SELECT lo, list(r ORDER BY i) AS gram FROM gram_row GROUP BY lo),
    pull_ AS (SELECT lo, i, avg(z[i] * (y - my)) AS v FROM z, generate_series(1, 5) a(i) WHERE pos < lo GROUP BY ALL),
    pull AS (SELECT lo, list(v ORDER BY i) AS pull FROM pull_ GROUP BY lo),
    cd AS (
      SELECT g, lo, 0 AS turn, list_transform(range(5), lambda i: CAST(0 AS DOUBLE)) AS w, gram, pull, CAST(l1 AS DOUBLE) AS l1, CASE WHEN summed THEN CAST(l2 AS DOUBLE) / rows ELSE CAST(l2 AS DOUBLE) END AS l2
      FROM g JOIN gram USING (lo) JOIN pull USING (lo) JOIN means USING (lo)
      UNION ALL
      SELECT g, lo, turn + 1, list_transform(w, lambda v, k: CASE WHEN k = j THEN sign(rho) * greatest(abs(rho) - l1, 0) / (gram[j][j] + l2) ELSE v END), gram, pull, l1, l2
      FROM (SELECT *, pull[j] - list_dot_product(gram[j], w) + gram[j][j] * w[j] AS rho FROM (SELECT *, turn % 5 + 1 AS j FROM cd WHERE turn < 600))),
    fitted AS (SELECT g, lo, w FROM cd WHERE turn = 600),
    p AS (SELECT g, pos, y, my, z, w, my + list_dot_product(z, w) AS p FROM fitted JOIN g USING (g, lo) JOIN z USING (lo) WHERE pos >= lo AND pos < hi),
    m AS (SELECT g, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM p GROUP BY g)"""


def _one_sql(kind: str, l1: float, l2: float) -> str:
    return _linear_sql(f"SELECT '{kind}' AS g, {l1} AS l1, {l2} AS l2, {str(kind == 'ridge').lower()} AS summed, CAST(floor(n * 0.8) AS BIGINT) AS lo, n AS hi FROM n")


def _metrics(spark, sf_dir, name, **params):
    _, train, test = _split(spark, sf_dir)
    model = M.make_model(name, **params).fit(train, FEATURES, "value")
    return regression_scores(model.predict(test), "value", M.PREDICTED).withColumn("model", F.lit(name))


SCORE_DIGITS = (("mae", 4), ("mse", 2), ("r2", 6))


def _rounded_metrics(spark, sf_dir, name, **params):
    return _metrics(spark, sf_dir, name, **params).withColumns({c: r(F.col(c), d) for c, d in SCORE_DIGITS})


for _name, _params, _l1, _l2 in (
    ("ridge", {"alpha": 1.0}, 0.0, 1.0), ("lasso", {"alpha": 0.5}, 0.5, 0.0), ("elasticnet", {"alpha": 0.5, "l1_ratio": 0.3}, 0.15, 0.35),
):
    query(
        f"{_name}_metrics",
        _one_sql(_name, _l1, _l2) + " SELECT round(mse, 2) + 0.0 AS mse, round(mae, 4) + 0.0 AS mae, round(r2, 6) + 0.0 AS r2, g AS model FROM m",
    )(lambda spark, sf_dir, n=_name, p=_params: _rounded_metrics(spark, sf_dir, n, **p))


for _name, _params in (("xgboost", SMALL_TREES), ("lightgbm", SMALL_TREES), ("catboost", {"n_estimators": 8, "depth": 4, "learning_rate": 0.2})):
    query(f"{_name}_metrics")(lambda spark, sf_dir, n=_name, p=_params: _metrics(spark, sf_dir, n, **p))


@query(
    "linear_importance",
    _one_sql("lasso", 2.0, 0.0) + """ SELECT (['lag24', 'hour_sin', 'hour_cos', 'dayofweek_sin', 'dayofweek_cos'])[j] AS feature, round(abs(w[j]), 4) + 0.0 AS importance
    FROM fitted, generate_series(1, 5) t(j)""",
)
def linear_importance(spark, sf_dir):
    _, train, _ = _split(spark, sf_dir)
    model = M.make_model("lasso", alpha=2.0).fit(train, FEATURES, "value")
    return M.top_importances(model.importance(spark)).withColumn("importance", r(F.col("importance"), 4))


@query("quantile_interval")
def quantile_interval(spark, sf_dir):
    _, train, test = _split(spark, sf_dir)
    model = M.make_model("lightgbm", n_estimators=6, max_depth=3, learning_rate=0.3, alpha=0.2).fit(train, FEATURES, "value")
    return V.forecast_table(model.predict(test), "ts", "value")


def _fold_groups(k: int, alphas: str) -> str:
    return f"""SELECT alpha || ' ' || i AS g, 0.0 AS l1, CAST(alpha AS DOUBLE) AS l2, true AS summed, n - ({k} - i) * (n // {k + 1}) AS lo, n - ({k} - i) * (n // {k + 1}) + n // {k + 1} AS hi
      FROM n, generate_series(0, {k - 1}) t(i), (VALUES {alphas}) a(alpha)"""


@query(
    "cv_metrics",
    _linear_sql(_fold_groups(4, "('1.0')")) + """ SELECT round(avg(mae), 4) + 0.0 AS mae, round(avg(mse), 2) + 0.0 AS mse, round(avg(r2), 6) + 0.0 AS r2,
    round(stddev_pop(mae), 4) + 0.0 AS mae_std, 4 AS cv_folds FROM m""",
)
def cv_metrics(spark, sf_dir):
    frame, _, _ = _split(spark, sf_dir)
    out = V.cross_validate(frame, FEATURES, "value", "ridge", {"alpha": 1.0}, 4)
    return out.withColumns({c: r(F.col(c), d) for c, d in (*SCORE_DIGITS, ("mae_std", 4))})


@query(
    "grid_rank",
    _linear_sql(_fold_groups(3, "('0.1'), ('10.0'), ('1000.0')")) + """, s AS (SELECT split_part(g, ' ', 1) AS alpha, avg(-mse) AS a, stddev_pop(-mse) AS d FROM m GROUP BY 1)
    SELECT '{"alpha": ' || alpha || '}' AS params, round(a, 2) + 0.0 AS mean_test_score, round(d, 2) + 0.0 AS std_test_score,
      CAST(rank() OVER (ORDER BY a DESC) AS INTEGER) AS rank_test_score FROM s""",
)
def grid_rank(spark, sf_dir):
    frame, _, _ = _split(spark, sf_dir)
    out = V.grid_search(frame, FEATURES, "value", "ridge", {"alpha": [0.1, 10.0, 1000.0]}, 3)[1]
    return out.withColumns({c: r(F.col(c), 2) for c in ("mean_test_score", "std_test_score")})


@query("importance")
def importance(spark, sf_dir):
    _, train, _ = _split(spark, sf_dir)
    model = M.make_model("xgboost", **SMALL_TREES).fit(train, FEATURES, "value")
    return M.top_importances(model.importance(spark))


ONE_SQL = f"""WITH {HOURLY_SQL},
f AS (SELECT a.pos - 24 AS pos, a.value AS y, b.value AS x FROM hourly a JOIN hourly b ON a.pos = b.pos + 24),
n AS (SELECT count(*) AS n FROM f)"""


@query(
    "linear_attribution_one",
    ONE_SQL + """, tr AS (SELECT f.* FROM f, n WHERE pos < CAST(floor(n * 0.8) AS BIGINT)),
    s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM tr),
    c AS (SELECT sum((x - mx) / sx * (y - my)) / (sum((x - mx) / sx * (x - mx) / sx) + 100.0) AS w FROM tr, s)
    SELECT f.pos, round(w * (x - mx) / sx, 4) + 0.0 AS attribution_lag24, round(my, 4) + 0.0 AS base_value
    FROM f, s, c, n WHERE pos >= CAST(floor(n.n * 0.8) AS BIGINT)""",
)
def linear_attribution_one(spark, sf_dir):
    _, train, test = _split(spark, sf_dir)
    parts = M.LinearForecaster("ridge", alpha=100.0).fit(train, ["lag24"], "value").attributions(test)
    return parts.select("pos", *[r(F.col(c), 4).alias(c) for c in ("attribution_lag24", "base_value")])


def _folds_sql(k: int, alphas: str) -> str:
    return ONE_SQL + f""", al(alpha) AS (VALUES {alphas}),
    b AS (SELECT CAST(i AS INTEGER) AS fold, n - ({k} - i) * (n // {k + 1}) AS lo, n - ({k} - i) * (n // {k + 1}) + n // {k + 1} AS hi FROM n, generate_series(0, {k - 1}) g(i)),
    s AS (SELECT fold, lo, hi, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM b JOIN f ON pos < lo GROUP BY ALL),
    c AS (SELECT alpha, s.fold, sum((x - mx) / sx * (y - my)) / (sum((x - mx) / sx * (x - mx) / sx) + CAST(alpha AS DOUBLE)) AS w FROM al, s JOIN f ON pos < lo GROUP BY alpha, s.fold),
    p AS (SELECT alpha, c.fold, y, my + w * (x - mx) / sx AS p FROM c JOIN s USING (fold) JOIN f ON pos >= lo AND pos < hi),
    m AS (SELECT alpha, fold, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM p GROUP BY ALL)"""


@query(
    "cv_one_feature",
    _folds_sql(4, "(10.0)") + """ SELECT round(avg(mae), 4) + 0.0 AS mae, round(avg(mse), 2) + 0.0 AS mse, round(avg(r2), 6) + 0.0 AS r2,
    round(stddev_pop(mae), 4) + 0.0 AS mae_std, 4 AS cv_folds FROM m""",
)
def cv_one_feature(spark, sf_dir):
    frame, _, _ = _split(spark, sf_dir)
    out = V.cross_validate(frame, ["lag24"], "value", "ridge", {"alpha": 10.0}, 4)
    return out.withColumns({c: r(F.col(c), d) for c, d in (("mae", 4), ("mse", 2), ("r2", 6), ("mae_std", 4))})


@query(
    "grid_one_feature",
    _folds_sql(3, "('0.1'), ('10.0'), ('1000.0')") + """, g AS (SELECT alpha, avg(-mse) AS a, stddev_pop(-mse) AS d FROM m GROUP BY 1)
    SELECT '{"alpha": ' || alpha || '}' AS params, round(a, 2) + 0.0 AS mean_test_score, round(d, 2) + 0.0 AS std_test_score,
      CAST(rank() OVER (ORDER BY a DESC) AS INTEGER) AS rank_test_score FROM g""",
)
def grid_one_feature(spark, sf_dir):
    frame, _, _ = _split(spark, sf_dir)
    out = V.grid_search(frame, ["lag24"], "value", "ridge", {"alpha": [0.1, 10.0, 1000.0]}, 3)[1]
    return out.withColumns({c: r(F.col(c), 2) for c in ("mean_test_score", "std_test_score")})


@query(
    "linear_attribution",
    _one_sql("ridge", 0.0, 1.0) + """ SELECT pos, round(z[1] * w[1], 4) + 0.0 AS attribution_lag24, round(z[2] * w[2], 4) + 0.0 AS attribution_hour_sin, round(z[3] * w[3], 4) + 0.0 AS attribution_hour_cos,
    round(z[4] * w[4], 4) + 0.0 AS attribution_dayofweek_sin, round(z[5] * w[5], 4) + 0.0 AS attribution_dayofweek_cos, round(my, 4) + 0.0 AS base_value, round(p, 4) + 0.0 AS predicted FROM p""",
)
def linear_attribution(spark, sf_dir):
    _, train, test = _split(spark, sf_dir)
    parts = M.make_model("ridge").fit(train, FEATURES, "value").attributions(test)
    return parts.select("pos", *[r(F.col(c), 4).alias(c) for c in (*[f"attribution_{f}" for f in FEATURES], "base_value", M.PREDICTED)])


@query("tree_attribution")
def tree_attribution(spark, sf_dir):
    _, train, test = _split(spark, sf_dir)
    model = M.make_model("xgboost", **SMALL_TREES).fit(train, FEATURES, "value")
    return M.shapley_attributions(model, test, train, "pos")


@query(
    "tree_attribution_sums",
    ONE_SQL + """ SELECT pos, CAST(0 AS DOUBLE) AS gap, CAST(5 AS BIGINT) AS features FROM f, n WHERE pos >= CAST(floor(n * 0.8) AS BIGINT)""",
)
def tree_attribution_sums(spark, sf_dir):
    """What the parts and the base value leave of each prediction, which is nothing."""
    _, train, test = _split(spark, sf_dir)
    model = M.make_model("xgboost", **SMALL_TREES).fit(train, FEATURES, "value")
    parts = M.shapley_attributions(model, test, train, "pos")
    sums = parts.groupBy("pos").agg((F.sum("attribution") + F.max("base_value")).alias("told"), F.count_distinct("feature").alias("features"))
    told = sums.join(model.predict(test).select("pos", M.PREDICTED), "pos")
    return told.select("pos", r(F.col("told") - F.col(M.PREDICTED)).alias("gap"), "features")


def _stump_sql(models: str, slope: str, start: str, leaf: str) -> str:
    """Best single split by hour or weekday for every row (model, q, pull, least) of ``models``."""
    return ONE_SQL + f""", c AS (SELECT a.pos - 24 AS pos, a.value AS y, CAST(hour(a.ts) AS DOUBLE) AS hour, CAST(isodow(a.ts) - 1 AS DOUBLE) AS weekday
      FROM hourly a JOIN hourly b ON a.pos = b.pos + 24),
    md(model, q, pull, least) AS (VALUES {models}),
    s AS (SELECT model, q, pull, least, {start} AS start FROM md, c, n WHERE pos < CAST(floor(n * 0.8) AS BIGINT) GROUP BY model, q, pull, least),
    g AS (SELECT s.*, pos, y, hour, weekday, {slope} AS g FROM s, c, n WHERE pos < CAST(floor(n * 0.8) AS BIGINT)),
    l AS (SELECT model, pull, least, f, CASE WHEN f = 'hour' THEN hour ELSE weekday END AS x, g FROM g, (VALUES ('hour'), ('weekday')) t(f)),
    b AS (SELECT model, pull, least, f, x, sum(g) AS g, count(*) AS n FROM l GROUP BY ALL),
    cum AS (SELECT *, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER p AS ga, sum(n) OVER p AS na FROM b
      WINDOW w AS (PARTITION BY model, f ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY model, f)),
    best AS (SELECT model, arg_max(struct_pack(f := f, x := x), gl * gl / (nl + pull) + (ga - gl) * (ga - gl) / (na - nl + pull) - ga * ga / (na + pull)) AS k
      FROM cum WHERE nl >= least AND na - nl >= least GROUP BY model),
    side AS (SELECT g.*, k.f AS f, CASE WHEN k.f = 'hour' THEN hour ELSE weekday END <= k.x AS low FROM g JOIN best USING (model)),
    leaf AS (SELECT model, low, 0.5 * {leaf} AS step FROM side GROUP BY model, low, pull, q),
    base AS (SELECT model, avg(start + step) AS base FROM side JOIN leaf USING (model, low) GROUP BY model),
    told AS (SELECT s.model, pos, k.f AS f, start + step AS predicted, base FROM s JOIN best USING (model) JOIN base USING (model), c, n, leaf
      WHERE pos >= CAST(floor(n.n * 0.8) AS BIGINT) AND leaf.model = s.model AND leaf.low = (CASE WHEN k.f = 'hour' THEN hour ELSE weekday END <= k.x))"""


def _clock_features(spark, sf_dir):
    frame = cut_lineage(hourly_features(spark, sf_dir).select("pos", "ts", "value", F.hour("ts").cast("double").alias("hour"), F.weekday("ts").cast("double").alias("weekday")))
    return V.split_at(frame, frame.count(), 0.2)


@query(
    "boosted_stumps",
    _stump_sql("('xgboost', 0.0, 1.0, 1), ('lightgbm', 0.0, 0.0, 20), ('catboost', 0.0, 3.0, 1)", "start - y", "avg(y)", "-sum(g) / (count(*) + pull)")
    + """ SELECT model, pos, round(predicted, 4) + 0.0 AS predicted, round(CASE WHEN f = 'hour' THEN predicted - base ELSE 0 END, 4) + 0.0 AS attribution_hour,
      round(CASE WHEN f = 'weekday' THEN predicted - base ELSE 0 END, 4) + 0.0 AS attribution_weekday, round(base, 4) + 0.0 AS base_value FROM told""",
)
def boosted_stumps(spark, sf_dir):
    """One tree of one split by each family, with its exact attributions."""
    train, test = _clock_features(spark, sf_dir)
    out = []
    for name in ("xgboost", "lightgbm", "catboost"):
        model = M.make_model(name, n_estimators=1, max_depth=1, learning_rate=0.5).fit(train, ["hour", "weekday"], "value")
        parts = M.shapley_attributions(model, test, train, "pos").groupBy("pos", "base_value").pivot("feature", ["hour", "weekday"]).agg(F.sum("attribution"))
        told = parts.withColumnsRenamed({"hour": "attribution_hour", "weekday": "attribution_weekday"})
        out.append(model.predict(test).select("pos", M.PREDICTED).join(told, "pos").withColumn("model", F.lit(name)))
    all_ = out[0].unionByName(out[1]).unionByName(out[2])
    return all_.withColumns({c: r(F.col(c), 4) for c in (M.PREDICTED, "attribution_hour", "attribution_weekday", "base_value")})


@query(
    "quantile_stumps",
    _stump_sql("('predicted', 0.5, 0.0, 20), ('predicted_lower', 0.1, 0.0, 20), ('predicted_upper', 0.9, 0.0, 20)", "CASE WHEN y > start THEN -q ELSE 1 - q END", "quantile_cont(y, q)", "quantile_cont(y - start, q)")
    .replace("quantile_cont(y, q)", "CASE q WHEN 0.5 THEN quantile_cont(y, 0.5) WHEN 0.1 THEN quantile_cont(y, 0.1) ELSE quantile_cont(y, 0.9) END")
    .replace("quantile_cont(y - start, q)", "(CASE q WHEN 0.5 THEN quantile_cont(y - start, 0.5) WHEN 0.1 THEN quantile_cont(y - start, 0.1) ELSE quantile_cont(y - start, 0.9) END)")
    + """ SELECT pos, round(max(predicted) FILTER (model = 'predicted'), 4) + 0.0 AS predicted, round(max(predicted) FILTER (model = 'predicted_lower'), 4) + 0.0 AS predicted_lower,
      round(max(predicted) FILTER (model = 'predicted_upper'), 4) + 0.0 AS predicted_upper FROM told GROUP BY pos""",
)
def quantile_stumps(spark, sf_dir):
    """The three quantile models of an interval, one split each."""
    train, test = _clock_features(spark, sf_dir)
    model = M.make_model("lightgbm", n_estimators=1, max_depth=1, learning_rate=0.5, alpha=0.2).fit(train, ["hour", "weekday"], "value")
    return model.predict(test).select("pos", *[r(F.col(c), 4).alias(c) for c in (M.PREDICTED, M.LOWER, M.UPPER)])


@query("training_session")
def training_session(spark, sf_dir):
    frame = hourly_features(spark, sf_dir)
    runs = [
        V.training_session(frame, "ts", FEATURES, "value", name, params, run_name=name)["run"]
        for name, params in (("ridge", {}), ("xgboost", SMALL_TREES))
    ]
    return V.compare_runs(runs[0].unionByName(runs[1]).drop("trained_at_utc"))


KEYS = ["series_id"]


@query("holt_winters")
def holt_winters(spark, sf_dir):
    fitted = U.fit_holt_winters(hourly_by_kind(spark, sf_dir), KEYS, "add", "add", 24)
    return U.forecast_holt_winters(fitted, KEYS, 48, "add", "add", 24)


@query("arima")
def arima(spark, sf_dir):
    fitted = U.fit_arima(hourly_by_kind(spark, sf_dir), KEYS, (1, 1, 1))
    return U.forecast_arima(fitted, KEYS, (1, 1, 1), 48)


@query(
    "arima_differenced_ar",
    f"""WITH {HOURLY_KIND_SQL}, w AS (SELECT series_id, pos, value, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS w FROM hk),
    v AS (SELECT *, lag(w) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM w),
    phi AS (SELECT series_id, sum(w * b) / sum(b * b) AS phi, max(pos) AS last FROM v WHERE pos >= 2 GROUP BY 1),
    var AS (SELECT v.series_id, phi, sum((w - phi * b) * (w - phi * b)) / count(*) AS s2, arg_max(value, pos) AS y, arg_max(w, pos) AS w
            FROM v JOIN phi USING (series_id) WHERE pos >= 2 GROUP BY v.series_id, phi),
    h AS (SELECT CAST(h AS INTEGER) AS h FROM generate_series(1, 24) g(h)),
    f AS (SELECT series_id, h, y + w * list_sum([pow(phi, i) for i in range(1, h + 1)]) AS p,
                 1.959963984540054 * sqrt(s2 * list_sum([pow(list_sum([pow(phi, i) for i in range(0, j + 1)]), 2) for j in range(0, h)])) AS half FROM var, h)
    SELECT series_id, h, round(p, 3) + 0.0 AS predicted, round(p - half, 3) + 0.0 AS predicted_lower, round(p + half, 3) + 0.0 AS predicted_upper FROM f""",
)
def arima_differenced_ar(spark, sf_dir):
    fitted = U.fit_arima(hourly_by_kind(spark, sf_dir), KEYS, (1, 1, 0))
    out = U.forecast_arima(fitted, KEYS, (1, 1, 0), 24)
    return out.withColumns({c: r(F.col(c), 3) for c in ("predicted", "predicted_lower", "predicted_upper")})


HW_GIVEN = (0.3, 0.05, 0.2)


@query(
    "holt_winters_given",
    f"""WITH RECURSIVE {HOURLY_KIND_SQL},
    o AS (SELECT series_id, avg(value) FILTER (pos < 24) AS level, (avg(value) FILTER (pos >= 24) - avg(value) FILTER (pos < 24)) / 24 AS slope,
            list(value ORDER BY pos) FILTER (pos < 24) AS first FROM hk WHERE pos < 48 GROUP BY series_id),
    v AS (SELECT series_id, list(value ORDER BY pos) AS y FROM hk GROUP BY series_id),
    run AS (
      SELECT series_id, 0 AS i, level, slope, list_transform(first, lambda x: x - level) AS season, CAST(0 AS DOUBLE) AS sse, y FROM o JOIN v USING (series_id)
      UNION ALL
      SELECT series_id, i + 1, 0.3 * (y[i + 1] - season[1]) + 0.7 * (level + slope),
        0.05 * (0.3 * (y[i + 1] - season[1]) + 0.7 * (level + slope) - level) + 0.95 * slope,
        list_append(season[2:], 0.2 * (y[i + 1] - level - slope) + 0.8 * season[1]), sse + (y[i + 1] - level - slope - season[1]) * (y[i + 1] - level - slope - season[1]), y
      FROM run WHERE i < len(y)),
    e AS (SELECT * FROM run WHERE i = len(y)), h AS (SELECT CAST(h AS INTEGER) AS h FROM generate_series(1, 48) g(h)),
    f AS (SELECT series_id, h, level + h * slope + season[(h - 1) % 24 + 1] AS p, sse, i,
            1 + coalesce(list_sum([pow(0.3 * (1 + j * 0.05) + CASE WHEN j % 24 = 0 THEN 0.2 ELSE 0 END, 2) for j in range(1, h)]), 0) AS growth FROM e, h)
    SELECT series_id, h, round(sse / i, 3) + 0.0 AS mse, round(p, 3) + 0.0 AS predicted,
      round(p - 1.959963984540054 * sqrt(sse / (i - 3) * growth), 3) + 0.0 AS predicted_lower, round(p + 1.959963984540054 * sqrt(sse / (i - 3) * growth), 3) + 0.0 AS predicted_upper FROM f""",
)
def holt_winters_given(spark, sf_dir):
    """Forecasts with given smoothing parameters, in chunks of ten days."""
    fitted = U.fit_holt_winters(hourly_by_kind(spark, sf_dir), KEYS, "add", "add", 24, chunk=240, parameters=HW_GIVEN)
    out = U.forecast_holt_winters(fitted, KEYS, 48, "add", "add", 24).join(fitted.select(*KEYS, (F.col("sse") / F.col("rows")).alias("mse")), KEYS)
    return out.withColumns({c: r(F.col(c), 3) for c in ("mse", "predicted", "predicted_lower", "predicted_upper")})


@query(
    "arima_given",
    f"""WITH RECURSIVE {HOURLY_KIND_SQL},
    v AS (SELECT series_id, list(value ORDER BY pos) AS y FROM hk GROUP BY series_id),
    m(model, phi, theta, first) AS (VALUES ('011', 0.0::DOUBLE, -0.6::DOUBLE, 1), ('111', 0.25::DOUBLE, -0.7::DOUBLE, 2)),
    run AS (
      SELECT series_id, model, phi, theta, first AS i, first, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS sse, y FROM v, m
      UNION ALL
      SELECT series_id, model, phi, theta, i + 1, first, y[i + 1] - y[i] - phi * coalesce(y[i] - y[i - 1], 0) - theta * e,
        sse + pow(y[i + 1] - y[i] - phi * coalesce(y[i] - y[i - 1], 0) - theta * e, 2), y
      FROM run WHERE i < len(y)),
    last AS (SELECT *, sse / (i - first) AS s2, y[i] AS y0, y[i] - y[i - 1] AS w0 FROM run WHERE i = len(y)), h AS (SELECT CAST(h AS INTEGER) AS h FROM generate_series(1, 24) g(h)),
    f AS (SELECT series_id, model, h, s2, y0 + list_sum([pow(phi, j) * (phi * w0 + theta * e) for j in range(0, h)]) AS p,
            list_sum([pow(CASE WHEN j = 0 THEN 1 ELSE 1 + (phi + theta) * list_sum([pow(phi, i) for i in range(0, j)]) END, 2) for j in range(0, h)]) AS growth FROM last, h)
    SELECT series_id, model, h, round(s2, 3) + 0.0 AS variance, round(p, 3) + 0.0 AS predicted, round(p - 1.959963984540054 * sqrt(s2 * growth), 3) + 0.0 AS predicted_lower,
      round(p + 1.959963984540054 * sqrt(s2 * growth), 3) + 0.0 AS predicted_upper FROM f""",
)
def arima_given(spark, sf_dir):
    """Forecasts with given coefficients of a moving average, alone and beside an autoregressive part, in chunks of ten days."""
    out = []
    for name, order, given in (("011", (0, 1, 1), (-0.6,)), ("111", (1, 1, 1), (0.25, -0.7))):
        fitted = U.fit_arima(hourly_by_kind(spark, sf_dir), KEYS, order, chunk=240, coefficients=given)
        steps = U.forecast_arima(fitted, KEYS, order, 24).join(fitted.select(*KEYS, "variance"), KEYS)
        out.append(steps.withColumn("model", F.lit(name)))
    both = out[0].unionByName(out[1])
    return both.withColumns({c: r(F.col(c), 3) for c in ("variance", "predicted", "predicted_lower", "predicted_upper")})


@query(
    "arima_moving_average",
    f"""WITH RECURSIVE {HOURLY_KIND_SQL},
    v AS (SELECT series_id, list(value ORDER BY pos) AS y FROM hk GROUP BY series_id),
    """ + ", ".join(
        f"""g{n} AS (SELECT series_id, y, list_transform(range(0, 41), lambda j: {'-0.9999 + 0.049995 * j' if n == 0 else f'least(greatest(best - {width} + {width} / 20 * j, -0.9999), 0.9999)'}) AS th FROM {'v' if n == 0 else f'v JOIN b{n - 1} USING (series_id)'}),
    run{n} AS (
      SELECT series_id, y, th, 1 AS i, list_transform(th, lambda x: CAST(0 AS DOUBLE)) AS e, list_transform(th, lambda x: CAST(0 AS DOUBLE)) AS sse FROM g{n}
      UNION ALL
      SELECT series_id, y, th, i + 1, now, list_transform(range(1, 42), lambda j: sse[j] + now[j] * now[j])
      FROM (SELECT *, list_transform(range(1, 42), lambda j: y[i + 1] - y[i] - th[j] * e[j]) AS now FROM run{n} WHERE i < len(y))),
    b{n} AS (SELECT series_id, th[list_position(sse, list_min(sse))] AS best, list_min(sse) AS sse, len(y) - 1 AS used FROM run{n} WHERE i = len(y))"""
        for n, width in enumerate((1.0, 0.05, 0.0025, 0.000125, 0.00001))
    ) + """
    SELECT series_id, round(best, 4) + 0.0 AS theta, round(sse / used, 4) + 0.0 AS variance, true AS flat FROM b4""",
)
def arima_moving_average(spark, sf_dir):
    """The least squares coefficient of a first-order moving average on the first differences."""
    fitted = U.fit_arima(hourly_by_kind(spark, sf_dir), KEYS, (0, 1, 1))
    return fitted.select(*KEYS, r(F.get("coefficients", F.lit(0)), 4).alias("theta"), r(F.col("variance"), 4).alias("variance"), (F.col("gradient") < 1e-4).alias("flat"))


@query("arima_grid")
def arima_grid(spark, sf_dir):
    settings = [{"order": o} for o in ((1, 0, 0), (0, 1, 1), (1, 1, 1))]
    return U.grid_forecasts(hourly_by_kind(spark, sf_dir), KEYS, settings, "arima", 0.1)
