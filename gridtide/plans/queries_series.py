"""Queries: patterns, decomposition, stationarity, autocorrelation, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import decomposition as D, patterns as P, spectrum as S, stationarity as Z
from gridtide.operators.statistics import covariance_matrix
from gridtide.plans.fixtures import HOURLY_KIND_SQL, HOURLY_SQL, KINDS, hourly_by_kind, hourly_total
from gridtide.plans.registry import query, steady_round as r
from gridtide.plans.stl_sql import mstl_parts, robust_parts, stl_parts

KEYS = ["series_id"]


@query("hourly_series", f"WITH {HOURLY_KIND_SQL} SELECT series_id, ts, pos, round(value, 4) + 0.0 AS value FROM hk")
def hourly_series(spark, sf_dir):
    return hourly_by_kind(spark, sf_dir).drop("n").withColumn("value", r(F.col("value"), 4))


PATTERN_SQL = f"WITH {HOURLY_KIND_SQL}, pat AS (SELECT series_id, pos % 24 AS phase, avg(value) AS pattern FROM hk GROUP BY ALL) "


def _pattern(spark, sf_dir):
    return P.seasonal_pattern(hourly_by_kind(spark, sf_dir), KEYS, "pos", "value", 24)


@query("avg_pattern", PATTERN_SQL + "SELECT series_id, phase, round(pattern, 6) + 0.0 AS pattern FROM pat")
def avg_pattern(spark, sf_dir):
    return _pattern(spark, sf_dir).withColumn("pattern", r(F.col("pattern")))


@query(
    "pattern_ma",
    PATTERN_SQL + """SELECT series_id, phase, round(avg(pattern) OVER (PARTITION BY series_id ORDER BY phase
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS pattern FROM pat""",
)
def pattern_ma(spark, sf_dir):
    return P.smooth_moving_average(_pattern(spark, sf_dir), KEYS, 24, 4).withColumn("pattern", r(F.col("pattern")))


@query(
    "pattern_savgol",
    # The parabola through seven points from the sums of u, u^2 and u^4 for u = -3..3: 7 points, 28 and 196.
    PATTERN_SQL + """, s AS (SELECT series_id, phase, greatest(0, least(phase - 3, 17)) + 3 AS middle FROM pat),
    m AS (SELECT s.series_id, s.phase, s.phase - middle AS u, sum(p.pattern) AS y0, sum((p.phase - middle) * p.pattern) AS y1,
          sum((p.phase - middle) * (p.phase - middle) * p.pattern) AS y2
          FROM s JOIN pat p ON p.series_id = s.series_id AND p.phase BETWEEN middle - 3 AND middle + 3 GROUP BY ALL)
    SELECT series_id, phase, round((y0 - 28 * (7 * y2 - 28 * y0) / 588) / 7 + u * y1 / 28 + u * u * (7 * y2 - 28 * y0) / 588, 6) + 0.0 AS pattern FROM m""",
)
def pattern_savgol(spark, sf_dir):
    return P.smooth_savgol(_pattern(spark, sf_dir), KEYS, 24, 7, 2).withColumn("pattern", r(F.col("pattern")))


@query(
    "periodogram",
    f"""WITH {HOURLY_SQL}, m AS (SELECT count(*) AS n, avg(value) AS mean FROM hourly),
    ks AS (SELECT unnest(generate_series(1, (SELECT n // 2 FROM m))) AS k),
    dft AS (SELECT k, n, sum((value - mean) * cos(2 * pi() * ((k * pos) % n) / n)) AS re, sum((value - mean) * sin(2 * pi() * ((k * pos) % n) / n)) AS im
            FROM hourly, m, ks GROUP BY ALL)
    SELECT 'total' AS series_id, k, round(CAST(k AS DOUBLE) / n, 9) AS frequency,
      round((re * re + im * im) / n * CASE WHEN k * 2 = n THEN 1 ELSE 2 END / 1000, 6) + 0.0 AS power_k, round(CAST(n AS DOUBLE) / k, 6) AS period FROM dft""",
)
def periodogram(spark, sf_dir):
    out = S.periodogram(hourly_total(spark, sf_dir), KEYS)
    return out.select(
        "series_id", "k", r(F.col("frequency"), 9).alias("frequency"), r(F.col("power") / 1000).alias("power_k"),
        r(F.col("period"), 6).alias("period"),
    )


@query(
    "top_periods",
    f"""WITH {HOURLY_KIND_SQL}, m AS (SELECT series_id, count(*) AS n, avg(value) AS mean FROM hk GROUP BY 1),
    ks AS (SELECT series_id, n, mean, unnest(generate_series(1, n // 2)) AS k FROM m),
    dft AS (SELECT ks.series_id, k, n, sum((value - mean) * cos(2 * pi() * ((k * pos) % n) / n)) AS re, sum((value - mean) * sin(2 * pi() * ((k * pos) % n) / n)) AS im
            FROM hk JOIN ks USING (series_id) GROUP BY ALL),
    p AS (SELECT series_id, k, (re * re + im * im) / n * CASE WHEN k * 2 = n THEN 1 ELSE 2 END AS power, CAST(n AS DOUBLE) / k AS h FROM dft),
    t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, k) AS rank FROM p)
    SELECT series_id, k, CAST(rank AS INTEGER) AS rank, round(power / 1000, 6) + 0.0 AS power_k, CASE WHEN h < 24 THEN printf('%.2f hours', h) WHEN h < 168 THEN printf('%.2f days', h / 24)
      WHEN h < 720 THEN printf('%.2f weeks', h / 168) WHEN h < 8760 THEN printf('%.2f months', h / 720) ELSE printf('%.2f years', h / 8760) END AS label
    FROM t WHERE rank <= 5""",
)
def top_periods(spark, sf_dir):
    out = S.top_periods(S.periodogram(hourly_by_kind(spark, sf_dir), KEYS), KEYS)
    return out.select("series_id", "k", "rank", r(F.col("power") / 1000).alias("power_k"), "label")


DFT_SQL = f"""WITH {HOURLY_KIND_SQL}, m AS (SELECT series_id, count(*) AS n, avg(value) AS mean FROM hk GROUP BY 1),
ks AS (SELECT series_id, n, mean, unnest(generate_series(1, n // 2)) AS k FROM m),
dft AS (SELECT ks.series_id, k, n, sum((value - mean) * cos(2 * pi() * ((k * pos) % n) / n)) AS re, sum((value - mean) * sin(2 * pi() * ((k * pos) % n) / n)) AS im
        FROM hk JOIN ks USING (series_id) GROUP BY ALL),
p AS (SELECT series_id, k, (re * re + im * im) / n * CASE WHEN k * 2 = n THEN 1 ELSE 2 END AS power, CAST(n AS DOUBLE) / k AS period FROM dft),
c(label, hours) AS (VALUES {', '.join(f"('{label}', {hours}.0)" for label, hours in S.COMMON_PERIODS)})
"""


@query(
    "spectrum_view",
    DFT_SQL + """SELECT series_id, k, round(period, 6) AS period, round(power / 1000, 6) + 0.0 AS power_k,
      arg_min(label, abs(period - hours)) AS common_period, CAST(arg_min(hours, abs(period - hours)) AS DOUBLE) AS common_length
    FROM p, c WHERE period <= 200 GROUP BY series_id, k, period, power""",
)
def spectrum_view(spark, sf_dir):
    shown = S.spectrum_view(S.periodogram(hourly_by_kind(spark, sf_dir), KEYS), "hour", 200)
    return shown.select(
        "series_id", "k", r(F.col("period"), 6).alias("period"), r(F.col("power") / 1000).alias("power_k"),
        "common_period", "common_length",
    )


@query(
    "common_periods",
    DFT_SQL + """SELECT series_id, label, CAST(hours AS DOUBLE) AS length, round(arg_min(period, (abs(period - hours), period)), 6) AS period,
      round(arg_min(power, (abs(period - hours), period)) / 1000, 6) + 0.0 AS power_k
    FROM p, c GROUP BY series_id, label, hours HAVING hours BETWEEN min(period) AND max(period)""",
)
def common_periods(spark, sf_dir):
    found = S.common_periods(S.periodogram(hourly_by_kind(spark, sf_dir), KEYS), KEYS)
    return found.select(
        "series_id", "label", "length", r(F.col("period"), 6).alias("period"), r(F.col("power") / 1000).alias("power_k"),
    )


@query(
    "acf",
    f"""WITH {HOURLY_KIND_SQL}, m AS (SELECT series_id, avg(value) AS mean FROM hk GROUP BY 1),
    e AS (SELECT hk.series_id, pos, value - mean AS e FROM hk JOIN m USING (series_id)),
    lags AS (SELECT unnest(generate_series(0, 200)) AS lag),
    prod AS (SELECT a.series_id, lag, sum(a.e * b.e) AS s FROM lags, e a JOIN e b ON a.series_id = b.series_id AND a.pos = b.pos + lag GROUP BY ALL)
    SELECT p.series_id, CAST(p.lag AS INTEGER) AS lag, round(p.s / z.s, 6) + 0.0 AS acf FROM prod p JOIN prod z ON p.series_id = z.series_id AND z.lag = 0""",
)
def acf(spark, sf_dir):
    return S.acf(hourly_by_kind(spark, sf_dir), KEYS, 200).withColumn("acf", r(F.col("acf")))


@query(
    "pacf",
    f"""WITH RECURSIVE {HOURLY_KIND_SQL}, m AS (SELECT series_id, avg(value) AS mean FROM hk GROUP BY 1),
    e AS (SELECT hk.series_id, pos, value - mean AS e FROM hk JOIN m USING (series_id)),
    lags AS (SELECT unnest(generate_series(0, 200)) AS lag),
    prod AS (SELECT a.series_id, lag, sum(a.e * b.e) AS s FROM lags, e a JOIN e b ON a.series_id = b.series_id AND a.pos = b.pos + lag GROUP BY ALL),
    rho AS (SELECT series_id, list(s ORDER BY lag) AS s FROM prod GROUP BY 1),
    dl AS (
      SELECT series_id, 0 AS k, [x / s[1] for x in s[2:]] AS r, CAST([] AS DOUBLE[]) AS c, CAST(1.0 AS DOUBLE) AS v FROM rho
      UNION ALL
      SELECT series_id, k + 1, r, [c[i] - g * c[k + 1 - i] for i in range(1, k + 1)] || [g], g FROM (
        SELECT series_id, k, r, c, (r[k + 1] - coalesce(list_sum([c[i] * r[k + 1 - i] for i in range(1, k + 1)]), 0))
          / (1 - coalesce(list_sum([c[i] * r[i] for i in range(1, k + 1)]), 0)) AS g FROM dl WHERE k < 200))
    SELECT series_id, CAST(k AS INTEGER) AS lag, round(v, 6) + 0.0 AS pacf FROM dl""",
)
def pacf(spark, sf_dir):
    return S.pacf(hourly_by_kind(spark, sf_dir), KEYS, 200).withColumn("pacf", r(F.col("pacf")))


@query(
    "adf_given_lag",
    f"""WITH {HOURLY_KIND_SQL}, d AS (SELECT series_id, pos, value,
        lag(value) OVER w AS a, value - lag(value) OVER w AS y, lag(value) OVER w - lag(value, 2) OVER w AS b
        FROM hk WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
    g AS (SELECT series_id, count(*) AS m, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, var_pop(y) * count(*) AS yy,
        covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS yb
        FROM d WHERE b IS NOT NULL GROUP BY 1),
    s AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS slope, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS short FROM g)
    SELECT series_id, CAST(1 AS INTEGER) AS used_lags, m AS n_observations,
      round(slope / sqrt((yy - slope * ay - short * yb) / (m - 3) * bb / (aa * bb - ab * ab)), 6) + 0.0 AS test_statistic,
      round(-2.86154 - 2.8903 / m - 4.234 / (m * m) - 40.040 / (CAST(m AS DOUBLE) * m * m), 6) AS critical_5 FROM s""",
)
def adf_given_lag(spark, sf_dir):
    out = Z.adf_test(hourly_by_kind(spark, sf_dir), KEYS, lags=1)
    return out.select(
        "series_id", "used_lags", "n_observations", r(F.col("test_statistic")).alias("test_statistic"),
        r(F.col("critical_values")["5%"]).alias("critical_5"),
    )


@query("adf_test")
def adf_test(spark, sf_dir):
    return Z.adf_test(hourly_by_kind(spark, sf_dir), KEYS)


@query(
    "kpss_test",
    f"""WITH {HOURLY_KIND_SQL}, m AS (SELECT series_id, count(*) AS n, avg(value) AS mean FROM hk GROUP BY 1),
    e AS (SELECT hk.series_id, pos, n, value - mean AS e FROM hk JOIN m USING (series_id)),
    lags AS (SELECT unnest(generate_series(0, 400)) AS lag),
    prod AS (SELECT a.series_id, a.n, lag, sum(a.e * b.e) AS s FROM lags, e a JOIN e b ON a.series_id = b.series_id AND a.pos = b.pos + lag GROUP BY a.series_id, a.n, lag),
    s AS (SELECT series_id, n, sum(CASE WHEN lag = 0 THEN s ELSE 2 * s END) FILTER (WHERE lag <= floor(pow(n, 2.0 / 9.0))) AS s0,
                 sum(2 * lag * s) FILTER (WHERE lag <= floor(pow(n, 2.0 / 9.0))) AS s1 FROM prod GROUP BY ALL),
    l AS (SELECT series_id, n, CAST(floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1.0 / 3.0) * pow(n, 1.0 / 3.0)) AS INTEGER) AS lags FROM s),
    v AS (SELECT l.series_id, l.n AS n, lags, sum(CASE WHEN lag = 0 THEN prod.s ELSE 2 * prod.s * (1 - CAST(lag AS DOUBLE) / (lags + 1)) END) FILTER (WHERE lag <= lags) / l.n AS lrv
          FROM l JOIN prod USING (series_id) GROUP BY l.series_id, l.n, lags),
    c AS (SELECT series_id, sum(e) OVER (PARTITION BY series_id ORDER BY pos) AS c FROM e),
    k AS (SELECT v.series_id, lags, sum(c * c) / (CAST(n AS DOUBLE) * n) / lrv AS stat FROM v JOIN c USING (series_id) GROUP BY v.series_id, lags, n, lrv)
    SELECT series_id, lags, round(stat, 6) + 0.0 AS test_statistic,
      round(CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 + (stat - 0.347) / (0.463 - 0.347) * -0.05
           WHEN stat <= 0.574 THEN 0.05 + (stat - 0.463) / (0.574 - 0.463) * -0.025 WHEN stat <= 0.739 THEN 0.025 + (stat - 0.574) / (0.739 - 0.574) * -0.015 ELSE 0.01 END, 6) AS p_value FROM k""",
)
def kpss_test(spark, sf_dir):
    out = Z.kpss_test(hourly_by_kind(spark, sf_dir), KEYS)
    return out.select("series_id", "lags", r(F.col("test_statistic")).alias("test_statistic"), r(F.col("p_value"), 6).alias("p_value"))


def _stl(spark, sf_dir):
    return D.stl(hourly_by_kind(spark, sf_dir), KEYS, 24)


def _rounded(parts, digits=4):
    return parts.select("series_id", "pos", *[r(F.col(c), digits).alias(c) for c in parts.columns if c not in ("series_id", "pos")])


# Trend windows: the next odd number from 1.5 period / (1 - 1.5 / seasonal window).
HOURLY_Y_SQL = f"{HOURLY_KIND_SQL}, ser AS MATERIALIZED (SELECT series_id AS s, pos, value AS y, count(*) OVER (PARTITION BY series_id) AS n FROM hk)"
STL_SQL = f"WITH {HOURLY_Y_SQL}, {', '.join(stl_parts('stl', 'ser', 24, 7, 47))} "
MSTL_SQL = f"WITH {HOURLY_Y_SQL}, {', '.join(mstl_parts('mstl', 'ser', [(24, 11, 43), (168, 15, 281)]))} "


@query(
    "stl_components",
    STL_SQL + """SELECT s AS series_id, pos, round(y, 4) + 0.0 AS observed, round(trend, 4) + 0.0 AS trend,
      round(season, 4) + 0.0 AS seasonal, round(y - trend - season, 4) + 0.0 AS resid FROM stl WHERE n >= 48""",
)
def stl_components(spark, sf_dir):
    return _rounded(_stl(spark, sf_dir))


@query(
    "stl_robust_components",
    f"WITH {HOURLY_Y_SQL}, {', '.join(robust_parts('stl', 'ser', 24, 7, 47, 2, 15))} " + """SELECT s AS series_id, pos,
      round(y, 4) + 0.0 AS observed, round(trend, 4) + 0.0 AS trend, round(season, 4) + 0.0 AS seasonal,
      round(y - trend - season, 4) + 0.0 AS resid FROM stl WHERE n >= 48""",
)
def stl_robust_components(spark, sf_dir):
    return _rounded(D.stl(hourly_by_kind(spark, sf_dir), KEYS, 24, robust=True))


def _invariant(parts, season):
    total = F.col("trend") + season + F.col("resid")
    return parts.select("series_id", "pos", r(F.col("observed"), 4).alias("observed"), r(total, 4).alias("recomposed"))


INVARIANT_SQL = f"WITH {HOURLY_KIND_SQL} SELECT series_id, pos, round(value, 4) + 0.0 AS observed, round(value, 4) + 0.0 AS recomposed FROM hk"


@query("stl_invariant", INVARIANT_SQL)
def stl_invariant(spark, sf_dir):
    return _invariant(_stl(spark, sf_dir), F.col("seasonal"))


def _mstl(spark, sf_dir):
    return D.mstl(hourly_by_kind(spark, sf_dir), KEYS, [24, 168])


@query(
    "mstl_components",
    MSTL_SQL + """SELECT a.s AS series_id, a.pos, round(y, 4) + 0.0 AS observed, round(trend, 4) + 0.0 AS trend,
      round(season_24, 4) + 0.0 AS seasonal_24, round(season_168, 4) + 0.0 AS seasonal_168, round(rest - trend, 4) + 0.0 AS resid
    FROM mstl a JOIN ser b ON a.s = b.s AND a.pos = b.pos WHERE a.n >= 336""",
)
def mstl_components(spark, sf_dir):
    return _rounded(_mstl(spark, sf_dir))


@query("mstl_invariant", INVARIANT_SQL)
def mstl_invariant(spark, sf_dir):
    return _invariant(_mstl(spark, sf_dir), F.col("seasonal_24") + F.col("seasonal_168"))


def _wide(spark, sf_dir):
    """Hourly sums per type side by side; positions count from the first hour of all."""
    from gridtide.functions.timeparts import truncate
    from gridtide.operators.series import regular_series
    from gridtide.plans.fixtures import table

    events = table(spark, sf_dir, "events")
    cells = [F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0) for k in KINDS]
    total = regular_series(events, [], "ts", "value", "hour").select("ts", "pos")
    sums = events.groupBy(truncate("ts", "hour").alias("ts")).agg(*[F.sum(c).alias(k) for c, k in zip(cells, KINDS)])
    return total.join(sums, "ts", "left").na.fill(0.0, KINDS)


WIDE_Y_SQL = f"""{HOURLY_SQL}, kinds AS (SELECT unnest([{', '.join(f"'{k}'" for k in KINDS)}]) AS s),
ser AS MATERIALIZED (
  SELECT s, pos, coalesce(v, 0.0) AS y, (SELECT count(*) FROM hourly) AS n FROM kinds CROSS JOIN hourly LEFT JOIN
    (SELECT event_type, date_trunc('hour', ts) AS h, sum(value) AS v FROM events GROUP BY ALL) e ON event_type = s AND h = hourly.ts)"""
WIDE_STL_SQL = f"WITH {WIDE_Y_SQL}, {', '.join(stl_parts('stl', 'ser', 24, 7, 47))} "
_PARTS = {"observed": "y", "trend": "trend", "seasonal": "season", "resid": "y - trend - season"}


@query(
    "stl_columns",
    WIDE_STL_SQL + "SELECT pos, " + ", ".join(
        f"round(max({c}) FILTER (WHERE s = '{k}'), 4) + 0.0 AS {name}_{k}" for k in KINDS for name, c in _PARTS.items()
    ) + " FROM stl WHERE n >= 48 GROUP BY pos",
)
def stl_columns(spark, sf_dir):
    parts = D.decompose_columns(_wide(spark, sf_dir), "pos", KINDS, [24])
    return parts.select("pos", *[r(F.col(c), 4).alias(c) for c in parts.columns if c != "pos"])


@query(
    "seasonal_patterns",
    f"WITH {WIDE_Y_SQL}, {', '.join(mstl_parts('mstl', 'ser', [(24, 11, 43), (168, 15, 281)]))}, phases AS (SELECT unnest(generate_series(0, 167)) AS phase) SELECT phase, "
    + ", ".join(
        f"(SELECT round(avg(season_{p}), 4) + 0.0 FROM mstl WHERE s = '{k}' AND pos % {p} = phase) AS pattern_{k}_period_{p}"
        for k in KINDS for p in (24, 168)
    ) + " FROM phases WHERE (SELECT max(n) FROM mstl) >= 336",
)
def seasonal_patterns(spark, sf_dir):
    parts = D.decompose_columns(_wide(spark, sf_dir), "pos", KINDS, [24, 168])
    found = P.all_patterns(parts, KINDS, [24, 168])
    return found.select("phase", *[r(F.col(c), 4).alias(c) for c in found.columns if c != "phase"])


@query(
    "residual_cov",
    WIDE_STL_SQL + """, e AS (SELECT s, pos, y - trend - season AS e FROM stl WHERE n >= 48)
    SELECT 'resid_' || a.s AS a, 'resid_' || b.s AS b, round(covar_samp(a.e, b.e), 4) + 0.0 AS value
    FROM e a JOIN e b ON a.pos = b.pos GROUP BY a.s, b.s""",
)
def residual_cov(spark, sf_dir):
    parts = D.decompose_columns(_wide(spark, sf_dir), "pos", KINDS, [24])
    return covariance_matrix(parts, [f"resid_{k}" for k in KINDS]).withColumn("value", r(F.col("value"), 4))


@query(
    "residual_level",
    STL_SQL + """, m AS (SELECT s, avg(y - trend - season) AS mean FROM stl WHERE n >= 48 GROUP BY 1),
    e AS MATERIALIZED (SELECT s, pos, n, y - trend - season - mean AS e FROM stl JOIN m USING (s)),
    prod AS MATERIALIZED (SELECT a.s, a.n, a.pos - b.pos AS lag, sum(a.e * b.e) AS p FROM e a JOIN e b ON a.s = b.s AND b.pos BETWEEN a.pos - 400 AND a.pos GROUP BY ALL),
    q AS (SELECT s, n, sum(CASE WHEN lag = 0 THEN p ELSE 2 * p END) AS s0, sum(2 * lag * p) AS s1 FROM prod WHERE lag <= floor(pow(n, 2.0 / 9.0)) GROUP BY ALL),
    l AS (SELECT s, CAST(floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1.0 / 3.0) * pow(n, 1.0 / 3.0)) AS INTEGER) AS lags FROM q),
    v AS (SELECT prod.s, lags, sum(CASE WHEN lag = 0 THEN p ELSE 2 * p * (1 - CAST(lag AS DOUBLE) / (lags + 1)) END) / n AS lrv
          FROM prod JOIN l ON l.s = prod.s AND lag <= lags GROUP BY prod.s, lags, n),
    c AS (SELECT s, n, sum(e) OVER (PARTITION BY s ORDER BY pos) AS c FROM e),
    k AS (SELECT v.s, lags, sum(c * c) / (CAST(n AS DOUBLE) * n) / lrv AS stat FROM v JOIN c ON c.s = v.s GROUP BY v.s, lags, n, lrv)
    SELECT s AS series_id, lags, round(stat, 6) + 0.0 AS test_statistic, stat < 0.463 AS is_stationary FROM k""",
)
def residual_level(spark, sf_dir):
    """The second of the residual tests by itself."""
    tests = Z.residual_tests(_stl(spark, sf_dir), KEYS).select("series_id", "kpss_test.*")
    return tests.select("series_id", "lags", r(F.col("test_statistic")).alias("test_statistic"), "is_stationary")


@query("residual_tests")
def residual_tests(spark, sf_dir):
    return Z.residual_tests(_stl(spark, sf_dir), KEYS)
