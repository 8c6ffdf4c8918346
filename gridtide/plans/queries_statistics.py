"""Queries: statistics and source comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import columns as C, timeparts as T
from gridtide.operators import joins, statistics as S
from gridtide.plans.fixtures import KINDS, table
from gridtide.plans.queries_tables import TYPE_PIVOT_SQL, _type_pivot
from gridtide.plans.registry import query, steady_round as r


@query(
    "source_validation",
    """WITH a AS (SELECT o_orderdate AS d, sum(o_totalprice) AS price, count(*)::DOUBLE AS lines FROM orders GROUP BY 1),
    b AS (SELECT o_orderdate AS d, sum(l_extendedprice) AS price, count(*)::DOUBLE AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    p AS (SELECT 'price' AS c, a.price AS x, b.price AS y FROM a JOIN b USING (d)
          UNION ALL SELECT 'lines', a.lines, b.lines FROM a JOIN b USING (d))
    SELECT c AS "column", round(avg((x - y) * (x - y)) / 1e6, 3) + 0.0 AS mse_m, round(sqrt(avg((x - y) * (x - y))), 3) + 0.0 AS rmse,
      round(avg(abs(x - y)), 3) + 0.0 AS mae, round(1 - avg((x - y) * (x - y)) / var_pop(x), 6) + 0.0 AS r2,
      round(corr(x, y), 6) + 0.0 AS correlation, round(avg(abs((x - y) / ((x + y) / 2))) * 100, 6) + 0.0 AS mean_abs_percent_diff,
      count(*) AS samples FROM p GROUP BY 1""",
)
def source_validation(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    first = orders.groupBy(F.col("o_orderdate").alias("d")).agg(
        F.sum("o_totalprice").alias("price"), F.count("*").cast("double").alias("lines"),
    )
    dated = lines.join(orders.select("o_orderkey", F.col("o_orderdate").alias("d")), lines.l_orderkey == orders.o_orderkey)
    second = dated.groupBy("d").agg(
        F.sum("l_extendedprice").alias("price"), F.count("*").cast("double").alias("lines"),
    )
    out = S.compare_sources(joins.align_sources(first, second, "d"))
    return out.select(
        "column", r(F.col("mse") / 1e6, 3).alias("mse_m"), r(F.col("rmse"), 3).alias("rmse"), r(F.col("mae"), 3).alias("mae"),
        *[r(F.col(c)).alias(c) for c in ("r2", "correlation", "mean_abs_percent_diff")], "samples",
    )


def _matrix_sql(fn, digits):
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round({fn}({a}, {b}), {digits}) + 0.0 AS value FROM wide" for a in KINDS for b in KINDS
    )
    return TYPE_PIVOT_SQL + cells


@query("corr_matrix", _matrix_sql("corr", 6))
def corr_matrix(spark, sf_dir):
    return S.correlation_matrix(_type_pivot(spark, sf_dir), KINDS).withColumn("value", r(F.col("value")))


@query("cov_matrix", _matrix_sql("covar_samp", 4))
def cov_matrix(spark, sf_dir):
    return S.covariance_matrix(_type_pivot(spark, sf_dir), KINDS).withColumn("value", r(F.col("value"), 4))


@query("hour_variance", "SELECT CAST(hour(ts) AS INTEGER) AS hour, round(var_samp(value), 4) + 0.0 AS variance FROM events GROUP BY 1")
def hour_variance(spark, sf_dir):
    hours = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "value")
    return S.variance_by(hours, ["hour"], "value").withColumn("variance", r(F.col("variance"), 4))


BOX_SQL = """b AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, value FROM events),
q AS (SELECT weekday, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM b GROUP BY 1),
f AS (SELECT b.weekday, value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS fits FROM b JOIN q USING (weekday))"""


def _weekdays(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.weekday("ts").alias("weekday"), "value")


@query(
    "box_stats",
    f"""WITH {BOX_SQL} SELECT weekday, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
    min(value) FILTER (WHERE fits) AS whisker_low, max(value) FILTER (WHERE fits) AS whisker_high,
    count(*) FILTER (WHERE NOT fits) AS outliers FROM f GROUP BY ALL""",
)
def box_stats(spark, sf_dir):
    out = S.box_statistics(_weekdays(spark, sf_dir), ["weekday"], "value")
    return out.withColumns({c: r(F.col(c)) for c in ("q1", "median", "q3")})


@query("box_outliers", f"WITH {BOX_SQL} SELECT weekday, value FROM f WHERE NOT fits")
def box_outliers(spark, sf_dir):
    return S.box_outliers(_weekdays(spark, sf_dir), ["weekday"], "value").select("weekday", "value")


@query(
    "histogram",
    """WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, lo, hi FROM events, l)
    SELECT bin, round(lo + bin * ((hi - lo) / 50), 6) + 0.0 AS bin_start, count(*) AS n FROM b GROUP BY bin, lo, hi""",
)
def histogram(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "events"), "value").withColumn("bin_start", r(F.col("bin_start")))


@query("median_value", "SELECT round(median(l_extendedprice), 4) + 0.0 AS median FROM lineitem")
def median_value(spark, sf_dir):
    return S.median_of(table(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("median", r(F.col("median"), 4))


@query(
    "kde",
    """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
    h AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) * 0.5 AS h FROM s),
    g AS (SELECT h.*, i AS point, lo - 3 * h + i * ((hi - lo + 6 * h) / 199) AS x FROM h, generate_series(0, 199) t(i))
    SELECT g.event_type, point, round(x, 6) + 0.0 AS x,
      round(sum(exp(-((x - value) / h) * ((x - value) / h) / 2)) / (n * h * sqrt(2 * pi())), 9) + 0.0 AS density
    FROM g JOIN events USING (event_type) GROUP BY g.event_type, point, x, n, h""",
)
def kde(spark, sf_dir):
    out = S.density_curves(table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumns({"x": r(F.col("x")), "density": r(F.col("density"), 9)})


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 5) + 0.0 AS std,
        min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS p50,
        round(quantile_cont({c}, 0.75), 6) + 0.0 AS p75 FROM lineitem"""
        for c in DESCRIBED
    ),
)
def describe(spark, sf_dir):
    out = S.describe_columns(table(spark, sf_dir, "lineitem"), DESCRIBED)
    return out.withColumns({"mean": r(F.col("mean")), "std": r(F.col("std"), 5), **{c: r(F.col(c)) for c in ("p25", "p50", "p75")}})


@query(
    "null_dup_counts",
    """WITH t AS (SELECT user_id, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(floor(value / 10) AS BIGINT) END AS v FROM events),
    g AS (SELECT user_id, event_type, v, count(*) AS c FROM t GROUP BY ALL)
    SELECT (SELECT count(*) FROM t WHERE v IS NULL) AS null_cells, CAST(sum(c - 1) AS BIGINT) AS duplicated_rows FROM g""",
)
def null_dup_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.when(F.col("event_id") % 50 != 0, F.floor(F.col("value") / 10)).alias("v"),
    )
    return S.null_and_duplicate_counts(rows)


@query(
    "category_top",
    """SELECT monthname(o_orderdate) AS month_name, count(o_totalprice) AS count, round(avg(o_totalprice), 4) + 0.0 AS mean,
      round(median(o_totalprice), 4) + 0.0 AS median FROM orders GROUP BY 1 ORDER BY avg(o_totalprice) LIMIT 5""",
)
def category_top(spark, sf_dir):
    named = T.calendar_keys(table(spark, sf_dir, "orders"), "o_orderdate").select("month_name", "o_totalprice")
    out = S.category_statistics(named, "month_name", "o_totalprice", "mean", True, 5)
    return out.withColumns({c: r(F.col(c), 4) for c in ("mean", "median")})


@query(
    "month_order",
    """SELECT monthname(o_orderdate) AS month_name, count(o_totalprice) AS count, round(avg(o_totalprice), 4) + 0.0 AS mean,
      round(median(o_totalprice), 4) + 0.0 AS median FROM orders GROUP BY 1""",
)
def month_order(spark, sf_dir):
    named = T.calendar_keys(table(spark, sf_dir, "orders"), "o_orderdate").select("month_name", "o_totalprice")
    out = S.category_statistics(named, "month_name", "o_totalprice", "month")
    return out.withColumns({c: r(F.col(c), 4) for c in ("mean", "median")})


@query("common_quantities", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_quantity LIMIT 5")
def common_quantities(spark, sf_dir):
    return S.frequencies(table(spark, sf_dir, "lineitem"), "l_quantity", 5)


@query(
    "regression_scores",
    """SELECT event_type, round(avg((value - 50) * (value - 50)), 4) + 0.0 AS mse, round(avg(abs(value - 50)), 6) + 0.0 AS mae,
      round(1 - avg((value - 50) * (value - 50)) / var_pop(value), 6) + 0.0 AS r2 FROM events GROUP BY 1""",
)
def regression_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.lit(50.0).alias("guess"))
    out = S.regression_scores(rows, "value", "guess", ["event_type"])
    return out.withColumns({"mse": r(F.col("mse"), 4), "mae": r(F.col("mae")), "r2": r(F.col("r2"))})


@query(
    "period_labels",
    """SELECT o_orderkey, CASE WHEN h < 24 THEN printf('%.2f hours', h) WHEN h < 168 THEN printf('%.2f days', h / 24)
      WHEN h < 720 THEN printf('%.2f weeks', h / 168) WHEN h < 8760 THEN printf('%.2f months', h / 720)
      ELSE printf('%.2f years', h / 8760) END AS label FROM (SELECT o_orderkey, o_totalprice / 16.0 AS h FROM orders)""",
)
def period_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.period_label(F.col("o_totalprice") / 16.0).alias("label"))
