"""Queries: gridded weather, regional means, forecast features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions.columns import lonlat_columns
from gridtide.operators import spatial
from gridtide.plans import forecast
from gridtide.plans.fixtures import GRID_SQL, MASK_SQL, grid, rings
from gridtide.plans.queries_tables import _cycle_sql
from gridtide.plans.registry import query, steady_round as r
from gridtide.sources import weather

MEANS_SQL = f"""WITH {GRID_SQL}, {MASK_SQL},
timed AS (SELECT variable, time + to_hours(step_hours) AS datetime, level, latitude, longitude, value FROM grid),
means AS (SELECT variable, datetime, region, avg(value) AS mean_value FROM timed JOIN mask USING (latitude, longitude) GROUP BY ALL)
"""


@query("region_mask", f"WITH {GRID_SQL}, {MASK_SQL} SELECT * FROM mask")
def region_mask(spark, sf_dir):
    return spatial.mask_cells(grid(spark, sf_dir), rings(spark))


@query("regional_mean", MEANS_SQL + "SELECT variable, datetime, region, round(mean_value, 6) + 0.0 AS mean_value FROM means")
def regional_mean(spark, sf_dir):
    out = spatial.regional_means(grid(spark, sf_dir).drop("level"), rings(spark))
    return out.withColumn("mean_value", r(F.col("mean_value")))


@query(
    "regional_table",
    MEANS_SQL + """SELECT variable, datetime, round(max(mean_value) FILTER (WHERE region = 'South'), 6) + 0.0 AS South,
      round(max(mean_value) FILTER (WHERE region = 'North'), 6) + 0.0 AS North FROM means GROUP BY 1, 2""",
)
def regional_table(spark, sf_dir):
    means = spatial.regional_means(grid(spark, sf_dir).drop("level"), rings(spark))
    return spatial.regions_wide(means, ["South", "North"]).withColumns({c: r(F.col(c)) for c in ("South", "North")})


@query(
    "level_mean",
    MEANS_SQL + """, levels AS (SELECT variable, datetime, region, level, avg(value) AS m FROM timed JOIN mask USING (latitude, longitude) GROUP BY ALL)
    SELECT variable, datetime, region, round(avg(m), 6) + 0.0 AS mean_value FROM levels GROUP BY ALL""",
)
def level_mean(spark, sf_dir):
    return spatial.regional_means(grid(spark, sf_dir), rings(spark)).withColumn("mean_value", r(F.col("mean_value")))


@query("valid_time", f"WITH {GRID_SQL} SELECT *, time + to_hours(step_hours) AS datetime FROM grid")
def valid_time(spark, sf_dir):
    return spatial.valid_time(grid(spark, sf_dir))


@query(
    "chosen_time",
    f"WITH {GRID_SQL} SELECT variable, time + INTERVAL 3 DAY AS datetime, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM grid GROUP BY ALL",
)
def chosen_time(spark, sf_dir):
    """A time column of the caller's takes precedence over time and step."""
    issued = grid(spark, sf_dir).withColumn("issued", F.col("time") + F.expr("interval 3 days"))
    timed = spatial.valid_time(issued, time_column="issued")
    return timed.groupBy("variable", "datetime").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query(
    "named_coordinates",
    f"WITH {GRID_SQL}, {MASK_SQL} SELECT region_id, region, count(*) AS n FROM grid JOIN mask USING (latitude, longitude) GROUP BY ALL",
)
def named_coordinates(spark, sf_dir):
    """A grid whose coordinates have names of their own, brought to the known ones and placed in regions."""
    own = grid(spark, sf_dir).withColumnsRenamed({"longitude": "x", "latitude": "y"})
    placed = spatial.with_region(lonlat_columns(own, "x", "y"), rings(spark))
    return placed.groupBy("region_id", "region").agg(F.count("*").alias("n"))


@query("first_slice", f"WITH {GRID_SQL} SELECT grid.* FROM grid JOIN (SELECT variable, min(time) AS t FROM grid GROUP BY 1) m ON m.variable = grid.variable AND t = time")
def first_slice(spark, sf_dir):
    return spatial.first_slice(grid(spark, sf_dir))


@query(
    "grid_summary",
    f"""WITH {GRID_SQL} SELECT variable, count(*) AS n_values, count(*) FILTER (WHERE value IS NULL) AS n_null,
      min(time) AS time_min, max(time) AS time_max, min(latitude) AS latitude_min, max(latitude) AS latitude_max,
      min(longitude) AS longitude_min, max(longitude) AS longitude_max, count(DISTINCT time) AS n_time,
      count(DISTINCT latitude) AS n_latitude, count(DISTINCT longitude) AS n_longitude FROM grid GROUP BY 1""",
)
def grid_summary(spark, sf_dir):
    return spatial.grid_summary(grid(spark, sf_dir))


@query(
    "missing_steps",
    f"""WITH {GRID_SQL}, runs AS (SELECT DISTINCT variable, time FROM grid),
    cal AS (SELECT unnest(list_concat(generate_series(0, 120), generate_series(123, 384, 3))) AS h),
    seen AS (SELECT DISTINCT variable, time, step_hours FROM grid)
    SELECT variable, time, CAST(h AS INTEGER) AS step_hours, lpad(CAST(h AS VARCHAR), 3, '0') AS label FROM runs, cal
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.variable = runs.variable AND s.time = runs.time AND s.step_hours = h)""",
)
def missing_steps(spark, sf_dir):
    return weather.missing_steps(grid(spark, sf_dir))


def _wide(spark, sf_dir):
    return forecast.regional_table(grid(spark, sf_dir), rings(spark), ["South", "North"])


LEVEL_SQL = MEANS_SQL + """,
lm AS (SELECT variable, datetime, region, level, avg(value) AS m FROM timed JOIN mask USING (latitude, longitude) GROUP BY ALL),
rm AS (SELECT variable, datetime, region, avg(m) AS mean_value FROM lm GROUP BY ALL),
wide AS (SELECT variable, (datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/Santiago' AS datetime,
  max(mean_value) FILTER (WHERE region = 'South') AS South, max(mean_value) FILTER (WHERE region = 'North') AS North FROM rm GROUP BY 1, 2)
"""


def _rounded(df, names):
    return df.withColumns({c: r(F.col(c)) for c in names}).withColumns(
        {c: r(F.col(c)) for c in df.columns if c[-4:] in ("_sin", "_cos")},
    )


@query(
    "wind_features",
    LEVEL_SQL + f"""SELECT u.datetime, round(u.South, 6) + 0.0 AS South_u100_means, round(u.North, 6) + 0.0 AS North_u100_means,
    round(v.South, 6) + 0.0 AS South_v100_means, round(v.North, 6) + 0.0 AS North_v100_means, 120 AS total_plants,
    {_cycle_sql('u.datetime')}, CAST(year(u.datetime) AS INTEGER) AS year
    FROM wide u JOIN wide v ON u.datetime = v.datetime WHERE u.variable = 'u100' AND v.variable = 'v100'""",
)
def wind_features(spark, sf_dir):
    out = forecast.wind_features(_wide(spark, sf_dir), 120)
    return _rounded(out, [f"{a}_{b}_means" for a in ("South", "North") for b in ("u100", "v100")])


@query(
    "solar_features",
    LEVEL_SQL + f"""SELECT datetime, round(South, 6) + 0.0 AS South, round(North, 6) + 0.0 AS North, 80 AS total_plants,
    {_cycle_sql('datetime')}, CAST(year(datetime) AS INTEGER) AS year FROM wide WHERE variable = 'sdswrf'""",
)
def solar_features(spark, sf_dir):
    return _rounded(forecast.solar_features(_wide(spark, sf_dir), 80), ["South", "North"])
