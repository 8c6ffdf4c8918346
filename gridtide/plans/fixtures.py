"""Energy-shaped tables derived from the supplied tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtide.functions import timeparts as T
from gridtide.session import prepare

KINDS = ["click", "error", "purchase", "signup", "view"]
SUBTYPES = [k + b for k in KINDS for b in "01"]

# Region rings as (region_id, region, ring_id, seq, lon, lat).
RING_ROWS = [
    (0, "South", 0, 0, -76.5, -56.5),
    (0, "South", 0, 1, -65.5, -56.5),
    (0, "South", 0, 2, -65.5, -35.25),
    (0, "South", 0, 3, -76.5, -35.25),
    (1, "North", 0, 0, -76.5, -35.25),
    (1, "North", 0, 1, -65.5, -35.25),
    (1, "North", 0, 2, -71.2, -14.5),
]
RING_SCHEMA = "region_id int, region string, ring_id int, seq int, lon double, lat double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def generation(spark, sf_dir) -> DataFrame:
    """Plant-level hourly generation in market form."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        T.truncate("ts", "day").alias("fecha_opreal"),
        F.when(F.col("event_id") % 997 == 0, 25).otherwise(F.hour("ts") + 1).alias("hora_opreal"),
        F.concat_ws("-", "event_type", "user_id").alias("central_nombre"),
        F.col("event_type").alias("central_tipo_nemotecnico"),
        F.concat("event_type", (F.col("user_id") % 2).cast("string")).alias("subtipo"),
        F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")).alias("generacion_real_mwh"),
    )


GENERATION_SQL = """
gen AS (
  SELECT event_id, ts, date_trunc('day', ts) AS fecha_opreal,
         CAST(CASE WHEN event_id % 997 = 0 THEN 25 ELSE hour(ts) + 1 END AS INTEGER) AS hora_opreal,
         event_type || '-' || user_id AS central_nombre, event_type AS central_tipo_nemotecnico,
         event_type || (user_id % 2) AS subtipo,
         CASE WHEN value < 10 THEN 0.0 ELSE value END AS generacion_real_mwh
  FROM events)"""


def grid(spark, sf_dir) -> DataFrame:
    """Forecast grid in long form."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(e % 3 == 0, "u100").when(e % 3 == 1, "v100").otherwise("sdswrf").alias("variable"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"),
        F.hour("ts").alias("step_hours"),
        (500 + 350 * (e % 2)).cast("double").alias("level"),
        (-56 + F.col("user_id") % 42).cast("double").alias("latitude"),
        (-76 + e % 11).cast("double").alias("longitude"),
        F.col("value"),
    )


GRID_SQL = """
grid AS (
  SELECT CASE event_id % 3 WHEN 0 THEN 'u100' WHEN 1 THEN 'v100' ELSE 'sdswrf' END AS variable,
         date_trunc('day', ts) AS time, CAST(hour(ts) AS INTEGER) AS step_hours,
         CAST(500 + 350 * (event_id % 2) AS DOUBLE) AS level,
         CAST(-56 + user_id % 42 AS DOUBLE) AS latitude, CAST(-76 + event_id % 11 AS DOUBLE) AS longitude, value
  FROM events)"""


def rings(spark) -> DataFrame:
    return spark.createDataFrame(RING_ROWS, RING_SCHEMA)


def _edge_rows() -> str:
    by_region: dict = {}
    for rid, name, _, _, lon, lat in RING_ROWS:
        by_region.setdefault((rid, name), []).append((lon, lat))
    rows = []
    for (rid, name), pts in by_region.items():
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            rows.append(f"({rid}, '{name}', {x1}, {y1}, {x2}, {y2})")
    return ", ".join(rows)


MASK_SQL = f"""
edges(region_id, region, x1, y1, x2, y2) AS (
  SELECT region_id, region, CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE)
  FROM (VALUES {_edge_rows()}) v(region_id, region, x1, y1, x2, y2)),
cells AS (SELECT DISTINCT latitude, longitude FROM grid),
inside AS (
  SELECT latitude, longitude, region_id, region FROM cells, edges
  WHERE ((y1 <= latitude AND latitude < y2) OR (y2 <= latitude AND latitude < y1))
    AND x1 + (latitude - y1) / (y2 - y1) * (x2 - x1) > longitude
  GROUP BY ALL HAVING count(*) % 2 = 1),
mask AS (SELECT latitude, longitude, min(region_id) AS region_id, min_by(region, region_id) AS region
         FROM inside GROUP BY ALL)"""


def hourly_total(spark, sf_dir) -> DataFrame:
    """Gap-free hourly series of the summed value with its position."""
    from gridtide.operators.series import regular_series

    events = table(spark, sf_dir, "events").select(F.lit("total").alias("series_id"), "ts", "value")
    return regular_series(events, ["series_id"], "ts", "value", "hour")


def hourly_by_kind(spark, sf_dir) -> DataFrame:
    """One gap-free hourly series per type; absent hours count as zero."""
    from gridtide.operators.series import regular_series

    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return regular_series(events, ["series_id"], "ts", "value", "hour")


HOURLY_SQL = """
hourly AS (
  SELECT h AS ts, date_diff('hour', (SELECT date_trunc('hour', min(ts)) FROM events), h) AS pos, coalesce(s, 0.0) AS value
  FROM (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events),
                                      (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS h) g
  LEFT JOIN (SELECT date_trunc('hour', ts) AS th, sum(value) AS s FROM events GROUP BY 1) e ON th = h)"""

HOURLY_KIND_SQL = """
spans AS (SELECT event_type, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events GROUP BY 1),
spine AS (SELECT event_type, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM spans),
sums AS (SELECT event_type, date_trunc('hour', ts) AS th, sum(value) AS s FROM events GROUP BY 1, 2),
hk AS (
  SELECT spine.event_type AS series_id, h AS ts, date_diff('hour', lo, h) AS pos, coalesce(s, 0.0) AS value
  FROM spine LEFT JOIN sums ON sums.event_type = spine.event_type AND th = h)"""
