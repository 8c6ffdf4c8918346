"""Queries that write files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import decomposition as D, models as M
from gridtide.plans import forecast
from gridtide.plans.fixtures import (
    GENERATION_SQL, GRID_SQL, HOURLY_KIND_SQL, KINDS, generation, grid, hourly_by_kind, rings, table,
)
from gridtide.plans.queries_series import STL_SQL
from gridtide.plans.registry import query, steady_round as r
from gridtide.plans.scratch import fresh_folder
from gridtide.sources import tabular, weather


@query(
    "series_csv",
    f"""WITH {HOURLY_KIND_SQL} SELECT series_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Santiago' AS datetime,
    round(value, 4) + 0.0 AS value FROM hk""",
)
def series_csv(spark, sf_dir):
    folder = fresh_folder(spark, "series")
    rows = hourly_by_kind(spark, sf_dir).select("series_id", F.col("ts").alias("datetime"), "value")
    rows.write.option("header", True).csv(folder, mode="overwrite")
    read = tabular.read_series_csv(spark, folder, schema="series_id string, datetime string, value double")
    return read.withColumn("value", r(F.col("value"), 4))


@query(
    "tsv_conversion",
    f"""WITH {GENERATION_SQL} SELECT central_tipo_nemotecnico, count(*) AS n, round(sum(generacion_real_mwh), 2) + 0.0 AS mwh FROM gen GROUP BY 1""",
)
def tsv_conversion(spark, sf_dir):
    source, target = fresh_folder(spark, "tsv"), fresh_folder(spark, "converted")
    rows = generation(spark, sf_dir).withColumn("fecha_opreal", F.to_date("fecha_opreal")).drop("event_id", "ts")
    rows.write.option("header", True).option("sep", "\t").csv(source, mode="overwrite")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    tabular.convert_delimited(spark, source, target, schema=schema, form="parquet")
    back = spark.read.parquet(target)
    return back.groupBy("central_tipo_nemotecnico").agg(
        F.count("*").alias("n"), r(F.sum("generacion_real_mwh"), 2).alias("mwh"),
    )


@query(
    "concat_files",
    "SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{k}' THEN value END AS {k}" for k in KINDS) + " FROM events",
)
def concat_files(spark, sf_dir):
    """One folder of files per type, each with a header of its own."""
    folder = fresh_folder(spark, "kinds")
    for kind in KINDS:
        rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
        rows.select("event_id", F.col("value").alias(kind)).write.option("header", True).csv(f"{folder}/{kind}", mode="overwrite")
    merged = tabular.concat_csv(spark, [f"{folder}/{kind}" for kind in KINDS])
    return merged.select(F.col("event_id").cast("bigint").alias("event_id"), *[F.col(k).cast("double").alias(k) for k in KINDS])


@query(
    "combined_steps",
    f"""WITH {GRID_SQL} SELECT variable, time, step_hours, latitude, longitude, value, CASE WHEN step_hours % 3 = 1 THEN level END AS level FROM grid""",
)
def combined_steps(spark, sf_dir):
    """Files per forecast step, some without a level, put together and read back."""
    folder = fresh_folder(spark, "steps")
    whole = grid(spark, sf_dir)
    for i in range(3):
        part = whole.where(F.col("step_hours") % 3 == i)
        (part if i == 1 else part.drop("level")).write.parquet(f"{folder}/step{i}")
    return weather.combine_steps(spark, [f"{folder}/step{i}" for i in range(3)], f"{folder}/grid")


@query(
    "variable_files",
    f"WITH {GRID_SQL} SELECT variable, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM grid GROUP BY 1",
)
def variable_files(spark, sf_dir):
    """One folder of delimited text per variable, read back by its folder name."""
    folder = fresh_folder(spark, "variables")
    tabular.write_means(grid(spark, sf_dir), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.groupBy("variable").agg(F.count("*").alias("n"), r(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query(
    "ingest_report",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 11 = 0 OR event_id % 13 = 0) AS bad_lines,
      count(*) FILTER (WHERE event_id % 11 = 0) AS bad_times,
      count(*) FILTER (WHERE event_id % 11 = 0) + count(*) FILTER (WHERE event_id % 13 = 0) AS null_cells FROM events""",
)
def ingest_report(spark, sf_dir):
    folder = fresh_folder(spark, "ingest")
    e = F.col("event_id")
    text = table(spark, sf_dir, "events").select(
        F.when(e % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("datetime"),
        F.when(e % 13 == 0, "many").otherwise(F.col("value").cast("string")).alias("value"),
    )
    text.write.option("header", True).csv(folder, mode="overwrite")
    _, report = tabular.ingest_csv(spark, folder, "datetime timestamp_ntz, value double")
    return report.agg(*[F.sum(c).alias(c) for c in ("rows", "bad_lines", "bad_times", "null_cells")])


@query(
    "component_files",
    STL_SQL + ", e AS (SELECT * FROM stl WHERE n >= 48) " + " UNION ALL ".join(
        f"SELECT s AS series_id, pos, '{name}' AS component, round({cell}, 4) + 0.0 AS value FROM e"
        for name, cell in (("observed", "y"), ("trend", "trend"), ("seasonal", "season"), ("resid", "y - trend - season"))
    ),
)
def component_files(spark, sf_dir):
    """One folder per component, read back by its folder name."""
    folder = fresh_folder(spark, "components")
    tabular.write_components(D.stl(hourly_by_kind(spark, sf_dir), ["series_id"], 24), folder, form="parquet")
    return spark.read.parquet(folder).select("series_id", "pos", "component", r(F.col("value"), 4).alias("value"))


@query(
    "mapped_files",
    "SELECT event_type AS kind, count(*) AS n, max(value) AS top, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1",
)
def mapped_files(spark, sf_dir):
    """A function over batches of each file's rows; its records are put together per file."""
    folder = fresh_folder(spark, "mapped")
    table(spark, sf_dir, "events").select("event_type", "event_id", "value").write.partitionBy("event_type").parquet(folder, mode="overwrite")

    def summed(frame):
        return frame.groupby("file", as_index=False).agg(n=("value", "count"), top=("value", "max"), total=("value", "sum"))

    rows = spark.read.parquet(folder).withColumnRenamed("event_type", "file")
    parts = tabular.map_files(rows, summed, "file string, n bigint, top double, total double")
    return parts.groupBy(F.col("file").alias("kind")).agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), r(F.sum("total"), 4).alias("total"),
    )


@query(
    "grid_store",
    f"WITH {GRID_SQL} SELECT time, step_hours, level, latitude, longitude, value FROM grid WHERE variable = 'u100'",
)
def grid_store(spark, sf_dir):
    folder = fresh_folder(spark, "grid")
    weather.write_grid(grid(spark, sf_dir), folder)
    return weather.read_grid(spark, folder, ["u100"]).drop("variable")


@query("landed_files")
def landed_files(spark, sf_dir):
    files = weather.landed_files(spark, f"{sf_dir}/*.parquet")
    return files.withColumn("path", F.element_at(F.split("path", "/"), -1))


@query("batch_score")
def batch_score(spark, sf_dir):
    """Trains on wind features, stores the bundle, loads it and scores the stored features."""
    folder = fresh_folder(spark, "bundle")
    tables = forecast.run_features(grid(spark, sf_dir), rings(spark), ["South", "North"], f"{folder}/features", {"wind": 120})
    wind = spark.read.parquet(f"{folder}/features/wind").na.drop()
    target = tables["solar"].select("datetime", F.col("South").alias("target")).na.drop()
    features = [c for c in wind.columns if c != "datetime"]
    model = M.make_model("ridge").fit(wind.join(target, "datetime"), features, "target")
    M.save_bundle(model, f"{folder}/model", spark)
    return forecast.predict_from_bundle(wind, f"{folder}/model")
