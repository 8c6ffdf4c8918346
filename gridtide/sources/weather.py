"""Gridded weather tables, landed forecast files and region boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SMALLEST_FILE = 10_000  # bytes a landed file must exceed
HOURLY_UNTIL = 120


def read_grid(spark: SparkSession, path: str, variables=None) -> DataFrame:
    """Long grid partitioned by ``variable`` (A5); other variables are never opened."""
    grid = spark.read.parquet(path)
    return grid if variables is None else grid.where(F.col("variable").isin(list(variables)))


def write_grid(grid: DataFrame, path: str) -> None:
    """Grid as Parquet by variable, ordered by time within files.

    Ranges over (variable, time, latitude) keep files even when one time or variable is crowded.
    """
    (
        grid.repartitionByRange("variable", "time", "latitude", "longitude")
        .sortWithinPartitions("variable", "time")
        .write.mode("overwrite").partitionBy("variable").parquet(path)
    )


def combine_steps(spark: SparkSession, paths: list[str], output: str) -> DataFrame:
    """Per-step grid files into one ordered data set.

    One scan of all files; columns are matched by name, from the footers, which Spark merges in a job of its own.
    """
    if not paths:
        raise ValueError("no step files")
    write_grid(spark.read.option("mergeSchema", True).parquet(*paths), output)
    return spark.read.parquet(output)


def landed_files(spark: SparkSession, pattern: str, smallest: int = SMALLEST_FILE) -> DataFrame:
    """Path, size and acceptance of landed files (A7); contents are not read.

    A scan passes over files of zero bytes, so those come from the source's own file listing.
    """
    source = spark.read.format("binaryFile").load(pattern)
    bare = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    sizes = source.select(bare.alias("path"), "length")
    names = spark.createDataFrame([(p,) for p in source.inputFiles()], "path string").select(
        F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))).alias("path"),
    )
    listing = names.join(sizes, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))
    return listing.withColumn("accepted", F.col("length") > smallest)


def forecast_steps(spark: SparkSession, horizon: int = 384) -> DataFrame:
    """Forecast hours to fetch: hourly to 120, then every third."""
    near = F.sequence(F.lit(0), F.lit(min(horizon, HOURLY_UNTIL)))
    steps = near if horizon < HOURLY_UNTIL + 3 else F.concat(near, F.sequence(F.lit(HOURLY_UNTIL + 3), F.lit(horizon), F.lit(3)))
    return spark.range(1).select(F.explode(steps).alias("step_hours")).withColumn(
        "label", F.lpad(F.col("step_hours").cast("string"), 3, "0"),
    )


def missing_steps(grid: DataFrame, horizon: int = 384) -> DataFrame:
    """Calendar steps each (variable, time) lacks."""
    runs = grid.select("variable", "time").distinct()
    seen = grid.select("variable", "time", "step_hours").distinct()
    near = F.sequence(F.lit(0), F.lit(min(horizon, HOURLY_UNTIL)))
    far = F.sequence(F.lit(HOURLY_UNTIL + 3), F.lit(horizon), F.lit(3)) if horizon >= HOURLY_UNTIL + 3 else F.array().cast("array<int>")
    expected = runs.withColumn("step_hours", F.explode(F.concat(near, far)))
    return expected.join(seen, ["variable", "time", "step_hours"], "left_anti").withColumn(
        "label", F.lpad(F.col("step_hours").cast("string"), 3, "0"),
    )


def read_regions(spark: SparkSession, path: str, name: str = "region") -> DataFrame:
    """Ring vertices in lon/lat."""
    rings = spark.read.parquet(path)
    return rings if name == "region" else rings.withColumnRenamed(name, "region")
