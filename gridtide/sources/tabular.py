"""Delimited text in, delimited text and Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridtide.functions.timeparts import DEFAULT_ZONE, to_utc, to_zone
from gridtide.operators.joins import union_tables

CORRUPT = "_corrupt_record"

# Known market table.
GENERATION_SCHEMA = (
    "fecha_opreal date, hora_opreal int, central_nombre string, central_tipo_nemotecnico string, "
    "subtipo string, generacion_real_mwh double"
)


def _with_zone(zone: str):
    """Values with an offset are instants; bare ones are wall times of ``zone``."""

    def parse(text):
        offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$")
        instant = F.try_to_timestamp(text).cast("timestamp_ntz")
        return F.when(offset, instant).otherwise(to_utc(instant, zone))

    return parse


def read_series_csv(
    spark: SparkSession, path, datetime_col: str = "datetime", input_zone: str = "UTC",
    output_zone: str | None = DEFAULT_ZONE, schema: StructType | str | None = None,
) -> DataFrame:
    """CSV with a header whose time column becomes wall time in ``output_zone`` (A1).

    Bare times belong to ``input_zone``. Give a schema for large inputs; without one
    column types are inferred from the text.
    """
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if datetime_col not in raw.columns:
        raise ValueError(f"column {datetime_col!r} not found")
    kind = raw.schema[datetime_col].dataType.simpleString()
    moment = F.col(datetime_col)
    moment = _with_zone(input_zone)(moment) if kind == "string" else to_utc(moment.cast("timestamp_ntz"), input_zone)
    if kind == "timestamp":  # already an instant
        moment = F.col(datetime_col).cast("timestamp_ntz") if input_zone == "UTC" else moment
    shown = moment if output_zone is None else to_zone(moment, output_zone)
    return raw.withColumn(datetime_col, shown)


def _by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Files in groups of equal header lines, in the order their first file was given; files without a line are left out."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    heads = (
        lines.where(F.length("value") > 0).withColumn("at", F.struct("block", F.monotonically_increasing_id().alias("row")))
        .groupBy("path").agg(F.min_by("value", "at").alias("head"))
    )
    groups = heads.groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # names only, as many as the scan lists anyway
    return sorted(r["paths"] for r in groups.collect())


def concat_csv(spark: SparkSession, paths: list[str], output: str | None = None, schemas=None) -> DataFrame:
    """Row union of files with differing headers, columns matched by name (A2).

    Files with one header, or one schema, are one scan: the plan grows with the number of headers, not of files.
    """
    if schemas:
        groups: dict[str, list[str]] = {}
        kinds = {}
        for path, kind in zip(paths, schemas, strict=True):
            key = kind if isinstance(kind, str) else kind.json()
            groups.setdefault(key, []).append(path)
            kinds[key] = kind
        tables = [spark.read.option("header", True).schema(kinds[k]).csv(files) for k, files in groups.items()]
    else:
        tables = [spark.read.option("header", True).option("inferSchema", True).csv(files) for files in _by_header(spark, paths)]
    if not tables:
        raise ValueError("no file has a header")
    merged = union_tables(tables)
    if output is not None:
        merged.write.mode("overwrite").option("header", True).csv(output)
    return merged


def convert_delimited(spark: SparkSession, pattern: str, output: str, separator: str = "\t", schema=None, form: str = "csv") -> DataFrame:
    """All files of a glob from one delimiter to CSV or Parquet, and a row per input file.

    The files are one distributed scan, so a thousand small ones cost one job.
    """
    reader = spark.read.option("header", True).option("sep", separator)
    rows = reader.schema(schema).csv(pattern) if schema else reader.csv(pattern)
    writer = rows.write.mode("overwrite")
    (writer.option("header", True).csv(output) if form == "csv" else writer.parquet(output))
    return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))


def map_files(rows: DataFrame, function, schema: str, file_column: str = "file", parts: int = 64) -> DataFrame:
    """User function over batches of each file's rows.

    A large file is cut into ``parts`` groups, so no task takes a whole one; the function
    sees one batch at a time.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    return rows.groupBy(file_column, part.alias("part_")).applyInPandas(function, schema)


def ingest_csv(spark: SparkSession, paths, schema: str, datetime_col: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Typed rows of many files and an outcome per file (A4).

    Bad lines and unreadable times are counted, never dropped silently.
    """
    fields = StructType.fromDDL(schema)
    if datetime_col not in fields.fieldNames():
        raise ValueError(f"column {datetime_col!r} is not in the schema")
    full = StructType.fromDDL(f"{schema}, {CORRUPT} string")
    raw = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", CORRUPT).schema(full).csv(paths)
        .withColumn("file", F.col("_metadata.file_name"))
    )
    bad_time = F.col(datetime_col).isNull()
    bad_line = F.col(CORRUPT).isNotNull()
    # A field is only parsed, and a bad one only seen, if its column is used: hence the null count.
    nulls = sum(F.col(f).isNull().cast("bigint") for f in fields.fieldNames())
    report = raw.groupBy("file").agg(
        F.count("*").alias("rows"), F.count_if(bad_line).alias("bad_lines"), F.count_if(bad_time).alias("bad_times"),
        F.sum(nulls).alias("null_cells"),
    )
    outcome = F.when(F.col("bad_times") == F.col("rows"), "unreadable times").when(
        F.col("bad_lines") + F.col("bad_times") > 0, "partly read",
    ).otherwise("read")
    return raw.where(~bad_time).drop(CORRUPT), report.withColumn("outcome", outcome)


def empty_files(report: DataFrame, listing: DataFrame) -> DataFrame:
    """Files without a data row, which no scan reports by itself (A4)."""
    names = listing.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return names.join(report, "file", "left_anti").withColumn("outcome", F.lit("empty"))


def write_means(means: DataFrame, path: str, form: str = "csv") -> None:
    """One folder per variable."""
    writer = means.write.mode("overwrite").partitionBy("variable")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_components(parts: DataFrame, path: str, keys=("series_id", "pos"), separate: bool = True, form: str = "csv") -> None:
    """Decomposition components in one folder each, or one wide table."""
    table = parts
    if separate:
        names = [c for c in parts.columns if c not in keys]
        table = parts.unpivot(list(keys), names, "component", "value")
    writer = table.write.mode("overwrite")
    writer = writer.partitionBy("component") if separate else writer
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def table_info(df: DataFrame) -> DataFrame:
    """Column, type and non-null count (A10)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).alias("non_null"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*entries)))
