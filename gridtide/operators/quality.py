"""Completeness checks over dates and hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridtide.functions.timeparts import epoch_us, iso_date
from gridtide.operators.ordering import islands, previous_in_order, time_slices
from gridtide.operators.quantiles import attach_one
from gridtide.operators.series import STEP_SECONDS, expand_runs

STEPS = {
    "day": "interval 1 day",
    "hour": "interval 1 hour",
    "minute": "interval 1 minute",
    "week": "interval 7 days",
    "month": "interval 1 month",
}


def _times(df: DataFrame, ts: str, step: str, keys) -> DataFrame:
    t = F.col(ts).cast("timestamp_ntz")
    if step == "day":
        t = F.date_trunc("day", t).cast("timestamp_ntz")
    return df.select(*keys, t.alias(ts)).na.drop(subset=[*keys, ts]).distinct()


def missing_times(df: DataFrame, ts: str, step: str = "day", keys=()) -> DataFrame:
    """Times between the first and last that do not occur (Q1).

    Steps count from the first time; times off that grid are not expected. Neighbours on the grid give
    the runs of missing steps, so only missing times are made, piece by piece. Months, whose
    length varies, are matched against a calendar of the whole span.
    """
    if step not in STEPS:
        raise ValueError(f"unknown step {step!r}")
    keys = list(keys)
    actual = _times(df, ts, step, keys)
    width = F.expr(STEPS[step])
    if step == "month":
        span = actual.groupBy(*keys).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
        expected = span.where(F.col("_from").isNotNull()).select(*keys, F.explode(F.sequence("_from", "_to", width)).alias(ts))
        return expected.join(actual, [*keys, ts], "left_anti")
    length = STEP_SECONDS[step] * 1_000_000
    known = actual
    if step != "day":  # days are cut to their start, so they all lie on the grid
        span = actual.groupBy(*keys).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
        off = (epoch_us(ts) - epoch_us("_from")) % length
        on_grid = (actual.join(span, keys) if keys else attach_one(actual, span)).where(off == 0).select(*keys, ts)
        # The step after the last time closes the grid, since that time may lie off it.
        beyond = F.expr(f"timestampdiff(MICROSECOND, _from, _to) div {length}") + 1
        ends = span.where(F.col("_from").isNotNull()).select(*keys, (F.col("_from") + width * beyond).alias(ts))
        known = on_grid.unionByName(ends)
    cut, slices = time_slices(known, keys, ts, sizing=actual)
    gaps = previous_in_order(cut, keys, ts, "_prev", slices).withColumn(
        "_missing", ((epoch_us(ts) - epoch_us("_prev")) / length).cast("bigint") - 1,
    )
    gaps = gaps.where(F.col("_missing") > 0).select(*keys, (F.col("_prev") + width).alias("_start"), "_missing")
    return expand_runs(gaps, "_start", F.col("_missing"), width, ts).select(*keys, ts)


def missing_clusters(df: DataFrame, ts: str, step: str = "day", keys=()) -> DataFrame:
    """Runs of missing times with start, end and size."""
    return islands(missing_times(df, ts, step, keys), keys, ts)


def missing_report(df: DataFrame, ts: str, step: str = "day", listed: int = 10) -> DataFrame:
    """Report lines: single dates if at most ``listed`` are missing, else clusters (Q2)."""
    gaps = missing_times(df, ts, step)
    total = gaps.agg(F.count("*").alias("_missing"))
    clusters = attach_one(islands(gaps, [], ts), total).where(F.col("_missing") > listed)
    cluster_lines = clusters.select(
        F.col("island_start").alias("first"),
        F.when(
            F.col("island_size") == 1, F.concat(F.lit("Isolated missing date: "), iso_date("island_start")),
        ).otherwise(
            F.format_string(
                "Missing cluster #%d: %s to %s (%d dates)",
                F.col("island"), iso_date("island_start"), iso_date("island_end"), F.col("island_size"),
            ),
        ).alias("line"),
    )
    date_lines = attach_one(gaps, total).where(F.col("_missing") <= listed).select(
        F.col(ts).alias("first"), F.concat(F.lit("Missing date: "), iso_date(ts)).alias("line"),
    )
    return cluster_lines.unionByName(date_lines)


def invalid_hours(df: DataFrame, hour: str) -> DataFrame:
    """Rows whose hour is not in 0..23, null included (Q3)."""
    return df.where(~F.coalesce(F.col(hour).between(0, 23), F.lit(False)))


def missing_hours(df: DataFrame, date: str, hour: str, keys=()) -> DataFrame:
    """Days that lack some of the hours 0..23, and which (Q4).

    Only valid hours are gathered, so a day's set holds at most 24 values.
    """
    valid = F.when(F.col(hour).between(0, 23), F.col(hour).cast("int"))
    per_day = df.na.drop(subset=[*keys, date]).groupBy(*keys, date).agg(F.collect_set(valid).alias("_seen"))
    lacking = F.array_except(F.sequence(F.lit(0), F.lit(23)), F.col("_seen"))
    return per_day.select(*keys, date, lacking.alias("missing_hours")).where(F.size("missing_hours") > 0)


def duplicate_hours(df: DataFrame, date: str, hour: str, keys=()) -> DataFrame:
    """Hours that occur more than once on a day, with their count, in long form (Q5)."""
    return (
        df.na.drop(subset=[*keys, date, hour])
        .groupBy(*keys, date, hour)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def duplicate_hour_maps(df: DataFrame, date: str, hour: str, keys=()) -> DataFrame:
    """One map of hour to count per day for the valid hours (Q5)."""
    valid = df.where(F.col(hour).between(0, 23))
    return duplicate_hours(valid, date, hour, keys).groupBy(*keys, date).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(hour), F.col("n"))))).alias("duplicates"),
    )


def date_completeness(df: DataFrame, ts: str, step: str = "day", keys=()) -> DataFrame:
    """Range, record count and number of missing times (Q6); the list itself is ``missing_times``.

    For days the missing number is the span less the days present, without a calendar.
    """
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("records"),
    )
    if step == "day":
        present = _times(df, ts, step, keys).groupBy(*keys).agg(
            (F.date_diff(F.max(ts), F.min(ts)) + 1 - F.count("*")).cast("bigint").alias("missing"),
        )
    else:
        present = missing_times(df, ts, step, keys).groupBy(*keys).agg(F.count("*").alias("missing"))
    joined = base.join(present, keys, "left") if keys else attach_one(base, present)
    missing = F.coalesce("missing", F.lit(0))
    return joined.select(
        *keys, "first", "last", "records", missing.alias("missing"), (missing == 0).alias("complete"),
    )


def hour_issues(df: DataFrame, date: str, hour: str) -> DataFrame:
    """Invalid, missing and duplicated hours as (issue, date, hour, n) rows (Q7)."""
    wrong = invalid_hours(df, hour).groupBy(date, hour).agg(F.count("*").alias("n"))
    lacking = missing_hours(df, date, hour).select(
        date, F.explode("missing_hours").alias(hour), F.lit(1).cast("bigint").alias("n"),
    )
    repeated = duplicate_hours(df, date, hour)
    parts = [("invalid", wrong), ("missing", lacking), ("duplicate", repeated)]
    tagged = [
        part.select(F.lit(tag).alias("issue"), F.col(date), F.col(hour).cast("int").alias(hour), "n")
        for tag, part in parts
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def hour_completeness(df: DataFrame, date: str, hour: str) -> DataFrame:
    """Number of rows or days per hour issue in one row (Q7)."""
    issues = hour_issues(df, date, hour)
    return issues.agg(
        F.coalesce(F.sum(F.when(F.col("issue") == "invalid", F.col("n"))), F.lit(0)).alias("invalid_rows"),
        F.count_distinct(F.when(F.col("issue") == "missing", F.col(date))).alias("days_with_missing_hours"),
        F.count_distinct(F.when(F.col("issue") == "duplicate", F.col(date))).alias("days_with_duplicate_hours"),
    )


def series_check(df: DataFrame, date: str, hour: str | None = None, step: str = "day") -> DataFrame:
    """Date completeness, with the hour summary beside it if an hour column is named (Q8)."""
    dates = date_completeness(df, date, step)
    return dates if hour is None else attach_one(dates, hour_completeness(df, date, hour))
