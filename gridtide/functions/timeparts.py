"""Time expressions: truncation, zones, cyclical encoding, market hours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

DEFAULT_ZONE = "America/Santiago"

# Accepted resolution spellings and the date_trunc unit each stands for.
RESOLUTION_UNITS = {
    "minute": "minute",
    "min": "minute",
    "hour": "hour",
    "h": "hour",
    "H": "hour",
    "day": "day",
    "D": "day",
    "week": "week",
    "W": "week",
    "month": "month",
    "M": "month",
    "quarter": "quarter",
    "Q": "quarter",
    "year": "year",
    "Y": "year",
}

# Fixed cycle lengths of the encoded calendar parts.
CYCLE_LENGTHS = {"hour": 24, "day": 31, "month": 12, "dayofweek": 7}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(c, resolution: str) -> Column:
    """Start of the period a wall time falls in; weeks start on Monday (B2).

    A bare ``m`` is refused: it could mean minute or month.
    """
    if resolution == "exact":
        return _col(c)
    unit = RESOLUTION_UNITS.get(resolution)
    if unit is None:
        raise ValueError(f"unknown resolution {resolution!r}")
    return F.date_trunc(unit, _col(c)).cast("timestamp_ntz")


def to_zone(c, zone: str = DEFAULT_ZONE) -> Column:
    """UTC instant to wall time in ``zone``."""
    return F.from_utc_timestamp(_col(c), zone).cast("timestamp_ntz")


def to_utc(c, zone: str = DEFAULT_ZONE) -> Column:
    """Wall time in ``zone`` to UTC; ambiguous times give the earlier instant."""
    return F.to_utc_timestamp(_col(c), zone).cast("timestamp_ntz")


def epoch_us(c) -> Column:
    """Microseconds since 1970 (sessions run in UTC)."""
    return F.unix_micros(_col(c).cast("timestamp"))


def time_between(df: DataFrame, column: str, start: str, end: str, zone: str | None = None) -> DataFrame:
    """Rows with ``start <= column <= end`` (B1).

    The bounds are literals, so the predicate reaches the Parquet scan. A bound
    given as a date means its midnight, hence only the first instant of the last
    day is kept. With ``zone`` the bounds are wall times there and the column is UTC.
    """
    if column not in df.columns:
        raise KeyError(f"column {column!r} not found")
    kind = df.schema[column].dataType
    if not isinstance(kind, (TimestampType, TimestampNTZType)):
        raise ValueError(f"column {column!r} is {kind.simpleString()}, not a timestamp")
    low, high = (F.lit(b).cast("timestamp_ntz") for b in (start, end))
    if zone is not None:
        low, high = to_utc(low, zone), to_utc(high, zone)
    return df.where(F.col(column).between(low.cast(kind), high.cast(kind)))


def _calendar_part(c: Column, part: str) -> Column:
    return {
        "hour": F.hour(c),
        "day": F.dayofmonth(c),
        "month": F.month(c),
        "dayofweek": F.weekday(c),
    }[part]


def add_cycles(df: DataFrame, column: str, parts=("hour", "day", "month"), with_year: bool = True) -> DataFrame:
    """Sine and cosine of calendar parts plus the year (B3); unknown parts are skipped."""
    if column not in df.columns:
        raise ValueError(f"column {column!r} not found")
    c = F.col(column)
    added = {}
    for part in parts:
        if part not in CYCLE_LENGTHS:
            continue
        angle = _calendar_part(c, part) * F.lit(2 * math.pi / CYCLE_LENGTHS[part])
        added[f"{part}_sin"] = F.sin(angle)
        added[f"{part}_cos"] = F.cos(angle)
    if with_year:
        added["year"] = F.year(c)
    return df.withColumns(added)


def market_datetime(
    df: DataFrame,
    date: str = "fecha_opreal",
    hour: str = "hora_opreal",
    out: str = "datetime",
    dropped_hour: int | None = 25,
    shift: int = -1,
) -> DataFrame:
    """Wall time from a date and a one-based hour; the extra hour is dropped."""
    kept = df if dropped_hour is None else df.where(F.col(hour) != dropped_hour)
    return kept.withColumn(out, _date_plus_hours(F.col(date), F.col(hour) + shift))


def _date_plus_hours(date: Column, hours: Column) -> Column:
    return date.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=hours.cast("int"))


def market_datetime_utc(
    df: DataFrame,
    order: str,
    zone: str = DEFAULT_ZONE,
    date: str = "fecha_opreal",
    hour: str = "hora_opreal",
    out: str = "datetime_utc",
    hour25: str = "repeated",
) -> DataFrame:
    """UTC instant of a market date and hour 1..25, aware of clock changes.

    A wall time that occurs twice takes its first instant for the first half of
    that date's rows in ``order`` and the second instant for the rest, so a
    lone row is the second one. Wall times skipped in spring move forward.
    Hour 25 is the second pass of the hour repeated on that date (23:00 at the end
    of day or 00:00 of the next); where none repeats, and with
    ``hour25="same_date"``, it is 01:00 of the same date.
    """
    from gridtide.operators.quantiles import rank_values

    if hour25 not in ("repeated", "same_date"):
        raise ValueError("hour25 is 'repeated' or 'same_date'")
    one_hour = F.expr("interval 1 hour")
    wall = _date_plus_hours(F.col(date), F.col(hour) - 1)
    timed = df.withColumn("_wall", wall).withColumn("_first", to_utc("_wall", zone))
    normal = F.col(hour) <= 24
    repeats = normal & (to_zone(F.col("_first") + one_hour, zone) == F.col("_wall"))
    timed = timed.withColumn("_repeats", F.coalesce(repeats, F.lit(False)))

    # One order value per date tells both halves apart; no date is gathered anywhere.
    cuts = rank_values(
        timed.where("_repeats"), [date], order, {"_cut": (0.5, F.floor(F.col("_n") / 2) - 1)},
    ).select(F.col(date).alias("_day"), "_cut", F.col("_n").alias("_rows"))
    timed = timed.join(cuts, timed[date] == cuts["_day"], "left")
    later = F.col("_repeats") & ((F.col("_rows") < 2) | (F.col(order) > F.col("_cut")))

    fallback = to_utc(_date_plus_hours(F.col(date), F.lit(1)), zone)
    extra = fallback
    if hour25 == "repeated":
        for hours in (24, 23):
            candidate = _date_plus_hours(F.col(date), F.lit(hours))
            first = to_utc(candidate, zone)
            extra = F.when(to_zone(first + one_hour, zone) == candidate, first + one_hour).otherwise(extra)
    instant = F.when(~normal, extra).when(later, F.col("_first") + one_hour).otherwise(F.col("_first"))
    return timed.withColumn(out, instant).drop("_wall", "_first", "_repeats", "_day", "_cut", "_rows")


def calendar_keys(df: DataFrame, column: str) -> DataFrame:
    """Weekday (Monday 0), hour and month name as grouping keys."""
    c = F.col(column)
    return df.withColumns(
        {"weekday": F.weekday(c), "hour": F.hour(c), "month_name": F.date_format(c, "MMMM")},
    )


def iso_date(c) -> Column:
    """Report form of a date."""
    return F.date_format(_col(c), "yyyy-MM-dd")
