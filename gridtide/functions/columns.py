"""Column parsing, arithmetic and text labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df: DataFrame, skip=()) -> list[str]:
    """Names of numeric columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def parse_hours(df: DataFrame, hour: str) -> DataFrame:
    """Hour text to int; unreadable text becomes null."""
    return df.withColumn(hour, F.expr(f"try_cast(`{hour}` as int)"))


def unreadable_hours(df: DataFrame, hour: str, shown: int = 10) -> DataFrame:
    """A few of the values ``parse_hours`` cannot read."""
    bad = F.col(hour).isNotNull() & F.expr(f"try_cast(`{hour}` as int)").isNull()
    return df.where(bad).select(hour).limit(shown)


def typed_dates(df: DataFrame, date: str, hour: str | None = None) -> DataFrame:
    """Date text to timestamp, and the hour moved to zero-based if named."""
    typed = df.withColumn(date, F.expr(f"try_cast(`{date}` as timestamp_ntz)"))
    return typed if hour is None else typed.withColumn(hour, F.col(hour) - 1)


def comma_decimal(c) -> Column:
    """``1,5`` to 1.5."""
    return F.replace(_col(c), F.lit(","), F.lit(".")).cast("double")


def date_by_pattern(c, pattern: str = "dd-MM-yy") -> Column:
    """Date from patterned text."""
    return F.to_date(_col(c), pattern)


def joules_to_watts(column: str, hours: float = 1.0, out: str | None = None) -> Column:
    """Accumulated J/m2 to mean W/m2, units kept as column metadata."""
    meta = {
        "units": "W m**-2",
        "long_name": "Surface solar radiation downwards",
        "history": f"accumulated energy divided by {hours} h",
    }
    return (F.col(column) / F.lit(hours * 3600.0)).alias(out or column, metadata=meta)


def row_total(columns) -> Column:
    """Sum over columns of a row, nulls counted as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0.0)) for c in columns])


def strict_total(columns) -> Column:
    """Sum over columns of a row; null if any is."""
    return reduce(lambda a, b: a + b, [_col(c) for c in columns])


def active_flag(c) -> Column:
    """1 where positive, else null."""
    return F.when(_col(c) > 0, F.lit(1))


def with_plants(df: DataFrame, n: int | None, out: str = "total_plants") -> DataFrame:
    """Constant plant count; none or zero adds nothing."""
    return df.withColumn(out, F.lit(n)) if n else df


def shape_columns(df: DataFrame, rename=None, drop=(), keep=None) -> DataFrame:
    """Rename, drop, then project."""
    shaped = df.withColumnsRenamed(dict(rename or {})).drop(*drop)
    return shaped if keep is None else shaped.select(*keep)


def lonlat_columns(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """Bring custom coordinate names to ``longitude`` and ``latitude``."""
    return df.withColumnsRenamed({longitude: "longitude", latitude: "latitude"})


def among(df: DataFrame, column: str, wanted) -> DataFrame:
    """Rows whose value is in a list or in the first column of a table."""
    if isinstance(wanted, DataFrame):
        keys = wanted.select(wanted[wanted.columns[0]].alias(column)).distinct()
        return df.join(keys, column, "left_semi")
    return df.where(F.col(column).isin(list(wanted)))


def fixed_text(value, digits: int) -> Column:
    """Number with fixed decimals; exact halves go to the even digit, as in C and Python."""
    return F.format_string(f"%.{digits}f", F.bround(_col(value), digits))


def period_label(hours) -> Column:
    """A period in hours, worded in the largest fitting unit."""
    h = _col(hours)
    limits = [(24.0, 1.0, "hours"), (168.0, 24.0, "days"), (720.0, 168.0, "weeks"), (8760.0, 720.0, "months")]
    text = F.concat(fixed_text(h / 8760.0, 2), F.lit(" years"))
    for below, unit, word in reversed(limits):
        text = F.when(h < below, F.concat(fixed_text(h / unit, 2), F.lit(f" {word}"))).otherwise(text)
    return text


def confidence_word(confidence) -> Column:
    """Very High, High, Medium or Low."""
    c = _col(confidence)
    return (
        F.when(c >= 0.9, "Very High").when(c >= 0.7, "High").when(c >= 0.5, "Medium").otherwise("Low")
    )


def interval_text(seconds) -> Column:
    """``1 days 02:00:00`` form of a duration in seconds."""
    s = F.floor(_col(seconds)).cast("bigint")
    clock = F.format_string(
        "%d days %02d:%02d:%02d",
        F.floor(s / 86400).cast("bigint"), F.floor(s % 86400 / 3600).cast("bigint"),
        F.floor(s % 3600 / 60).cast("bigint"), (s % 60).cast("bigint"),
    )
    micros = F.round((_col(seconds) - s) * 1000000).cast("bigint")
    return F.when(micros > 0, F.concat(clock, F.format_string(".%06d", micros))).otherwise(clock)
