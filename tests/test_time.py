import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtide.functions import timeparts as T

UTC = "timestamp_ntz"


def at(*parts):
    return dt.datetime(*parts)


def test_resolution_words(spark):
    row = spark.range(1).select(F.lit(at(2024, 5, 15, 13, 47, 9)).cast(UTC).alias("t"))
    got = row.select(*[T.truncate("t", u).alias(u) for u in ("minute", "h", "D", "W", "M", "Q", "Y", "exact")]).first()
    assert got.minute == at(2024, 5, 15, 13, 47)
    assert got.h == at(2024, 5, 15, 13)
    assert got.W == at(2024, 5, 13)
    assert got.M == at(2024, 5, 1)
    assert got.Q == at(2024, 4, 1)
    assert got.Y == at(2024, 1, 1)
    assert got.exact == at(2024, 5, 15, 13, 47, 9)
    with pytest.raises(ValueError):
        T.truncate("t", "m")


def test_range_bounds(spark):
    rows = spark.createDataFrame([(at(2024, 1, 1),), (at(2024, 1, 2),), (at(2024, 1, 2, 0, 1),)], "t timestamp_ntz")
    assert T.time_between(rows, "t", "2024-01-01", "2024-01-02").count() == 2
    assert T.time_between(rows, "t", "2023-12-31 21:00:00", "2023-12-31 21:00:00", "America/Santiago").count() == 1
    with pytest.raises(KeyError):
        T.time_between(rows, "x", "2024-01-01", "2024-01-02")
    with pytest.raises(ValueError):
        T.time_between(spark.createDataFrame([("a",)], "t string"), "t", "2024-01-01", "2024-01-02")


def market(spark, rows):
    return spark.createDataFrame(rows, "id int, fecha_opreal date, hora_opreal int")


def utc_of(spark, rows, **options):
    out = T.market_datetime_utc(market(spark, rows), "id", **options)
    return {r.id: r.datetime_utc for r in out.collect()}


def test_hour_counted_twice(spark):
    day = dt.date(2024, 4, 6)  # 23:00 occurs twice at Santiago
    pair = utc_of(spark, [(1, day, 24), (2, day, 24), (3, day, 23)])
    assert pair[1] == at(2024, 4, 7, 2)
    assert pair[2] == at(2024, 4, 7, 3)
    assert pair[3] == at(2024, 4, 7, 1)
    # Odd counts: floor(n / 2) rows are summer time, a lone row is standard time.
    assert utc_of(spark, [(1, day, 24)])[1] == at(2024, 4, 7, 3)
    three = utc_of(spark, [(i, day, 24) for i in range(3)])
    assert [three[i] for i in range(3)] == [at(2024, 4, 7, 2), at(2024, 4, 7, 3), at(2024, 4, 7, 3)]


def test_skipped_hour_moves_forward(spark):
    assert utc_of(spark, [(1, dt.date(2024, 9, 8), 1)])[1] == at(2024, 9, 8, 4)


def test_hour_25(spark):
    day = dt.date(2024, 4, 6)
    assert utc_of(spark, [(1, day, 25)])[1] == at(2024, 4, 7, 3)
    assert utc_of(spark, [(1, day, 25)], hour25="same_date")[1] == at(2024, 4, 6, 4)
    assert utc_of(spark, [(1, dt.date(2024, 6, 1), 25)])[1] == at(2024, 6, 1, 5)
    with pytest.raises(ValueError):
        utc_of(spark, [(1, day, 25)], hour25="other")


def test_market_datetime_drops_extra_hour(spark):
    day = dt.date(2024, 1, 1)
    rows = T.market_datetime(market(spark, [(1, day, 1), (2, day, 24), (3, day, 25)]))
    assert {r.id: r.datetime for r in rows.collect()} == {1: at(2024, 1, 1), 2: at(2024, 1, 1, 23)}


def test_cycles(spark):
    row = spark.range(1).select(F.lit(at(2024, 1, 1, 6)).cast(UTC).alias("t"))
    got = T.add_cycles(row, "t", ["hour", "dayofweek", "decade"]).first()
    assert got.hour_sin == pytest.approx(1.0)
    assert got.hour_cos == pytest.approx(0.0, abs=1e-12)
    assert got.dayofweek_sin == pytest.approx(0.0)  # Monday
    assert got.year == 2024
    assert not [c for c in got.asDict() if c.startswith("decade")]
