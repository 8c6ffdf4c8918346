import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.functions import columns as C
from gridtide.operators import granularity as G, joins as J, patterns as P, quality as Q, rollups as R, spatial as S, statistics as X
from gridtide.plans.fixtures import rings

DAY = dt.datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_duplicate_rules(spark):
    a = frame(spark, [(DAY, 1, 2)], "t timestamp_ntz, x int, y int")
    b = frame(spark, [(DAY, 3)], "t timestamp_ntz, x int")
    tables = {"a": a, "b": b}
    assert J.shared_columns(tables) == {"t", "x"}
    assert set(J.join_by_time(tables, "t").columns) == {"t", "x_a", "y", "x_b"}
    assert set(J.join_by_time(tables, "t", rule="prefix").columns) == {"t", "a_x", "y", "b_x"}
    last = J.join_by_time(tables, "t", rule="overwrite")
    assert set(last.columns) == {"t", "x", "y"} and last.first().x == 3
    with pytest.raises(ValueError):
        J.join_by_time(tables, "t", how="cross")


def test_missing_times_match_on_request(spark):
    a = frame(spark, [(None, 1), (DAY, 2)], "t timestamp_ntz, x int")
    b = frame(spark, [(None, 3)], "t timestamp_ntz, y int")
    assert J.join_by_time({"a": a, "b": b}, "t", "inner").count() == 0
    both = J.join_by_time({"a": a, "b": b}, "t", "inner", match_nulls=True).collect()
    assert [(r.t, r.x, r.y) for r in both] == [(None, 1, 3)]


def test_truncated_duplicates_multiply(spark):
    a = frame(spark, [(DAY, 1), (DAY + dt.timedelta(minutes=5), 2)], "t timestamp_ntz, x int")
    b = frame(spark, [(DAY, 3), (DAY + dt.timedelta(minutes=9), 4)], "t timestamp_ntz, y int")
    assert J.join_by_time({"a": a, "b": b}, "t", "inner", "hour").count() == 4


def test_roll_up_nulls(spark):
    df = frame(spark, [(DAY, None, "a"), (DAY, 2.0, None), (None, 1.0, "a")], "t timestamp_ntz, v double, k string")
    row = R.roll_up(df, "t", "day", ["sum", "count", "std", "median"], ["v"]).collect()
    assert len(row) == 1 and row[0].v_sum == 2.0 and row[0].v_count == 1 and row[0].v_std is None and row[0].v_median == 2.0
    assert R.roll_up(df, "t", "day", "sum", ["v"], keys=["k"]).collect()[0].v_sum == 0.0
    with pytest.raises(ValueError):
        R.roll_up(df, "t", "day", "mode", ["v"])


def joins_by_shuffle(spark, build):
    """Shuffle joins of a plan in which Spark broadcasts only what it is told to."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = build()
        return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin"), df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_medians_of_a_large_period_do_not_gather_its_rows(spark):
    hours = spark.range(1_200_000).selectExpr("if(id < 1100000, timestamp_ntz'2024-03-01', timestamp_ntz'2023-03-01') as t", "cast(id % 1001 as double) as v")
    shuffled, rows = joins_by_shuffle(spark, lambda: R.roll_up(hours, "t", "year", ["median", "count"], ["v"]))
    assert shuffled == 1  # periods with their medians, one row each
    want = {2024: np.median(np.arange(1_100_000) % 1001), 2023: np.median(np.arange(1_100_000, 1_200_000) % 1001)}
    assert {r.datetime.year: r.v_median for r in rows} == want


def test_boxes_do_not_gather_the_rows_of_a_group(spark):
    df = frame(spark, [("a", float(i)) for i in range(9)] + [("a", 99.0), ("b", 1.0), ("b", None), (None, 1.0)], "k string, v double")
    shuffled, rows = joins_by_shuffle(spark, lambda: X.box_statistics(df, ["k"], "v"))
    assert shuffled == 0 and {(r.k, r.median, r.whisker_low, r.whisker_high, r.outliers) for r in rows} == {("a", 4.5, 0.0, 8.0, 1), ("b", 1.0, 1.0, 1.0, 0)}
    shuffled, rows = joins_by_shuffle(spark, lambda: X.box_outliers(df, ["k"], "v"))
    assert shuffled == 0 and [(r.k, r.v) for r in rows] == [("a", 99.0)]


def test_labels(spark):
    df = frame(spark, [(5.0,), (30.0,), (200.0,), (1000.0,), (9000.0,), (27.0,)], "h double")
    got = [r[0] for r in df.select(C.period_label("h")).collect()]
    assert got == ["5.00 hours", "1.25 days", "1.19 weeks", "1.39 months", "1.03 years", "1.12 days"]
    text = frame(spark, [(93600.0,), (0.5,)], "s double").select(C.interval_text("s")).collect()
    assert [r[0] for r in text] == ["1 days 02:00:00", "0 days 00:00:00.500000"]


def test_hours(spark):
    df = frame(spark, [("1", ), ("x",), (None,)], "h string")
    assert [r.h for r in C.unreadable_hours(df, "h").collect()] == ["x"]
    assert sorted(r.h for r in C.parse_hours(df, "h").collect() if r.h is not None) == [1]


def test_quality_hours(spark):
    rows = [(DAY, h) for h in range(23)] + [(DAY, 24), (DAY, 5), (DAY, None)]
    df = frame(spark, rows, "d timestamp_ntz, h int")
    assert Q.missing_hours(df, "d", "h").first().missing_hours == [23]
    assert sorted(str(r.h) for r in Q.invalid_hours(df, "h").collect()) == ["24", "None"]
    assert Q.duplicate_hour_maps(df, "d", "h").first().duplicates == {5: 2}
    summary = Q.hour_completeness(df, "d", "h").first()
    assert (summary.invalid_rows, summary.days_with_missing_hours, summary.days_with_duplicate_hours) == (2, 1, 1)


def test_complete_series(spark):
    df = frame(spark, [(DAY + dt.timedelta(days=i),) for i in (0, 1, 3)], "d timestamp_ntz")
    got = Q.series_check(df, "d").first()
    assert (got.records, got.missing, got.complete) == (3, 1, False)
    assert Q.missing_report(df, "d").first().line == "Missing date: 2024-01-03"


def test_granularity(spark):
    hourly = frame(spark, [(DAY + dt.timedelta(hours=i),) for i in range(10)], "t timestamp_ntz")
    got = G.describe_step(G.detect_step(hourly, [], "t")).first()
    assert got.granularity == "Hourly" and got.confidence == 1.0 and got.confidence_level == "Very High"
    assert got.info.startswith("**Hourly** (Confidence: Very High - 100.0%)")
    ragged = frame(spark, [(DAY + dt.timedelta(seconds=i * i * 977),) for i in range(12)], "t timestamp_ntz")
    odd = G.detect_step(ragged, [], "t").first()
    assert odd.granularity.startswith("Irregular (") and odd.confidence <= 0.5
    assert G.detect_step(hourly.limit(1), [], "t").count() == 0


def test_validation_zero_sums(spark):
    df = frame(spark, [(0.0, 0.0, "x"), (1.0, 3.0, "y"), (None, 2.0, "z")], "v_df1 double, v_df2 double, n_df1 string")
    row = X.compare_sources(df).first()
    assert row.samples == 2 and row.mean_abs_percent_diff == pytest.approx(100.0)
    opposite = frame(spark, [(1.0, -1.0)], "v_df1 double, v_df2 double")
    assert math.isinf(X.compare_sources(opposite).first().mean_abs_percent_diff)
    with pytest.raises(ValueError):
        X.compare_sources(df.select("n_df1"))


def test_scores_of_constant_truth(spark):
    flat = frame(spark, [(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert X.regression_scores(flat, "y", "p").first().r2 == 1.0
    off = frame(spark, [(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert X.regression_scores(off, "y", "p").first().r2 == 0.0
    assert X.regression_scores(off.limit(1), "y", "p").first().r2 is None


def test_matrix_is_symmetric(spark):
    df = frame(spark, [(1.0, 2.0, None), (2.0, 1.0, 3.0), (4.0, 0.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.value for r in X.covariance_matrix(df).collect()}
    assert len(got) == 9 and got["a", "c"] == got["c", "a"] == pytest.approx(2.0)


def test_cells_and_regions(spark):
    cells = frame(spark, [(-40.0, -70.0), (-20.0, -71.0), (-20.0, -66.0), (0.0, -70.0)], "latitude double, longitude double")
    got = {(r.latitude, r.longitude): r.region for r in S.mask_cells(cells, rings(spark)).collect()}
    assert got == {(-40.0, -70.0): "South", (-20.0, -71.0): "North"}


def test_overlap_takes_lowest_id(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(i, n, 0, s, x, y) for i, n in ((7, "late"), (2, "early")) for s, (x, y) in enumerate(square)]
    shapes = frame(spark, rows, "region_id int, region string, ring_id int, seq int, lon double, lat double")
    cell = frame(spark, [(1.0, 1.0)], "latitude double, longitude double")
    assert S.mask_cells(cell, shapes).first().region == "early"


def test_valid_time_cases(spark):
    both = frame(spark, [(DAY, 30)], "time timestamp_ntz, step_hours int")
    assert S.valid_time(both).first().datetime == DAY + dt.timedelta(hours=30)
    for name in ("valid_time", "time", "datetime"):
        one = frame(spark, [(DAY,)], f"{name} timestamp_ntz")
        assert S.valid_time(one).first().datetime == DAY
    with pytest.raises(ValueError):
        S.valid_time(spark.range(1))


def test_pattern_windows(spark):
    df = spark.range(6).select(F.col("id").alias("phase"), F.col("id").cast("double").alias("pattern"))
    with pytest.raises(ValueError):
        P.smooth_moving_average(df, [], 6, 7)
    with pytest.raises(ValueError):
        P.smooth_savgol(df, [], 6, 3, 2)
    line = P.smooth_savgol(df, [], 6, 5, 2).orderBy("phase").collect()
    assert [r.pattern for r in line] == pytest.approx([0, 1, 2, 3, 4, 5])
    ends = P.smooth_moving_average(df, [], 6, 2).orderBy("phase").collect()
    assert ends[0].pattern == pytest.approx(0.5)


def test_time_columns(spark):
    day = dt.timedelta(days=1)
    rows = frame(spark, [(DAY, 5, DAY + day)], "time timestamp_ntz, step_hours int, issued timestamp_ntz")
    assert S.valid_time(rows, time_column="issued").first().datetime == DAY + day
    assert S.valid_time(rows, time_column="absent").first().datetime == DAY + dt.timedelta(hours=5)
    bare = frame(spark, [(1,)], "x int")
    with pytest.raises(ValueError):
        S.valid_time(bare, time_column="issued")
    with pytest.warns(UserWarning):
        assert S.valid_time(bare, warn_only=True).columns == ["x"]


def test_custom_coordinates_and_preview(spark):
    cells = frame(spark, [(-40.0, -70.0)], "lat double, lon double")
    assert S.mask_cells(C.lonlat_columns(cells, "lon", "lat"), rings(spark)).first().region == "South"
    preview = {r.region: (r.n_rings, r.n_vertices) for r in S.region_preview(rings(spark)).collect()}
    assert preview == {"South": (1, 4), "North": (1, 3)}


def test_missing_keys_are_no_group(spark):
    from gridtide.operators.ordering import position_in_order

    df = frame(spark, [("a", DAY), (None, DAY), ("a", DAY + dt.timedelta(hours=1))], "k string, t timestamp_ntz")
    assert sorted(r.pos for r in position_in_order(df, ["k"], "t").collect()) == [0, 1]


def test_missing_times_by_hand(spark, monkeypatch):
    from gridtide.operators import ordering

    days = [DAY + dt.timedelta(days=i, hours=5) for i in (0, 1, 4, 4, 9)]
    df = frame(spark, [(k, d) for k in "ab" for d in days], "k string, t timestamp_ntz")
    want = sorted((k, DAY + dt.timedelta(days=i)) for k in "ab" for i in (2, 3, 5, 6, 7, 8))
    for size in (10**9, 2):
        monkeypatch.setattr(ordering, "SLICE_ROWS", size)
        assert sorted((r.k, r.t) for r in Q.missing_times(df, "t", "day", ["k"]).collect()) == want
    # Hours count from the first time; 02:10 is off the grid of 00:30, 01:30, ...
    odd = frame(spark, [(DAY + dt.timedelta(minutes=m),) for m in (30, 130, 270)], "t timestamp_ntz")
    assert sorted(r.t for r in Q.missing_times(odd, "t", "hour").collect()) == [DAY + dt.timedelta(minutes=m) for m in (90, 150, 210, 270) if m != 270]
    assert Q.date_completeness(odd, "t", "hour").first().missing == 3
    months = frame(spark, [(dt.datetime(2024, m, 1),) for m in (1, 2, 5)], "t timestamp_ntz")
    assert Q.missing_times(months, "t", "month").count() == 2


@pytest.mark.parametrize("step, seconds", [("minute", 60), ("hour", 3600), ("week", 604800)])
def test_missing_times_in_pieces(spark, monkeypatch, step, seconds):
    from gridtide.operators import ordering, series

    rng = np.random.default_rng(seconds)
    width, rows, want = dt.timedelta(seconds=seconds), [], []
    for k in "abc":
        ticks = np.unique(rng.choice(200, 40)).tolist()
        times = {DAY + width * t for t in ticks} | {DAY + width * t + dt.timedelta(seconds=17) for t in rng.choice(260, 5).tolist()}
        rows += [(k, t) for t in times] + [(k, None)]
        span = (max(times) - min(times)) // width
        want += [(k, t) for t in (min(times) + width * i for i in range(span + 1)) if t not in times]
    rows.append((None, DAY))
    df = frame(spark, rows, "k string, t timestamp_ntz")
    for size, piece in ((10**9, 10_000), (9, 7)):
        monkeypatch.setattr(ordering, "SLICE_ROWS", size)
        monkeypatch.setattr(series, "PIECE", piece)
        assert sorted((r.k, r.t) for r in Q.missing_times(df, "t", step, ["k"]).collect()) == sorted(want)
    assert Q.missing_times(df.limit(0), "t", step).count() == 0


def test_one_stray_time(spark):
    stray = frame(spark, [(DAY, 1.0), (DAY + dt.timedelta(days=50 * 365), 2.0)], "t timestamp_ntz, v double")
    steps = 50 * 365 * 24 * 60
    assert Q.missing_times(stray, "t", "minute").count() == steps - 1
    from gridtide.operators.series import regular_series

    line = regular_series(stray, [], "t", "v", "minute").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.sum("value").alias("v")).first()
    assert (line.n, line["last"], line.v) == (steps + 1, steps, 3.0)


def test_density_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=300), "b": np.round(rng.exponential(size=200), 1), "flat": np.ones(5), "one": np.ones(1)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(None, 1.0), ("a", None)]
    df = frame(spark, rows, "k string, v double").repartition(5)
    for most, held, block in ((10_000, 1000, 4096), (0, 0, 13)):
        monkeypatch.setattr(X, "MOST_SHAPES", most)
        monkeypatch.setattr(X, "VECTORS_HELD", held)
        monkeypatch.setattr(X, "VALUES_AT_ONCE", block)
        got = X.density_curves(df, "k", "v", points=50).toPandas()
        assert set(got.k) == {"a", "b"}
        for k in "ab":
            v = values[k]
            h = v.std(ddof=1) * len(v) ** -0.2 * 0.5
            x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 50)
            want = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
            mine = got[got.k == k].sort_values("point")
            np.testing.assert_allclose(mine.x, x, atol=1e-9)
            np.testing.assert_allclose(mine.density, want, rtol=1e-9)
    plan = X.density_curves(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert X.density_curves(df.limit(0), "k", "v").count() == 0


def test_unlisted_values_are_errors(spark):
    rows = frame(spark, [(DAY, 1, "p", "solar", 2.0), (DAY, 1, "q", "nuclear", 1.0), (DAY, 1, "s", None, 1.0)], "d timestamp_ntz, h int, plant string, kind string, mwh double")
    names = {"date": "d", "hour": "h", "plant": "plant", "kind": "kind", "energy": "mwh"}
    plants = R.plant_hours(rows, **names)
    means = frame(spark, [("t2m", DAY, "East", 1.0)], "variable string, datetime timestamp_ntz, region string, mean_value double")
    short, whole = ["solar"], ["solar", "nuclear"]

    def tables(kinds, regions):
        return [
            R.plant_hours(rows, kinds=kinds, **names),
            R.technology_table(plants, kinds, **names),
            R.active_total_pivot(plants, kinds, ["d", "h"], "kind", "plant", "mwh"),
            R.pivot_sum(rows, ["d", "h"], "kind", kinds, "mwh"),
            S.regions_wide(means, regions),
        ]

    assert [len(t.collect()) for t in tables(whole, ["East"])] == [3, 1, 1, 1, 1]
    for t in tables(short, ["West"]):
        with pytest.raises(Exception, match="is not listed: (nuclear|East)"):
            t.collect()
