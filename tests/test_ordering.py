import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.operators import ordering as O
from gridtide.operators.quantiles import exact_quantiles, rank_values


def days(spark, numbers, key="a"):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(key, base + dt.timedelta(days=float(n))) for n in numbers], "k string, t timestamp_ntz")


def test_islands(spark):
    got = O.islands(days(spark, [1, 2, 3, 7, 8, 20]), ["k"], "t").orderBy("island").collect()
    assert [r.island_size for r in got] == [3, 2, 1]


@pytest.mark.parametrize("gap, groups", [(1.5, 1), (2.0, 2)])
def test_island_gap(spark, gap, groups):
    assert O.islands(days(spark, [0, gap]), ["k"], "t").count() == groups


@pytest.mark.parametrize("rows_per_slice", [10**9, 60, 3])
def test_slices_equal_plain_order(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(O, "SLICE_ROWS", rows_per_slice)
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    # One key has most rows and one time stamp holds a third of them.
    hours = [250 if rng.random() < 0.35 else rng.randrange(500) for _ in range(400)]
    rows = [("a" if rng.random() < 0.9 else "b", base + dt.timedelta(hours=h), i, rng.randrange(9)) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, v int")
    cut, slices = O.time_slices(df, ["k"], "t", ["i"])
    assert bool(slices) == (rows_per_slice < 400)
    if rows_per_slice == 3:
        assert O.largest_group(cut, ["k", *slices]) < 40
    out = O.running_sum(cut, ["k"], ["t", "i"], {"total": F.col("v")}, slices).drop(*slices)
    out = O.position_in_order(out, ["k"], "t", ["i"])
    pdf = pd.DataFrame(rows, columns=["k", "t", "i", "v"]).sort_values(["k", "t", "i"])
    pdf["total"] = pdf.groupby("k").v.cumsum()
    pdf["pos"] = pdf.groupby("k").cumcount()
    both = pdf.merge(out.toPandas(), on="i", suffixes=("", "_s"))
    assert len(both) == 400 and (both.total == both.total_s).all() and (both.pos == both.pos_s).all()
    gaps = O.time_deltas(df, ["k"], "t").toPandas().sort_values(["k", "t"])
    want = pdf.drop_duplicates(["k", "t"]).groupby("k").t.diff().dropna().dt.total_seconds()
    assert gaps.delta_seconds.tolist() == want.tolist()


@pytest.mark.parametrize("rows_per_slice", [10**9, 4])
def test_islands_over_slices(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(O, "SLICE_ROWS", rows_per_slice)
    numbers = [1, 2, 3, 7, 8, 20, 21, 22, 23, 24, 25, 40]
    got = O.islands(days(spark, numbers), ["k"], "t").orderBy("island").collect()
    assert [r.island_size for r in got] == [3, 2, 6, 1]


def test_slices_without_keys(spark, monkeypatch):
    monkeypatch.setattr(O, "SLICE_ROWS", 5)
    got = O.position_in_order(days(spark, range(40)).drop("k"), [], "t").orderBy("t").collect()
    assert [r.pos for r in got] == list(range(40))


def test_folds(spark):
    roles = O.expanding_folds(days(spark, range(10)), ["k"], "t", 3).toPandas()
    train = roles[roles.role == "train"].groupby("fold").pos.max().tolist()
    test = roles[roles.role == "test"].groupby("fold").pos.agg(["min", "max"])
    assert train == [3, 5, 7]
    assert test["min"].tolist() == [4, 6, 8] and test["max"].tolist() == [5, 7, 9]
    with pytest.raises(ValueError):
        O.expanding_folds(days(spark, range(10)), ["k"], "t", 1)


def test_split(spark):
    parts = O.chronological_split(days(spark, range(11)), ["k"], "t", test_size=0.3).toPandas()
    assert (parts.part == "train").sum() == int(11 * 0.7)
    assert parts[parts.part == "train"].t.max() < parts[parts.part == "test"].t.min()


def test_best_and_first(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("b", 5, None)], "k string, i int, s double")
    assert O.best_row(df, "s").first().i == 3
    assert {r.k: r.i for r in O.best_row(df, "s", ["k"], largest=True).collect()} == {"a": 1}
    assert {r.k: r.i for r in O.keep_first(df, ["k"], ["i"]).collect()} == {"a": 1, "b": 5}


@pytest.mark.parametrize("direct, rows_per_slice", [(100_000, 10**9), (10, 10**9), (10, 3)])
def test_quantiles(spark, direct, rows_per_slice):
    rng = np.random.default_rng(1)
    frames = {
        "wide": rng.normal(0, 100, 3001), "ties": np.repeat([0.0, 0.0, 5.0], 700), "two": np.array([1.0, 2.0]),
        "one": np.array([4.0]), "skewed": np.exp(rng.normal(0, 4, 2500)),
    }
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in frames.items()]))
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "high": 1.0}
    rows = exact_quantiles(df, ["k"], "v", wanted, direct, rows_per_slice).collect()
    assert len(rows) == len(frames)
    for row in rows:
        for name, q in wanted.items():
            assert row[name] == pytest.approx(np.quantile(frames[row.k], q), rel=1e-12), (row.k, name)


@pytest.fixture
def no_small_joins(spark):
    """Spark broadcasts only what it is told to, as when few keys leave most partitions of a shuffle empty."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_large_key_are_not_gathered_for_its_quantiles(spark, no_small_joins):
    rows = [("a", float(i % 97)) for i in range(400)] + [("b", float(i)) for i in range(7)] + [(None, 1.0)] * 30
    found = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q": 0.5}, 20)
    assert "SortMergeJoin" not in plan(found)
    assert {r.k: r.q for r in found.collect()} == {"a": float(np.median([i % 97 for i in range(400)])), "b": 3.0}


def test_rows_of_a_large_key_are_not_gathered_for_its_slices(spark, no_small_joins):
    df = spark.range(300).selectExpr("if(id < 290, 'a', 'b') as k", "cast(id as double) as v")
    cut, crowded = O.add_slices(df, ["k"], F.col("v"), "s", 290, slice_rows=50)
    assert "SortMergeJoin" not in plan(cut) and not crowded
    rows = cut.orderBy("v").collect()
    numbers = [r.s for r in rows if r.k == "a"]
    assert numbers == sorted(numbers) and len(set(numbers)) > 5 and {r.s for r in rows if r.k == "b"} == {0}


def test_rank_without_keys(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    row = rank_values(df, [], "v", {"x": (0.5, F.floor(F.col("_n") / 2))}, 10).first()
    assert row.x == 500.0 and row._n == 1000


def test_expanding_distinct_small(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=50 * i), k, n) for i, (k, n) in enumerate([("a", "x"), ("b", "x"), ("a", "x"), ("a", "y")])]
    df = spark.createDataFrame(rows, "i int, t timestamp_ntz, kind string, name string")
    got = O.expanding_distinct(df, ["a", "b"], "kind", "name", "t", "i").orderBy("i").collect()
    assert [r.unique_count_a for r in got] == [1, 1, 1, 2]
    assert [r.unique_count_b for r in got] == [0, 1, 1, 1]


def test_random_rows_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id * 2) as v")
    samples = [{r.id for r in O.random_rows(df.repartition(parts), 50, seed).collect()} for parts, seed in ((1, 5), (7, 5), (7, 6))]
    assert samples[0] == samples[1] != samples[2] and {len(x) for x in samples} == {50}
