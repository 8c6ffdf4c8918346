import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtide.operators.joins import absent_from
from gridtide.plans import forecast
from gridtide.plans.fixtures import grid, rings
from gridtide.sources import tabular as T, weather as W


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_zones(spark, tmp_path):
    path = write(tmp_path / "a.csv", "datetime,v\n2024-01-01 12:00:00,1\n2024-01-01T12:00:00+02:00,2\n")
    got = T.read_series_csv(spark, path, schema="datetime string, v int").orderBy("v").collect()
    assert [r.datetime for r in got] == [dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 7)]
    local = T.read_series_csv(spark, path, input_zone="America/Santiago", output_zone=None, schema="datetime string, v int")
    assert local.where("v = 1").first().datetime == dt.datetime(2024, 1, 1, 15)
    plain = write(tmp_path / "b.csv", "datetime,v\n2024-01-01 12:00:00,1\n")
    assert T.read_series_csv(spark, plain).first().datetime == dt.datetime(2024, 1, 1, 9)
    with pytest.raises(ValueError):
        T.read_series_csv(spark, plain, "when")


def test_concat(spark, tmp_path):
    a = write(tmp_path / "a.csv", "x,y\n1,2\n")
    b = write(tmp_path / "b.csv", "y,z\n3,4\n")
    T.concat_csv(spark, [a, b], str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted((r.x, r.y, r.z) for r in back.collect() if r.x) == [("1", "2", None)]
    assert back.count() == 2


def test_concat_scans_by_header(spark, tmp_path):
    for i in range(12):
        write(tmp_path / "in" / f"{i}.csv", ("x,y\n" if i % 2 else "y,z\n") + f"{i},2.5\n")
    write(tmp_path / "in" / "empty.csv", "")
    paths = [str(tmp_path / "in" / f"{i}.csv") for i in range(12)] + [str(tmp_path / "in" / "empty.csv")]
    merged = T.concat_csv(spark, paths)
    assert merged._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert merged.agg(F.sum("x"), F.sum("y"), F.sum("z")).first()[:] == (36, 30 + 6 * 2.5, 6 * 2.5)
    typed = T.concat_csv(spark, paths[:12], schemas=["x int, y double" if i % 2 else "y int, z double" for i in range(12)])
    assert typed._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2 and typed.count() == 12
    with pytest.raises(ValueError):
        T.concat_csv(spark, paths[12:])


def test_conversion_reports_files(spark, tmp_path):
    for name, n in (("m1.tsv", 2), ("m2.tsv", 3)):
        write(tmp_path / "in" / name, "a\tb\n" + "1\t2\n" * n)
    report = T.convert_delimited(spark, str(tmp_path / "in" / "*.tsv"), str(tmp_path / "out"))
    assert {r.file: r.rows for r in report.collect()} == {"m1.tsv": 2, "m2.tsv": 3}
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_ingest(spark, tmp_path):
    write(tmp_path / "in" / "good.csv", "datetime,v\n2024-01-01 00:00:00,1\n")
    write(tmp_path / "in" / "bad.csv", "datetime,v\nsoon,1\n2024-01-01 00:00:00,many\n")
    write(tmp_path / "in" / "worse.csv", "datetime,v\nsoon,1\n")
    write(tmp_path / "in" / "none.csv", "")
    rows, report = T.ingest_csv(spark, str(tmp_path / "in"), "datetime timestamp_ntz, v int")
    assert rows.count() == 2
    assert {r.file: r.outcome for r in report.collect()} == {
        "good.csv": "read", "bad.csv": "partly read", "worse.csv": "unreadable times",
    }
    listing = W.landed_files(spark, str(tmp_path / "in" / "*.csv"))
    assert [r.file for r in T.empty_files(report, listing).collect()] == ["none.csv"]
    with pytest.raises(ValueError):
        T.ingest_csv(spark, str(tmp_path / "in"), "v int")


def test_map_files(spark):
    rows = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), "id")
    out = T.map_files(rows, lambda pdf: pdf.assign(id=pdf.id * 2), "file string, id bigint", parts=4)
    assert out.agg(F.sum("id")).first()[0] == 9900


def test_calendar(spark):
    steps = W.forecast_steps(spark, 384)
    assert steps.count() == 209
    last = steps.orderBy(F.desc("step_hours")).first()
    assert (last.step_hours, last.label) == (384, "384")
    assert W.forecast_steps(spark, 5).orderBy("step_hours").first().label == "000"
    assert W.forecast_steps(spark, 122).count() == 121
    landed = steps.where("step_hours <> 123")
    assert [r.label for r in absent_from(steps, landed, "step_hours").collect()] == ["123"]


def test_acceptance(spark, tmp_path):
    write(tmp_path / "small", "x" * 10_000)
    write(tmp_path / "large", "x" * 10_001)
    got = {r.path.split("/")[-1]: r.accepted for r in W.landed_files(spark, str(tmp_path)).collect()}
    assert got == {"small": False, "large": True}


def test_combined_steps_prune_by_variable(spark, sf_dir, tmp_path):
    whole = grid(spark, sf_dir)
    paths = []
    for i in range(2):
        paths.append(str(tmp_path / f"part{i}"))
        whole.where(F.col("step_hours") % 2 == i).write.parquet(paths[-1])
    stored = W.combine_steps(spark, paths, str(tmp_path / "grid"))
    assert stored.count() == whole.count()
    plan = W.read_grid(spark, str(tmp_path / "grid"), ["u100"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "variable" in plan.split("PartitionFilters: [")[1][:80]


def test_forecast_job(spark, sf_dir, tmp_path):
    tables = forecast.run_features(grid(spark, sf_dir), rings(spark), ["South", "North"], str(tmp_path), {"wind": 7})
    wind = spark.read.parquet(str(tmp_path / "wind"))
    assert wind.columns == tables["wind"].columns and wind.first().total_plants == 7
    assert "total_plants" not in tables["solar"].columns
    with pytest.raises(ValueError):
        forecast.technology_features(tables["wind"], "tidal")
    with pytest.raises(FileNotFoundError):
        forecast.predict_from_bundle(wind, str(tmp_path / "nothing"))


def test_components(spark, tmp_path):
    parts = spark.range(3).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"), F.lit(1.0).alias("trend"), F.lit(2.0).alias("resid"))
    T.write_components(parts, str(tmp_path / "each"))
    assert {p.name for p in (tmp_path / "each").iterdir() if p.is_dir()} == {"component=trend", "component=resid"}
    T.write_components(parts, str(tmp_path / "one"), separate=False, form="parquet")
    assert spark.read.parquet(str(tmp_path / "one")).count() == 3
    info = T.table_info(parts).orderBy("place").collect()
    assert [(r.column, r.type, r.non_null) for r in info][:2] == [("series_id", "string", 3), ("pos", "bigint", 3)]


def test_region_table_and_means(spark, sf_dir, tmp_path):
    rings(spark).withColumnRenamed("region", "Comuna").write.parquet(str(tmp_path / "rings"))
    boundaries = W.read_regions(spark, str(tmp_path / "rings"), "Comuna")
    wide = forecast.regional_table(grid(spark, sf_dir), boundaries, ["South", "North"], None)
    T.write_means(wide, str(tmp_path / "means"))
    assert {p.name for p in (tmp_path / "means").iterdir() if p.is_dir()} == {f"variable={v}" for v in ("u100", "v100", "sdswrf")}
    back = spark.read.option("header", True).csv(str(tmp_path / "means"))
    assert back.count() == wide.count()
