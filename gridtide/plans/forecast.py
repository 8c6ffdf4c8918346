"""Weather forecast to energy prediction as one logical plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridtide.functions.columns import with_plants
from gridtide.functions.timeparts import DEFAULT_ZONE, add_cycles, to_zone
from gridtide.operators.joins import join_with_suffixes
from gridtide.operators.models import load_bundle, score_table
from gridtide.operators.spatial import regional_means, regions_wide

CYCLES = ("hour", "month", "day", "dayofweek")
WIND = ("u100", "v100")
SOLAR = "sdswrf"


def _variable(wide: DataFrame, name: str) -> DataFrame:
    return wide.where(F.col("variable") == name).drop("variable")


def wind_features(wide: DataFrame, plants: int | None = None, cycles=CYCLES) -> DataFrame:
    """Regional u and v wind side by side, plant count and calendar cycles."""
    joined = join_with_suffixes(
        _variable(wide, WIND[0]), _variable(wide, WIND[1]), "datetime", "_u100_means", "_v100_means",
    )
    return add_cycles(with_plants(joined, plants), "datetime", cycles)


def solar_features(wide: DataFrame, plants: int | None = None, cycles=CYCLES) -> DataFrame:
    """Regional radiation, plant count and calendar cycles."""
    return add_cycles(with_plants(_variable(wide, SOLAR), plants), "datetime", cycles)


def technology_features(wide: DataFrame, technology: str, plants: int | None = None, cycles=CYCLES) -> DataFrame:
    """Feature table by technology name."""
    makers = {"wind": wind_features, "solar": solar_features}
    maker = makers.get(technology.lower())
    if maker is None:
        raise ValueError(f"unsupported technology {technology!r}")
    return maker(wide, plants, cycles)


def regional_table(grid: DataFrame, rings: DataFrame, regions: list[str], zone: str | None = DEFAULT_ZONE) -> DataFrame:
    """Wide regional means in local time for all variables in one job."""
    wide = regions_wide(regional_means(grid, rings), regions)
    return wide if zone is None else wide.withColumn("datetime", to_zone("datetime", zone))


def run_features(
    grid: DataFrame, rings: DataFrame, regions: list[str], output: str | None = None, plants: dict | None = None,
    zone: str | None = DEFAULT_ZONE,
) -> dict[str, DataFrame]:
    """Landed grid to stored feature tables per technology."""
    wide = regional_table(grid, rings, regions, zone)
    tables = {t: technology_features(wide, t, (plants or {}).get(t)) for t in ("wind", "solar")}
    if output is not None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{output}/{name}")
    return tables


def predict_from_bundle(features: DataFrame, bundle: str, ts: str = "datetime") -> DataFrame:
    """Batch scoring with a stored model."""
    model, metadata = load_bundle(bundle, features.sparkSession)
    if model is None:
        raise FileNotFoundError(f"no model bundle at {bundle}")
    return score_table(model, metadata, features, keep=(ts,)).select(ts, "prediction")
