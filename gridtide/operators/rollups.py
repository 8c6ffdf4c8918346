"""Time roll-ups, technology tables, pivots and melts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridtide.functions.columns import numeric_columns
from gridtide.functions.timeparts import truncate
from gridtide.operators.ordering import largest_group
from gridtide.operators.quantiles import exact_quantiles

AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def listed(column: str, values) -> Column:
    """The column itself; a value outside the list is an error, since its rows would get lost."""
    value = F.col(column)
    return F.when(value.isNull() | value.isin(list(values)), value).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} is not listed: "), value.cast("string"))),
    )


def roll_up(df: DataFrame, ts: str, resolution: str, functions="sum", columns=None, keys=()) -> DataFrame:
    """Aggregate numeric columns per period, output ``{column}_{function}``.

    ``functions`` is a name, a list of names, or a dict of column to name(s). All but
    the median are one partial and final aggregate; medians come from the exact
    quantile operator, so no period is gathered in one buffer.
    """
    columns = list(columns or numeric_columns(df, skip=keys))
    if isinstance(functions, dict):
        wanted = [(c, f) for c, fs in functions.items() for f in ([fs] if isinstance(fs, str) else fs)]
    else:
        names = [functions] if isinstance(functions, str) else list(functions)
        wanted = [(c, f) for c in columns for f in names]
    unknown = {f for _, f in wanted} - set(AGGREGATES) - {"median"}
    if unknown:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    by = [*keys, "datetime"]
    used = list(dict.fromkeys(c for c, _ in wanted))
    sources = df.select(
        *keys, truncate(F.col(ts), resolution).alias("datetime"), *[F.col(c).alias(f"_v_{c}") for c in used],
    )
    sources = sources.na.drop(subset=by)
    plain = [AGGREGATES[f](F.col(f"_v_{c}")).alias(f"{c}_{f}") for c, f in wanted if f != "median"]
    result = sources.groupBy(*by).agg(*plain) if plain else sources.select(*by).distinct()
    medians = [c for c, f in wanted if f == "median"]
    largest = largest_group(sources, by) if medians else 0
    for c in medians:
        middle = exact_quantiles(sources, by, f"_v_{c}", {f"{c}_median": 0.5}, largest=largest)
        result = result.join(middle, by, "left")
    return result.select(*by, *[f"{c}_{f}" for c, f in wanted])


def plant_hours(
    df: DataFrame, date: str = "fecha_opreal", hour: str = "hora_opreal", plant: str = "central_nombre",
    kind: str = "central_tipo_nemotecnico", energy: str = "generacion_real_mwh", kinds: list[str] | None = None,
) -> DataFrame:
    """Energy per plant and hour with the plant's type.

    With ``kinds`` the type travels as its place in that list: a numeric buffer keeps the
    aggregate hashed, a text one would make every task sort its rows first. A type
    outside the list is an error.
    """
    rows = df.na.drop(subset=[date, hour, plant])
    total = F.coalesce(F.sum(energy), F.lit(0.0)).alias(energy)
    if kinds is None:
        return rows.groupBy(date, hour, plant).agg(total, F.min(kind).alias(kind))
    names = sorted(kinds)
    unlisted = F.when(F.col(kind).isNotNull(), listed(kind, names).cast("int"))
    place = F.coalesce(*[F.when(F.col(kind) == k, i) for i, k in enumerate(names)], unlisted)
    table = F.array(*[F.lit(k) for k in names])
    return rows.groupBy(date, hour, plant).agg(total, F.min(place).alias(kind)).withColumn(
        kind, F.get(table, F.col(kind)),
    )


def technology_hours(
    plants: DataFrame, date: str = "fecha_opreal", hour: str = "hora_opreal", plant: str = "central_nombre",
    kind: str = "central_tipo_nemotecnico", energy: str = "generacion_real_mwh",
) -> DataFrame:
    """Active plants, all plants and active share per technology and hour (D3, F2).

    The input has one row per plant and hour, so a count is a distinct count.
    """
    return plants.na.drop(subset=[kind]).groupBy(date, hour, kind).agg(*_plant_metrics(plant, energy))


def _plant_metrics(plant: str, energy: str) -> list[Column]:
    active, total = F.count_if(F.col(energy) > 0), F.count(plant)
    return [
        active.alias("active_plants"),
        total.alias("total_plants"),
        F.coalesce(F.try_divide(active, total), F.lit(0.0)).alias("percentage_active"),
    ]


def technology_table(
    plants: DataFrame, kinds: list[str], date: str = "fecha_opreal", hour: str = "hora_opreal",
    plant: str = "central_nombre", kind: str = "central_tipo_nemotecnico", energy: str = "generacion_real_mwh",
) -> DataFrame:
    """Wide hourly table ``{metric}_{technology}`` with absent cells as zero.

    One shuffle on (date, hour): every technology is a conditional aggregate,
    which is the same plan a pivot over a literal list ends in. Another technology is an error.
    """
    metrics = []
    for k in kinds:
        here = F.col(kind) == k
        active = F.count_if(here & (F.col(energy) > 0))
        total = F.count_if(here & F.col(plant).isNotNull())
        metrics += [
            active.alias(f"active_plants_{k}"),
            total.alias(f"total_plants_{k}"),
            F.coalesce(F.try_divide(active, total), F.lit(0.0)).alias(f"percentage_active_{k}"),
        ]
    return plants.withColumn(kind, listed(kind, kinds)).groupBy(date, hour).agg(*metrics)


def active_total_pivot(plants: DataFrame, kinds: list[str], by, kind: str, plant: str, energy: str) -> DataFrame:
    """``{technology}_active`` and ``{technology}_total`` in one aggregate."""
    cells = []
    for k in kinds:
        here = F.col(kind) == k
        cells.append(F.count_if(here & (F.col(energy) > 0)).alias(f"{k}_active"))
        cells.append(F.count_if(here & F.col(plant).isNotNull()).alias(f"{k}_total"))
    return plants.withColumn(kind, listed(kind, kinds)).groupBy(*by).agg(*cells)


def pivot_sum(df: DataFrame, by, column: str, values: list[str], amount: str) -> DataFrame:
    """Sum per group with one column per listed value (D5); another value is an error."""
    return df.withColumn(column, listed(column, values)).na.drop(subset=list(by)).groupBy(*by).pivot(column, values).agg(F.sum(amount))


def melt(df: DataFrame, ids, values, variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), variable, value)


def group_sums(df: DataFrame, by, columns) -> DataFrame:
    """Plain sums per group."""
    return df.na.drop(subset=list(by)).groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns],
    )


def profile(df: DataFrame, by, value: str, out: str = "mean_value") -> DataFrame:
    """Mean per group, e.g. per hour and technology."""
    return df.na.drop(subset=list(by)).groupBy(*by).agg(F.avg(value).alias(out))


def hydro_and_renewable(df: DataFrame) -> DataFrame:
    """Hydro = reservoir + run-of-river; renewable = solar + wind + geothermal."""
    sums = {"hidraulica": ("embalse", "pasada"), "ernc": ("solar", "eolica", "geotermica")}
    return df.withColumns(
        {
            name: reduce(lambda a, b: a + b, map(F.col, parts))
            for name, parts in sums.items()
            if set(parts) <= set(df.columns)
        },
    )
