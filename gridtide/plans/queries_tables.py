"""Queries: columns, roll-ups, joins, pivots, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import columns as C, timeparts as T
from gridtide.operators import joins, ordering, rollups
from gridtide.plans.fixtures import GENERATION_SQL, KINDS, SUBTYPES, generation, table
from gridtide.plans.registry import query, steady_round as r

PLANT_SQL = f"""WITH {GENERATION_SQL},
plants AS (SELECT fecha_opreal, hora_opreal, central_nombre, sum(generacion_real_mwh) AS mwh,
                  min(central_tipo_nemotecnico) AS kind FROM gen GROUP BY 1, 2, 3)
"""


def _share_sql(k):
    a, t = f"count(*) FILTER (WHERE kind = '{k}' AND mwh > 0)", f"count(*) FILTER (WHERE kind = '{k}')"
    return (
        f"{a} AS active_plants_{k}, {t} AS total_plants_{k}, "
        f"round(coalesce(CAST({a} AS DOUBLE) / nullif({t}, 0), 0.0), 6) + 0.0 AS percentage_active_{k}"
    )


@query(
    "plant_tech_hourly",
    PLANT_SQL + f"SELECT fecha_opreal + to_hours(hora_opreal - 1) AS datetime, "
    f"{', '.join(_share_sql(k) for k in KINDS)} FROM plants WHERE hora_opreal <> 25 GROUP BY 1",
)
def plant_tech_hourly(spark, sf_dir):
    wide = rollups.technology_table(rollups.plant_hours(generation(spark, sf_dir), kinds=KINDS), KINDS)
    timed = T.market_datetime(wide).drop("fecha_opreal", "hora_opreal")
    return timed.withColumns({f"percentage_active_{k}": r(F.col(f"percentage_active_{k}")) for k in KINDS})


@query(
    "technology_hours",
    PLANT_SQL + """SELECT fecha_opreal, hora_opreal, kind AS central_tipo_nemotecnico,
      count(*) FILTER (WHERE mwh > 0) AS active_plants, count(*) AS total_plants,
      round(CAST(count(*) FILTER (WHERE mwh > 0) AS DOUBLE) / count(*), 6) + 0.0 AS percentage_active
      FROM plants GROUP BY 1, 2, 3""",
)
def technology_hours(spark, sf_dir):
    hours = rollups.technology_hours(rollups.plant_hours(generation(spark, sf_dir), kinds=KINDS))
    return hours.withColumn("percentage_active", r(F.col("percentage_active")))


ROLL_COLUMNS = """round(coalesce(sum({v}), 0), 4) + 0.0 AS {v}_sum, round(avg({v}), 6) + 0.0 AS {v}_mean,
 round(median({v}), 6) + 0.0 AS {v}_median, min({v}) AS {v}_min, max({v}) AS {v}_max, count({v}) AS {v}_count,
 round(stddev_samp({v}), 5) + 0.0 AS {v}_std"""


def _rollup(df, ts, unit, value):
    names = ["sum", "mean", "median", "min", "max", "count", "std"]
    out = rollups.roll_up(df, ts, unit, names, [value])
    digits = {"sum": 4, "mean": 6, "median": 6, "std": 5}
    return out.withColumns({f"{value}_{f}": r(F.col(f"{value}_{f}"), d) for f, d in digits.items()})


for _unit in ("hour", "day", "week"):
    query(
        f"rollup_{_unit}",
        f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS datetime, {ROLL_COLUMNS.format(v='value')} FROM events GROUP BY 1",
    )(lambda spark, sf_dir, unit=_unit: _rollup(table(spark, sf_dir, "events"), "ts", unit, "value"))
for _unit in ("month", "quarter", "year"):
    query(
        f"rollup_{_unit}",
        f"SELECT date_trunc('{_unit}', l_shipdate)::TIMESTAMP AS datetime, {ROLL_COLUMNS.format(v='l_quantity')} "
        "FROM lineitem GROUP BY 1",
    )(lambda spark, sf_dir, unit=_unit: _rollup(table(spark, sf_dir, "lineitem"), "l_shipdate", unit, "l_quantity"))


@query(
    "rollup_per_column",
    """SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS datetime,
       round(sum(o_totalprice), 2) + 0.0 AS o_totalprice_sum, max(o_totalprice) AS o_totalprice_max,
       count(o_orderkey) AS o_orderkey_count, round(var_samp(o_orderkey) / 1e6, 4) + 0.0 AS o_orderkey_var
       FROM orders GROUP BY 1, 2""",
)
def rollup_per_column(spark, sf_dir):
    spec = {"o_totalprice": ["sum", "max"], "o_orderkey": ["count", "var"]}
    out = rollups.roll_up(table(spark, sf_dir, "orders"), "o_orderdate", "M", spec, keys=["o_orderpriority"])
    return out.withColumns({"o_totalprice_sum": r(F.col("o_totalprice_sum"), 2), "o_orderkey_var": r(F.col("o_orderkey_var") / 1e6, 4)})


@query(
    "truncations",
    "SELECT event_id, "
    + ", ".join(f"date_trunc('{u}', ts)::TIMESTAMP AS at_{u}" for u in ("minute", "hour", "day", "week", "month", "quarter", "year"))
    + " FROM events",
)
def truncations(spark, sf_dir):
    units = ("minute", "hour", "day", "week", "month", "quarter", "year")
    return table(spark, sf_dir, "events").select("event_id", *[T.truncate("ts", u).alias(f"at_{u}") for u in units])


def _cycle_sql(ts="ts"):
    parts = {"hour": (f"hour({ts})", 24), "day": (f"day({ts})", 31), "month": (f"month({ts})", 12), "dayofweek": (f"(isodow({ts}) - 1)", 7)}
    return ", ".join(
        f"round({fn}(2 * pi() * {expr} / {n}), 6) + 0.0 AS {p}_{fn}" for p, (expr, n) in parts.items() for fn in ("sin", "cos")
    )


@query("cyclical_features", f"SELECT event_id, {_cycle_sql()}, CAST(year(ts) AS INTEGER) AS year FROM events")
def cyclical_features(spark, sf_dir):
    parts = ["hour", "day", "month", "dayofweek", "unknown"]
    out = T.add_cycles(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", parts)
    return out.select("event_id", *[r(F.col(c)).alias(c) for c in out.columns if c[-4:] in ("_sin", "_cos")], "year")


@query(
    "date_range",
    "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'",
)
def date_range(spark, sf_dir):
    return T.time_between(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id", "ts", "value")


@query("local_time", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Santiago' AS local_ts FROM events")
def local_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.to_zone("ts").alias("local_ts"))




@query(
    "local_datetime_dst",
    """WITH t AS (
      SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 25 + 1 AS INTEGER) AS h FROM orders),
    w AS (SELECT *, CASE WHEN h = 25 THEN d + INTERVAL 1 HOUR ELSE d + to_hours(h - 1) END AS wall,
                 timezone('America/Santiago', CASE WHEN h = 25 THEN d + INTERVAL 1 HOUR ELSE d + to_hours(h - 1) END) AS inst FROM t),
    a AS (SELECT *, timezone('America/Santiago', inst - INTERVAL 1 HOUR) = wall AS back,
                 timezone('America/Santiago', inst + INTERVAL 1 HOUR) = wall AS ahead FROM w),
    n AS (SELECT *, row_number() OVER (PARTITION BY d, (back OR ahead) AND h <= 24 ORDER BY o_orderkey) AS k,
                 count(*) OVER (PARTITION BY d, (back OR ahead) AND h <= 24) AS c FROM a)
    SELECT o_orderkey, timezone('UTC',
      CASE WHEN NOT (back OR ahead) THEN inst
           WHEN h = 25 OR k > c // 2 THEN CASE WHEN back THEN inst ELSE inst + INTERVAL 1 HOUR END
           ELSE CASE WHEN back THEN inst - INTERVAL 1 HOUR ELSE inst END END) AS datetime_utc FROM n""",
)
def local_datetime_dst(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("fecha_opreal"),
        (F.col("o_orderkey") % 25 + 1).cast("int").alias("hora_opreal"),
    )
    return T.market_datetime_utc(rows, "o_orderkey", hour25="same_date").select("o_orderkey", "datetime_utc")


_SANTIAGO = "timezone('America/Santiago', {})"


def _second_pass(wall: str) -> str:
    """Instant of the second pass of a wall time, null where the clock shows it once."""
    first = _SANTIAGO.format(wall)
    back, ahead = (f"{_SANTIAGO.format(f'{first} {sign} INTERVAL 1 HOUR')} = {wall}" for sign in "-+")
    return f"CASE WHEN {back} THEN {first} WHEN {ahead} THEN {first} + INTERVAL 1 HOUR END"


@query(
    "market_hour_25",
    f"""WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT strftime(d, '%Y-%m-%d') AS day, timezone('UTC', coalesce({_second_pass("(d + INTERVAL 23 HOUR)")}, {_second_pass("(d + INTERVAL 24 HOUR)")},
      {_SANTIAGO.format("d + INTERVAL 1 HOUR")})) AS datetime_utc FROM t""",
)
def market_hour_25(spark, sf_dir):
    """Hour 25 of every day by the default rule."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("fecha_opreal"), F.lit(25).alias("hora_opreal")).distinct()
    return T.market_datetime_utc(days, "hora_opreal").select(T.iso_date("fecha_opreal").alias("day"), "datetime_utc")


@query(
    "row_totals",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, 0) + coalesce(l_extendedprice, 0) + coalesce(l_discount, 0), 4) + 0.0 AS total,
       round(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END + l_extendedprice, 4) + 0.0 AS strict FROM lineitem""",
)
def row_totals(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")))
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r(C.row_total(["l_quantity", "l_extendedprice", "l_discount"]), 4).alias("total"),
        r(C.strict_total(["l_quantity", "l_extendedprice"]), 4).alias("strict"),
    )


@query("ssrd_watts", "SELECT event_id, round(value / (3.0 * 3600.0), 9) + 0.0 AS value FROM events")
def ssrd_watts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r(C.joules_to_watts("value", 3.0), 9).alias("value"))


DEMAND_SQL = "demand AS (SELECT date_trunc('day', ts) AS fecha, CAST(hour(ts) AS INTEGER) AS hora, round(sum(value), 2) AS x FROM events GROUP BY 1, 2)"


@query(
    "decimal_comma",
    f"WITH {DEMAND_SQL} SELECT fecha, hora, CAST(x AS DOUBLE) AS demanda FROM demand",
)
def decimal_comma(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    text = events.groupBy(T.truncate("ts", "day").alias("fecha"), F.hour("ts").alias("hora")).agg(
        F.replace(r(F.sum("value"), 2).cast("string"), F.lit("."), F.lit(",")).alias("demanda"),
    )
    return text.withColumn("demanda", C.comma_decimal("demanda"))


@query(
    "calendar_parts",
    """SELECT o_orderkey, isodow(o_orderdate) - 1 AS weekday, hour(o_orderdate) AS hour,
       monthname(o_orderdate) AS month_name, strftime(o_orderdate, '%Y-%m-%d') AS iso_day FROM orders""",
)
def calendar_parts(spark, sf_dir):
    keyed = T.calendar_keys(table(spark, sf_dir, "orders"), "o_orderdate")
    return keyed.select(
        "o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in ("weekday", "hour")], "month_name",
        T.iso_date("o_orderdate").alias("iso_day"),
    )


@query(
    "hour_text",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(hour(ts) AS VARCHAR) END AS h,
         strftime(ts, '%d-%m-%y') AS d, value FROM events)
       SELECT coalesce(TRY_CAST(h AS INTEGER), -1) AS h, strptime(d, '%d-%m-%y') AS d, count(*) AS n,
              count(*) FILTER (WHERE value > 0) AS active FROM t GROUP BY 1, 2""",
)
def hour_text(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.hour("ts").cast("string")).alias("h"),
        C.date_by_pattern(F.date_format("ts", "dd-MM-yy")).cast("timestamp_ntz").alias("d"), C.active_flag("value").alias("flag"),
    )
    parsed = C.parse_hours(events, "h").withColumn("h", F.coalesce("h", F.lit(-1)))
    return parsed.groupBy("h", "d").agg(F.count("*").alias("n"), F.count("flag").alias("active"))


def _by_kind(spark, sf_dir, kind):
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rollups.roll_up(events, "ts", "hour", "sum", ["value"]).select(
        "datetime", r(F.col("value_sum"), 4).alias("value"),
    )


def _kinds_sql(word: str, names=KINDS) -> str:
    """All types joined one after another; types lack some hours by themselves."""
    each = ", ".join(
        f"{k}_ AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS datetime, round(sum(value), 4) + 0.0 AS {k} FROM events WHERE event_type = '{k}' GROUP BY 1)" for k in KINDS
    )
    columns = ", ".join(f"{old} AS {new}" for old, new in zip(KINDS, names))
    return f"WITH {each} SELECT datetime, {columns} FROM {f' {word} JOIN '.join(f'{k}_' if not i else f'{k}_ USING (datetime)' for i, k in enumerate(KINDS))}"


for _how, _word in (("outer", "FULL"), ("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT")):
    query(f"multi_join_{_how}", _kinds_sql(_word, [f"value_{k}" for k in KINDS]))(
        lambda spark, sf_dir, how=_how: joins.join_by_time({k: _by_kind(spark, sf_dir, k) for k in KINDS}, "datetime", how, "hour"),
    )


@query("multi_join_prefix", _kinds_sql("INNER", [f"{k}_value" for k in KINDS]))
def multi_join_prefix(spark, sf_dir):
    return joins.join_by_time({k: _by_kind(spark, sf_dir, k) for k in KINDS}, "datetime", "inner", "hour", rule="prefix")


@query("multi_join_overwrite", _kinds_sql("LEFT").replace(f"SELECT datetime, {', '.join(f'{k} AS {k}' for k in KINDS)}", f"SELECT datetime, {KINDS[-1]} AS value"))
def multi_join_overwrite(spark, sf_dir):
    """The last table's column stays."""
    return joins.join_by_time({k: _by_kind(spark, sf_dir, k) for k in KINDS}, "datetime", "left", "hour", rule="overwrite")


@query(
    "demand_generation_join",
    f"""WITH {GENERATION_SQL}, {DEMAND_SQL},
      g AS (SELECT fecha_opreal, hora_opreal, round(sum(generacion_real_mwh), 4) AS generacion FROM gen GROUP BY 1, 2)
      SELECT fecha_opreal, hora_opreal, CAST(x AS DOUBLE) AS demanda, generacion FROM g
      JOIN demand ON fecha = fecha_opreal AND hora + 1 = hora_opreal""",
)
def demand_generation_join(spark, sf_dir):
    gen = generation(spark, sf_dir).groupBy("fecha_opreal", "hora_opreal").agg(
        r(F.sum("generacion_real_mwh"), 4).alias("generacion"),
    )
    events = table(spark, sf_dir, "events")
    demand = events.groupBy(T.truncate("ts", "day").alias("fecha_opreal"), (F.hour("ts") + 1).alias("hora_opreal")).agg(
        r(F.sum("value"), 2).alias("demanda"),
    )
    return joins.join_on(gen, demand, ["fecha_opreal", "hora_opreal"])


WEATHER_SQL = """
 o AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS d, sum(o_totalprice) AS price FROM orders GROUP BY 1),
 w AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS d, avg(l_quantity) AS rain FROM lineitem GROUP BY 1)"""


@query(
    "weather_join",
    f"WITH {WEATHER_SQL} SELECT d, round(price, 2) + 0.0 AS price, round(rain, 6) + 0.0 AS rain FROM o JOIN w USING (d)",
)
def weather_join(spark, sf_dir):
    return _weather(spark, sf_dir).select("d", r(F.col("price"), 2).alias("price"), r(F.col("rain")).alias("rain"))


def _weather(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    prices = orders.groupBy(T.truncate("o_orderdate", "day").alias("d")).agg(F.sum("o_totalprice").alias("price"))
    rain = lines.groupBy(T.truncate("l_shipdate", "day").alias("d")).agg(F.avg("l_quantity").alias("rain"))
    return joins.join_on(prices, rain, "d")


@query(
    "weather_correlation",
    f"WITH {WEATHER_SQL} SELECT round(corr(price, rain), 6) + 0.0 AS correlation FROM o JOIN w USING (d)",
)
def weather_correlation(spark, sf_dir):
    from gridtide.operators.statistics import pair_correlation

    return pair_correlation(_weather(spark, sf_dir), "price", "rain").select(r(F.col("correlation")).alias("correlation"))


@query(
    "subtype_pivot",
    f"WITH {GENERATION_SQL} SELECT fecha_opreal, hora_opreal, "
    + ", ".join(f"round(sum(generacion_real_mwh) FILTER (WHERE subtipo = '{s}'), 4) + 0.0 AS {s}" for s in SUBTYPES)
    + " FROM gen GROUP BY 1, 2",
)
def subtype_pivot(spark, sf_dir):
    wide = rollups.pivot_sum(generation(spark, sf_dir), ["fecha_opreal", "hora_opreal"], "subtipo", SUBTYPES, "generacion_real_mwh")
    return wide.withColumns({s: r(F.col(s), 4) for s in SUBTYPES})


TYPE_PIVOT_SQL = (
    f"WITH {GENERATION_SQL}, wide AS (SELECT fecha_opreal, hora_opreal, "
    + ", ".join(f"round(sum(generacion_real_mwh) FILTER (WHERE central_tipo_nemotecnico = '{k}'), 4) + 0.0 AS {k}" for k in KINDS)
    + " FROM gen GROUP BY 1, 2) "
)


def _type_pivot(spark, sf_dir):
    wide = rollups.pivot_sum(
        generation(spark, sf_dir), ["fecha_opreal", "hora_opreal"], "central_tipo_nemotecnico", KINDS, "generacion_real_mwh",
    )
    return wide.withColumns({k: r(F.col(k), 4) for k in KINDS})


@query(
    "melt",
    TYPE_PIVOT_SQL
    + " UNION ALL ".join(f"SELECT fecha_opreal, hora_opreal, '{k}' AS tipo, {k} AS mwh FROM wide" for k in KINDS),
)
def melt(spark, sf_dir):
    return rollups.melt(_type_pivot(spark, sf_dir), ["fecha_opreal", "hora_opreal"], KINDS, "tipo", "mwh")


@query(
    "derived_totals",
    TYPE_PIVOT_SQL + "SELECT fecha_opreal, hora_opreal, click AS embalse, error AS pasada, "
    "round(click + error, 4) + 0.0 AS hidraulica, purchase AS solar, signup AS eolica, view AS geotermica, "
    "round(purchase + signup + view, 4) + 0.0 AS ernc FROM wide",
)
def derived_totals(spark, sf_dir):
    names = dict(zip(KINDS, ["embalse", "pasada", "solar", "eolica", "geotermica"]))
    renamed = C.shape_columns(_type_pivot(spark, sf_dir), rename=names)
    summed = rollups.hydro_and_renewable(renamed)
    return summed.withColumns({c: r(F.col(c), 4) for c in ("hidraulica", "ernc")})


@query(
    "hour_profile",
    f"""WITH {GENERATION_SQL} SELECT hora_opreal, central_tipo_nemotecnico,
        round(avg(generacion_real_mwh), 6) + 0.0 AS mean_mwh FROM gen GROUP BY 1, 2""",
)
def hour_profile(spark, sf_dir):
    out = rollups.profile(generation(spark, sf_dir), ["hora_opreal", "central_tipo_nemotecnico"], "generacion_real_mwh", "mean_mwh")
    return out.withColumn("mean_mwh", r(F.col("mean_mwh")))


@query(
    "daily_sums",
    f"""WITH {GENERATION_SQL} SELECT fecha_opreal, central_tipo_nemotecnico,
        round(sum(generacion_real_mwh), 4) + 0.0 AS generacion_real_mwh FROM gen GROUP BY 1, 2""",
)
def daily_sums(spark, sf_dir):
    out = rollups.group_sums(generation(spark, sf_dir), ["fecha_opreal", "central_tipo_nemotecnico"], ["generacion_real_mwh"])
    return out.withColumn("generacion_real_mwh", r(F.col("generacion_real_mwh"), 4))


@query(
    "active_total_pivot",
    PLANT_SQL + "SELECT fecha_opreal, hora_opreal, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}' AND mwh > 0) AS {k}_active, count(*) FILTER (WHERE kind = '{k}') AS {k}_total" for k in KINDS)
    + " FROM plants GROUP BY 1, 2",
)
def active_total_pivot(spark, sf_dir):
    return rollups.active_total_pivot(
        rollups.plant_hours(generation(spark, sf_dir), kinds=KINDS), KINDS, ["fecha_opreal", "hora_opreal"],
        "central_tipo_nemotecnico", "central_nombre", "generacion_real_mwh",
    )


@query(
    "union_by_name",
    """SELECT o_orderkey AS id, o_totalprice AS amount, o_orderpriority AS note, NULL::DOUBLE AS part FROM orders
       UNION ALL SELECT l_orderkey, l_extendedprice, NULL, l_partkey FROM lineitem""",
)
def union_by_name(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("note"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("double").alias("part"), F.col("l_extendedprice").alias("amount"), F.col("l_orderkey").alias("id"),
    )
    return joins.union_tables([orders, lines])


@query(
    "plant_membership",
    "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) "
    "AND event_type IN ('click', 'view')",
)
def plant_membership(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 5000).select("c_custkey")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return C.among(C.among(events, "event_type", ["click", "view"]), "user_id", rich)


@query(
    "absent_customers",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def absent_customers(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.absent_from(table(spark, sf_dir, "customer").select("c_custkey"), buyers, "c_custkey")


@query(
    "name_lookup",
    "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def name_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.name_by_id(table(spark, sf_dir, "customer"), names, "c_nationkey").select("c_custkey", "n_name")


@query(
    "first_per_hour",
    """SELECT date_trunc('hour', ts)::TIMESTAMP AS h, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type
       FROM events GROUP BY 1""",
)
def first_per_hour(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(T.truncate("ts", "hour").alias("h"), "event_id", "event_type")
    return ordering.keep_first(events, ["h"], ["event_id"])


@query(
    "distinct_plants",
    f"WITH {GENERATION_SQL} SELECT DISTINCT central_nombre, central_tipo_nemotecnico FROM gen",
)
def distinct_plants(spark, sf_dir):
    return generation(spark, sf_dir).select("central_nombre", "central_tipo_nemotecnico").distinct()


@query(
    "largest_orders",
    """SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (
         PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 5""",
)
def largest_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordering.top_rows(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, ["o_orderpriority"])


@query("random_rows", "SELECT * FROM events ORDER BY md5('12|' || event_id) LIMIT 20")
def random_rows(spark, sf_dir):
    return ordering.random_rows(table(spark, sf_dir, "events"), 20, by=["event_id"])


@query(
    "hydrated_rows",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS v,
         CASE WHEN event_id % 100 = 0 THEN NULL ELSE user_id END AS u FROM events)
       SELECT * FROM t WHERE v IS NOT NULL OR u IS NOT NULL""",
)
def hydrated_rows(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 50 != 0, F.col("value")).alias("v"), F.when(e % 100 != 0, F.col("user_id")).alias("u"),
    )
    return joins.drop_empty_rows(rows, ["v", "u"])


@query(
    "two_pivots_join",
    PLANT_SQL + "SELECT fecha_opreal, hora_opreal, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}' AND mwh > 0) AS {k}_active, count(*) FILTER (WHERE kind = '{k}') AS {k}_total" for k in KINDS)
    + " FROM plants GROUP BY 1, 2",
)
def two_pivots_join(spark, sf_dir):
    """Flags and plants pivoted apart and joined with suffixes."""
    by = ["fecha_opreal", "hora_opreal"]
    plants = rollups.plant_hours(generation(spark, sf_dir), kinds=KINDS).withColumn("flag", C.active_flag("generacion_real_mwh"))
    kinds = plants.groupBy(*by).pivot("central_tipo_nemotecnico", KINDS)
    active = kinds.agg(F.coalesce(F.sum("flag"), F.lit(0))).na.fill(0, KINDS)
    total = kinds.agg(F.count("central_nombre")).na.fill(0, KINDS)
    return joins.join_with_suffixes(active, total, by, "_active", "_total", "left", always=True)


@query(
    "typed_dates",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_trunc('day', ts) END AS fecha, CAST(hour(ts) AS INTEGER) AS hora FROM events""",
)
def typed_dates(spark, sf_dir):
    text = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, "unknown").otherwise(T.iso_date("ts")).alias("fecha"),
        (F.hour("ts") + 1).alias("hora"),
    )
    return C.typed_dates(text, "fecha", "hora")


@query(
    "prediction_alignment",
    """WITH h AS (SELECT date_trunc('hour', ts) AS datetime, round(sum(value), 4) AS v FROM events GROUP BY 1),
    p AS (SELECT datetime + INTERVAL 1 DAY AS datetime, v AS predicted FROM h)
    SELECT datetime, v AS actual, predicted FROM h FULL JOIN p USING (datetime)""",
)
def prediction_alignment(spark, sf_dir):
    """Hourly totals beside the value of a day before as forecast."""
    hours = rollups.roll_up(table(spark, sf_dir, "events"), "ts", "hour", "sum", ["value"])
    actual = hours.select("datetime", r(F.col("value_sum"), 4).alias("actual"))
    naive = hours.select((F.col("datetime") + F.expr("interval 1 day")).alias("datetime"), r(F.col("value_sum"), 4).alias("predicted"))
    return joins.align_predictions(actual, naive, "datetime")
