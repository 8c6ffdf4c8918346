"""Queries: completeness, islands, sampling step, ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timeparts as T
from gridtide.operators import granularity, ordering, quality
from gridtide.plans.fixtures import GENERATION_SQL, KINDS, generation, table
from gridtide.plans.registry import query, steady_round as r

MISSING_SQL = """
days AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders),
gaps AS (SELECT d FROM (SELECT unnest(generate_series((SELECT min(d) FROM days), (SELECT max(d) FROM days), INTERVAL 1 DAY)) AS d)
         WHERE d NOT IN (SELECT d FROM days))"""
CLUSTER_SQL = """
flagged AS (SELECT d, CASE WHEN d - lag(d) OVER (ORDER BY d) < INTERVAL 48 HOUR THEN 0 ELSE 1 END AS opens FROM gaps),
numbered AS (SELECT d, CAST(sum(opens) OVER (ORDER BY d) AS BIGINT) AS island FROM flagged),
clusters AS (SELECT island, min(d) AS island_start, max(d) AS island_end, count(*) AS island_size FROM numbered GROUP BY 1)"""


def _order_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("d"))


@query("missing_dates", f"WITH {MISSING_SQL} SELECT d FROM gaps")
def missing_dates(spark, sf_dir):
    return quality.missing_times(_order_days(spark, sf_dir), "d")


@query("missing_clusters", f"WITH {MISSING_SQL}, {CLUSTER_SQL} SELECT * FROM clusters")
def missing_clusters(spark, sf_dir):
    return quality.missing_clusters(_order_days(spark, sf_dir), "d")


@query(
    "missing_report",
    f"""WITH {MISSING_SQL}, {CLUSTER_SQL}, total AS (SELECT count(*) AS c FROM gaps)
    SELECT island_start AS first, CASE WHEN island_size = 1 THEN 'Isolated missing date: ' || strftime(island_start, '%Y-%m-%d')
      ELSE 'Missing cluster #' || island || ': ' || strftime(island_start, '%Y-%m-%d') || ' to ' || strftime(island_end, '%Y-%m-%d')
           || ' (' || island_size || ' dates)' END AS line FROM clusters, total WHERE c > 10
    UNION ALL SELECT d, 'Missing date: ' || strftime(d, '%Y-%m-%d') FROM gaps, total WHERE c <= 10""",
)
def missing_report(spark, sf_dir):
    return quality.missing_report(_order_days(spark, sf_dir), "d")


@query(
    "missing_hours_per_type",
    """WITH seen AS (SELECT DISTINCT event_type, date_trunc('hour', ts)::TIMESTAMP AS h FROM events),
    spans AS (SELECT event_type, min(h) AS lo, max(h) AS hi FROM seen GROUP BY 1),
    spine AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM spans)
    SELECT * FROM spine EXCEPT SELECT * FROM seen""",
)
def missing_hours_per_type(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", T.truncate("ts", "hour").alias("h"))
    return quality.missing_times(events, "h", "hour", ["event_type"])


HOURS_SQL = f"""{GENERATION_SQL},
hh AS (SELECT event_id, fecha_opreal, CAST(hora_opreal - 1 AS INTEGER) AS hora, central_tipo_nemotecnico AS kind FROM gen)"""


def _hours(spark, sf_dir):
    return generation(spark, sf_dir).select(
        "event_id", "fecha_opreal", (F.col("hora_opreal") - 1).alias("hora"), F.col("central_tipo_nemotecnico").alias("kind"),
    )


@query("invalid_hours", f"WITH {HOURS_SQL} SELECT * FROM hh WHERE NOT coalesce(hora BETWEEN 0 AND 23, false)")
def invalid_hours(spark, sf_dir):
    return quality.invalid_hours(_hours(spark, sf_dir), "hora")


LACKING_SQL = """
lacking AS (SELECT kind, fecha_opreal, list_sort(list(CAST(h AS INTEGER))) AS missing_hours
  FROM (SELECT DISTINCT kind, fecha_opreal FROM hh) d, generate_series(0, 23) g(h)
  WHERE NOT EXISTS (SELECT 1 FROM hh WHERE hh.kind = d.kind AND hh.fecha_opreal = d.fecha_opreal AND hora = h)
  GROUP BY 1, 2)"""


@query(
    "missing_hours",
    f"WITH {HOURS_SQL}, {LACKING_SQL} SELECT kind, fecha_opreal, array_to_string(missing_hours, ',') AS missing_hours FROM lacking",
)
def missing_hours(spark, sf_dir):
    out = quality.missing_hours(_hours(spark, sf_dir), "fecha_opreal", "hora", ["kind"])
    return out.withColumn("missing_hours", F.array_join(F.col("missing_hours").cast("array<string>"), ","))


@query(
    "duplicate_hours",
    f"WITH {HOURS_SQL} SELECT kind, fecha_opreal, hora, count(*) AS n FROM hh GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_hours(spark, sf_dir):
    return quality.duplicate_hours(_hours(spark, sf_dir), "fecha_opreal", "hora", ["kind"])


@query(
    "duplicate_hour_maps",
    f"""WITH {HOURS_SQL}, d AS (SELECT kind, fecha_opreal, hora, count(*) AS n FROM hh WHERE hora BETWEEN 0 AND 23 GROUP BY ALL HAVING count(*) > 1)
    SELECT kind, fecha_opreal, string_agg(hora || ':' || n, ',' ORDER BY hora) AS duplicates FROM d WHERE kind IS NOT NULL AND fecha_opreal IS NOT NULL GROUP BY ALL""",
)
def duplicate_hour_maps(spark, sf_dir):
    """The map of each day as text."""
    maps = quality.duplicate_hour_maps(_hours(spark, sf_dir), "fecha_opreal", "hora", ["kind"])
    cells = F.transform(F.map_entries("duplicates"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return maps.withColumn("duplicates", F.array_join(cells, ","))


@query(
    "hour_issues",
    f"""WITH {HOURS_SQL}
    SELECT 'invalid' AS issue, fecha_opreal, hora, count(*) AS n FROM hh WHERE NOT coalesce(hora BETWEEN 0 AND 23, false) GROUP BY ALL
    UNION ALL SELECT 'duplicate', fecha_opreal, hora, count(*) FROM hh GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'missing', fecha_opreal, CAST(h AS INTEGER), 1 FROM (SELECT DISTINCT fecha_opreal FROM hh) d, generate_series(0, 23) g(h)
      WHERE NOT EXISTS (SELECT 1 FROM hh WHERE hh.fecha_opreal = d.fecha_opreal AND hora = h)""",
)
def hour_issues(spark, sf_dir):
    return quality.hour_issues(_hours(spark, sf_dir), "fecha_opreal", "hora")


@query(
    "completeness",
    f"""WITH {HOURS_SQL}, {MISSING_SQL},
    inv AS (SELECT count(*) AS c FROM hh WHERE NOT coalesce(hora BETWEEN 0 AND 23, false)),
    mis AS (SELECT count(*) AS c FROM (SELECT fecha_opreal FROM hh WHERE hora BETWEEN 0 AND 23 GROUP BY 1 HAVING count(DISTINCT hora) < 24)),
    dup AS (SELECT count(DISTINCT fecha_opreal) AS c FROM (SELECT fecha_opreal, hora FROM hh GROUP BY 1, 2 HAVING count(*) > 1)),
    ev AS (SELECT min(fecha_opreal) AS first, max(fecha_opreal) AS last, count(*) AS records, count(DISTINCT fecha_opreal) AS d FROM hh)
    SELECT first, last, records, date_diff('day', first, last) + 1 - d AS missing, date_diff('day', first, last) + 1 = d AS complete,
      inv.c AS invalid_rows, mis.c AS days_with_missing_hours, dup.c AS days_with_duplicate_hours FROM ev, inv, mis, dup""",
)
def completeness(spark, sf_dir):
    return quality.series_check(_hours(spark, sf_dir), "fecha_opreal", "hora")


@query(
    "customer_date_completeness",
    """WITH d AS (SELECT o_custkey, min(o_orderdate)::TIMESTAMP AS first, max(o_orderdate)::TIMESTAMP AS last, count(*) AS records,
        count(DISTINCT date_trunc('day', o_orderdate)) AS days FROM orders GROUP BY 1)
    SELECT o_custkey, first, last, records, date_diff('day', first, last) + 1 - days AS missing,
      date_diff('day', first, last) + 1 = days AS complete FROM d""",
)
def customer_date_completeness(spark, sf_dir):
    return quality.date_completeness(table(spark, sf_dir, "orders"), "o_orderdate", keys=["o_custkey"])


def _delta_sql(source, key, ts):
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    return f"""d AS (SELECT DISTINCT {k}{ts} AS t FROM {source}),
    gaps AS (SELECT {k}epoch_us(t - lag(t) OVER ({part}ORDER BY t)) / 1000000.0 AS delta_seconds FROM d),
    counts AS (SELECT {k}delta_seconds, count(*) AS n FROM gaps WHERE delta_seconds > 0 GROUP BY ALL)"""


@query(
    "order_date_deltas",
    f"WITH {_delta_sql('orders', 'o_orderpriority', 'o_orderdate')} SELECT * FROM counts",
)
def order_date_deltas(spark, sf_dir):
    return granularity.delta_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate")


STEP_ROWS = ", ".join(f"({i}, '{n}', {s})" for i, (n, s) in enumerate(granularity.NAMED_STEPS))


def _step_sql(source, key, ts, digits=6):
    """Step detection; without digits the confidence stays unrounded."""
    k = f"{key}, " if key else ""
    return f"""WITH {_delta_sql(source, key, ts)},
    steps(place, name, seconds) AS (VALUES {STEP_ROWS}),
    modal AS (SELECT {k}CAST(sum(n) AS BIGINT) AS total_intervals, count(*) AS unique_deltas,
       arg_min(delta_seconds, (-n, delta_seconds)) AS modal_delta_seconds, max(n) AS matching_intervals FROM counts GROUP BY ALL),
    near AS (SELECT modal.*, arg_min(name, (abs(modal_delta_seconds - seconds), place)) AS name,
       CAST(arg_min(seconds, (abs(modal_delta_seconds - seconds), place)) AS DOUBLE) AS seconds FROM modal, steps GROUP BY ALL),
    scored AS (SELECT *, CAST(matching_intervals AS DOUBLE) / total_intervals *
       CASE WHEN abs(modal_delta_seconds - seconds) / seconds > 0.1 THEN greatest(0.1, 1 - abs(modal_delta_seconds - seconds) / seconds) ELSE 1 END AS score FROM near),
    named AS (SELECT *, CASE WHEN unique_deltas > total_intervals * 0.5 THEN score * 0.5 ELSE score END AS conf FROM scored)
    SELECT {k}CASE WHEN unique_deltas > total_intervals * 0.5 THEN 'Irregular (' || name || '-like)'
                WHEN score < 0.7 THEN 'Mixed (' || name || '-dominant)' ELSE name END AS granularity,
      {f"round(conf, {digits}) + 0.0" if digits else "conf"} AS confidence,
      CASE WHEN conf >= 0.9 THEN 'Very High' WHEN conf >= 0.7 THEN 'High' WHEN conf >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level,
      modal_delta_seconds, round(score, 6) + 0.0 AS confidence_score, total_intervals, matching_intervals, unique_deltas FROM named"""


def _step(df, keys, ts):
    out = granularity.detect_step(df, keys, ts).drop("modal_delta_text")
    return out.withColumns({c: r(F.col(c)) for c in ("confidence", "confidence_score")})


@query("granularity_orders", _step_sql("orders", "o_custkey", "o_orderdate"))
def granularity_orders(spark, sf_dir):
    return _step(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")


@query("granularity_events", _step_sql("events", "event_type", "ts"))
def granularity_events(spark, sf_dir):
    return _step(table(spark, sf_dir, "events"), ["event_type"], "ts")


@query(
    "granularity_hourly",
    _step_sql("(SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events)", "event_type", "h"),
)
def granularity_hourly(spark, sf_dir):
    hours = table(spark, sf_dir, "events").select("event_type", T.truncate("ts", "hour").alias("h"))
    return _step(hours, ["event_type"], "h")


@query(
    "common_deltas",
    f"""WITH {_delta_sql('orders', 'o_custkey', 'o_orderdate')} SELECT * FROM (
      SELECT o_custkey, delta_seconds, n, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, delta_seconds) AS rank FROM counts)
    WHERE rank <= 5""",
)
def common_deltas(spark, sf_dir):
    return granularity.common_deltas(
        table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", 5,
    ).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "step_report",
    f"""SELECT o_custkey, '**' || granularity || '** (Confidence: ' || confidence_level || ' - ' || printf('%.1f%%', confidence * 100) || ')'
      || chr(10) || '- Most common interval: ' || CAST(CAST(modal_delta_seconds AS BIGINT) // 86400 AS VARCHAR) || ' days 00:00:00'
      || chr(10) || '- ' || matching_intervals || '/' || total_intervals || ' intervals match'
      || CASE WHEN unique_deltas > 1 THEN chr(10) || '- ' || unique_deltas || ' different interval types detected' ELSE '' END AS info
    FROM ({_step_sql("orders", "o_custkey", "o_orderdate", None)})""",
)
def step_report(spark, sf_dir):
    steps = granularity.detect_step(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")
    return granularity.describe_step(steps).select("o_custkey", "info")


@query(
    "expanding_unique",
    f"""WITH {GENERATION_SQL}, firsts AS (SELECT event_id, ts, central_tipo_nemotecnico AS kind,
         CASE WHEN row_number() OVER (PARTITION BY central_tipo_nemotecnico, central_nombre ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM gen)
    SELECT event_id, """
    + ", ".join(
        f"CAST(sum(CASE WHEN kind = '{k}' THEN fresh ELSE 0 END) OVER (ORDER BY ts, event_id) AS BIGINT) AS unique_count_{k}"
        for k in KINDS
    )
    + " FROM firsts",
)
def expanding_unique(spark, sf_dir):
    rows = generation(spark, sf_dir).select("event_id", "ts", "central_tipo_nemotecnico", "central_nombre")
    out = ordering.expanding_distinct(rows, KINDS, "central_tipo_nemotecnico", "central_nombre", "ts", "event_id")
    return out.select("event_id", *[f"unique_count_{k}" for k in KINDS])


@query(
    "chrono_split",
    """WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
        count(*) OVER (PARTITION BY event_type) AS c FROM events)
    SELECT event_id, event_type, pos, CASE WHEN pos < CAST(floor(c * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM n""",
)
def chrono_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return ordering.chronological_split(rows, ["event_type"], "ts", ["event_id"]).drop("ts")


@query(
    "ts_folds",
    """WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
        count(*) OVER (PARTITION BY event_type) AS c FROM events),
    f AS (SELECT n.*, CAST(k AS INTEGER) AS fold, c - (4 - k) * (c // 5) AS start, c // 5 AS size FROM n, generate_series(0, 3) g(k))
    SELECT event_id, event_type, pos, fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role FROM f WHERE pos < start + size""",
)
def ts_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return ordering.expanding_folds(rows, ["event_type"], "ts", 4, ["event_id"]).drop("ts")


@query(
    "best_rows",
    """SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
)
def best_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.best_row(rows, "o_totalprice", ["o_custkey"])
