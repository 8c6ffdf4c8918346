"""SQL text of the seasonal-trend method, the twin of the decomposition queries.

Every local line is fitted from weighted sums over a self-join, with the tricube weight spelled out in
SQL, so the text shares neither code nor weights with the operators.
"""

from __future__ import annotations

ROUNDS = 5


def _fit(name: str, source: str, window: int, beyond: int = 0) -> str:
    """Local lines through ``source`` (s, g, x, y, n, r) at x from -beyond to n - 1 + beyond, as (s, g, t, v).

    ``r`` are further weights; where all are zero a point keeps its value, and one beyond the data is null.
    """
    return f"""
    {name} AS MATERIALIZED (
      SELECT s, g, t, coalesce(c / nullif(m, 0) - CASE WHEN sqrt(greatest(b / m - (a / m) * (a / m), 0)) > 0.001 * (n - 1)
        THEN a / m * (d / m - a / m * c / m) / (b / m - (a / m) * (a / m)) ELSE 0 END, own) AS v
      FROM (
        SELECT s, g, t, n, max(y) FILTER (WHERE u = 0) AS own, sum(w) AS m, sum(w * u) AS a, sum(w * u * u) AS b, sum(w * y) AS c, sum(w * u * y) AS d
        FROM (
          SELECT p.s, p.g, t, p.n, x - t AS u, y,
            r * CASE WHEN abs(x - t) <= 0.001 * h THEN 1.0 WHEN abs(x - t) > 0.999 * h THEN 0.0
                 ELSE pow(1 - pow(abs(x - t) / CAST(h AS DOUBLE), 3), 3) END AS w
          FROM (SELECT *, greatest(t - l, l + k - 1 - t) + CASE WHEN {window} > n THEN ({window} - n) // 2 ELSE 0 END AS h
                FROM (SELECT *, greatest(0, least(least(greatest(t, 0), n - 1) - (k - 1) // 2, n - k)) AS l
                      FROM (SELECT s, g, n, least({window}, n) AS k, unnest(generate_series(-{beyond}, n - 1 + {beyond})) AS t
                            FROM (SELECT DISTINCT s, g, n FROM {source})))) p
          JOIN {source} q ON p.s = q.s AND p.g = q.g AND q.x BETWEEN p.l AND p.l + p.k - 1)
        GROUP BY ALL))"""


def stl_parts(
    name: str, source: str, period: int, seasonal: int, trend: int, rounds: int = ROUNDS, start: str = "0.0 AS trend, 1.0 AS r",
) -> list[str]:
    """CTEs that end in ``name`` (s, pos, y, n, season, trend) for ``source`` (s, pos, y, n)."""
    low = period + 1 if period % 2 == 0 else period + 2
    parts, last = [], f"{name}_0"
    parts.append(f"{last} AS MATERIALIZED (SELECT s, pos, y, n, 0.0 AS season, {start} FROM {source})")
    for turn in range(1, rounds + 1):
        t = f"{name}_{turn}"
        parts += [
            f"""{t}_phases AS MATERIALIZED (SELECT s, pos % {period} AS g, pos // {period} AS x, y - trend AS y,
              (n - pos % {period} + {period - 1}) // {period} AS n, r FROM {last})""",
            _fit(f"{t}_cycles", f"{t}_phases", seasonal, 1),
            f"""{t}_cycle AS MATERIALIZED (SELECT s, (t + 1) * {period} + g AS p, coalesce(v, CASE WHEN t < 0 THEN lead(v) OVER line ELSE lag(v) OVER line END) AS v
              FROM {t}_cycles WINDOW line AS (PARTITION BY s, g ORDER BY t))""",
            *[
                f"""{t}_mean{i} AS MATERIALIZED (SELECT s, p, avg(v) OVER (PARTITION BY s ORDER BY p ROWS BETWEEN CURRENT ROW
                  AND {width - 1} FOLLOWING) AS v FROM {before})"""
                for i, (before, width) in enumerate([(f"{t}_cycle", period), (f"{t}_mean0", period), (f"{t}_mean1", 3)])
            ],
            f"{t}_lows AS MATERIALIZED (SELECT m.s, 0 AS g, p AS x, v AS y, n, 1.0 AS r FROM {t}_mean2 m JOIN {last} l ON m.s = l.s AND m.p = l.pos)",
            _fit(f"{t}_low", f"{t}_lows", low),
            f"""{t}_season AS MATERIALIZED (SELECT l.s, 0 AS g, pos AS x, l.y - (c.v - w.v) AS y, n, r, c.v - w.v AS season, l.y AS whole
              FROM {last} l JOIN {t}_cycle c ON c.s = l.s AND c.p = l.pos + {period} JOIN {t}_low w ON w.s = l.s AND w.t = l.pos)""",
            _fit(f"{t}_trend", f"{t}_season", trend),
            f"""{t} AS MATERIALIZED (SELECT a.s, x AS pos, whole AS y, n, r, season, v AS trend
              FROM {t}_season a JOIN {t}_trend b ON a.s = b.s AND a.x = b.t)""",
        ]
        last = t
    parts.append(f"{name} AS MATERIALIZED (SELECT s, pos, y, n, season, trend FROM {last})")
    return parts


def robust_parts(name: str, source: str, period: int, seasonal: int, trend: int, rounds: int, turns: int) -> list[str]:
    """Like ``stl_parts`` with ``turns`` rounds of weights from the residuals."""
    parts, last = stl_parts(f"{name}_0", source, period, seasonal, trend, rounds), f"{name}_0"
    for turn in range(1, turns + 1):
        t = f"{name}_{turn}"
        parts += [
            f"{t}_away AS MATERIALIZED (SELECT *, abs(y - season - trend) AS e FROM {last})",
            f"""{t}_in AS MATERIALIZED (SELECT s, pos, y, n, trend, CASE WHEN h = 0 OR e <= 0.001 * h THEN 1.0 WHEN e > 0.999 * h THEN 0.0
              ELSE pow(1 - (e / h) * (e / h), 2) END AS r
              FROM {t}_away JOIN (SELECT s, 6 * median(e) AS h FROM {t}_away GROUP BY 1) USING (s))""",
            *stl_parts(t, f"{t}_in", period, seasonal, trend, rounds, "trend, r"),
        ]
        last = t
    parts.append(f"{name} AS MATERIALIZED (SELECT * FROM {last})")
    return parts


def mstl_parts(name: str, source: str, settings: list[tuple[int, int, int]]) -> list[str]:
    """CTEs that end in ``name`` (s, pos, rest, trend, season_{period}...): two sweeps over ascending periods."""
    names = [f"season_{p}" for p, _, _ in settings]
    zeros = ", ".join(f"0.0 AS {c}" for c in names)
    parts, last = [f"{name}_start AS MATERIALIZED (SELECT s, pos, n, y AS rest, 0.0 AS trend, {zeros} FROM {source})"], f"{name}_start"
    for sweep in range(2):
        for (period, seasonal, trend), own in zip(settings, names):
            t = f"{name}_{sweep}_{period}"
            others = "".join(f", l.{c}" for c in names if c != own)
            parts.append(f"{t}_in AS MATERIALIZED (SELECT s, pos, n, rest + {own} AS y FROM {last})")
            parts += stl_parts(f"{t}_out", f"{t}_in", period, seasonal, trend)
            parts.append(f"""{t} AS MATERIALIZED (SELECT l.s, l.pos, l.n, o.y - o.season AS rest, o.trend, o.season AS {own}{others}
              FROM {last} l JOIN {t}_out o ON l.s = o.s AND l.pos = o.pos)""")
            last = t
    parts.append(f"{name} AS MATERIALIZED (SELECT * FROM {last})")
    return parts
