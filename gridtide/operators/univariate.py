"""Forecasts of many series from their own past: exponential smoothing and ARIMA.

A series of up to one chunk is fitted by one task, all series in parallel. Longer ones advance chunk by chunk in parallel
too: the recursions are affine in their state, so a pass from zero states gives each chunk's map, the maps composed give the
true states, and a second pass starts from those.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridtide.operators import scan
from gridtide.operators.series import CHUNK, fold_series, on_chunks_joined, on_chunks_with, with_size
from gridtide.operators.spectrum import _key_schema
from gridtide.session import cut_lineage

FORECAST = "h int, predicted double, predicted_lower double, predicted_upper double"
KINDS = ("add", "mul", None)


def _longest(series: DataFrame) -> int:
    return series.agg(F.max("n")).first()[0] or 0


# ---- exponential smoothing -------------------------------------------------

LATTICE = np.array([-1.0, -0.5, 0.0, 0.5, 1.0])
LATTICE_ROUNDS = 5
SHRINK = 2.2
_HW_ARRAYS = ("alphas", "betas", "gammas", "level", "slope", "season", "sse")
_HW_SCHEMA = (
    "alpha double, beta double, gamma double, radius double, rows bigint, "
    + ", ".join(f"{a} array<double>" for a in _HW_ARRAYS)
)
_HW_FITTED = "alpha double, beta double, gamma double, rows bigint, level double, slope double, season array<double>, sse double"


def _lattice(center: float, radius: float, used: bool) -> np.ndarray:
    return np.unique(np.clip(center + radius * LATTICE, 1e-4, 0.9999)) if used else np.zeros(1)


def _lattice_points(row, trend, seasonal) -> np.ndarray:
    """Parameter rows around the current best."""
    radius = row["radius"]
    axes = np.meshgrid(
        _lattice(row["alpha"], radius, True), _lattice(row["beta"], radius, trend is not None),
        _lattice(row["gamma"], radius, seasonal is not None), indexing="ij",
    )
    return np.column_stack([a.ravel() for a in axes])


def _opening(values, trend, seasonal, period):
    """First level, slope and season from the opening cycles."""
    cycle = period if seasonal else min(10, max(1, len(values) // 2))
    first, second = values[:cycle], values[cycle : 2 * cycle]
    level = first.mean()
    if trend == "add":
        slope = (second.mean() - level) / cycle if len(second) == cycle else 0.0
    elif trend == "mul":
        slope = (second.mean() / level) ** (1.0 / cycle) if len(second) == cycle and level > 0 and second.mean() > 0 else 1.0
    else:
        slope = 0.0
    if seasonal == "add":
        season = first - level
    elif seasonal == "mul":
        season = first / level if level else np.ones(period)
    else:
        season = np.zeros(1)
    return level, slope, season


def _hw_start(values, row, trend, seasonal, period):
    """Parameter lattice and first states of the sequential fold."""
    points = _lattice_points(row, trend, seasonal)
    level, slope, season = _opening(values, trend, seasonal, period)
    p = len(points)
    return {
        "alphas": points[:, 0], "betas": points[:, 1], "gammas": points[:, 2], "level": np.full(p, level), "slope": np.full(p, slope),
        "season": np.tile(season, (p, 1)).T.copy(), "sse": np.zeros(p), "rows": 0,
    }


def _hw_advance(values, row, trend, seasonal, period):
    """Smoothing recursions over one chunk for all parameter points at once."""
    if row["rows"] == 0:
        s = _hw_start(values, row, trend, seasonal, period)
    else:
        s = {a: np.array(row[a], float) for a in _HW_ARRAYS}
        s["season"] = s["season"].reshape(-1, len(s["alphas"]))
        s["rows"] = int(row["rows"])
    alpha, beta, gamma = s["alphas"], s["betas"], s["gammas"]
    level, slope, season, sse = s["level"], s["slope"], s["season"], s["sse"]
    cycle = len(season)
    with np.errstate(all="ignore"):
        for i, y in enumerate(values):
            at = (s["rows"] + i) % cycle
            now = season[at].copy()
            base = level + slope if trend == "add" else level * slope if trend == "mul" else level
            fit = base + now if seasonal == "add" else base * now if seasonal == "mul" else base
            sse = sse + (y - fit) ** 2
            bare = y - now if seasonal == "add" else y / now if seasonal == "mul" else y
            new = alpha * bare + (1 - alpha) * base
            if trend == "add":
                slope = beta * (new - level) + (1 - beta) * slope
            elif trend == "mul":
                slope = beta * (new / level) + (1 - beta) * slope
            if seasonal == "add":
                season[at] = gamma * (y - base) + (1 - gamma) * now
            elif seasonal == "mul":
                season[at] = gamma * (y / base) + (1 - gamma) * now
            level = new
    return {
        "alpha": row["alpha"], "beta": row["beta"], "gamma": row["gamma"], "radius": row["radius"],
        "rows": s["rows"] + len(values), "alphas": alpha, "betas": beta, "gammas": gamma, "level": level,
        "slope": slope, "season": season.ravel(), "sse": sse,
    }


def _hw_folded(rows: DataFrame, keys, best: DataFrame, trend, seasonal, period: int, chunk: int, rounds: int) -> DataFrame:
    """Multiplicative parts are no affine maps: they fold over the chunks one after another."""
    chunks = -(-_longest(rows) // chunk)
    empty = {a: F.lit(None).cast("array<double>") for a in _HW_ARRAYS}
    for _ in range(rounds):
        state = best.select(*keys, "alpha", "beta", "gamma", "radius", F.lit(0).cast("bigint").alias("rows"), *[
            v.alias(a) for a, v in empty.items()
        ])
        done = fold_series(rows, keys, state, lambda v, r: _hw_advance(v, r, trend, seasonal, period), _HW_SCHEMA, chunk, chunks)
        scores = F.transform("sse", lambda s: F.when(F.isnan(s), F.lit(float("inf"))).otherwise(s))
        done = done.withColumn("_at", (F.array_position(scores, F.array_min(scores)) - 1).cast("int"))
        points = F.size("alphas")
        picked = {name: F.get(F.col(a), F.col("_at")) for name, a in (("alpha", "alphas"), ("beta", "betas"), ("gamma", "gammas"))}
        season = F.transform(
            F.sequence(F.lit(0), (F.size("season") / points).cast("int") - 1),
            lambda i: F.get(F.col("season"), i * points + F.col("_at")),
        )
        best = cut_lineage(
            done.select(
                *keys, *[c.alias(n) for n, c in picked.items()], (F.col("radius") / SHRINK).alias("radius"), "rows",
                F.get("level", F.col("_at")).alias("level"), F.get("slope", F.col("_at")).alias("slope"),
                season.alias("season"), F.get("sse", F.col("_at")).alias("sse"),
            ),
        )
    return best.drop("radius")


def _hw_state(values, points, trend, seasonal, period) -> np.ndarray:
    level, slope, season = _opening(values, trend, seasonal, period)
    return np.repeat(np.concatenate([[level, slope], season])[:, None], len(points), axis=1)


def _hw_best(points, sse, state, radius, n) -> dict:
    """The best point of a lattice; the season is turned back to begin at the series' start."""
    at = int(np.argmin(np.where(np.isfinite(sse), sse, np.inf)))
    alpha, beta, gamma = points[at]
    season = np.roll(state[2:, at], n % (len(state) - 2))
    return {
        "alpha": alpha, "beta": beta, "gamma": gamma, "rows": n, "level": state[0, at], "slope": state[1, at],
        "season": season, "sse": sse[at], "radius": radius / SHRINK,
    }


def _hw_fit(values: np.ndarray, trend, seasonal, period: int, start: dict, rounds: int) -> dict:
    """All rounds of the lattice search over one series in memory."""
    row = start
    for _ in range(rounds):
        points = _lattice_points(row, trend, seasonal)
        state, sse = scan.smooth(values, points, _hw_state(values, points, trend, seasonal, period), trend == "add", seasonal == "add")
        row = _hw_best(points, sse, state, row["radius"], len(values))
    return row


def _hw_scanned(rows: DataFrame, keys, best: DataFrame, trend, seasonal, period: int, chunk: int, rounds: int) -> DataFrame:
    """Two parallel passes a round, however many chunks a series has."""
    head = _key_schema(rows, keys)
    kinds = (trend == "add", seasonal == "add")
    cycle = period if seasonal else 1
    length = scan.block_length(chunk, cycle)
    chunk = chunk // length * length
    named = ["alpha", "beta", "gamma", "radius"]
    at = "chunk int, alpha double, beta double, gamma double, radius double"

    def begin_of(frame, lo, hi, row, points):
        if frame["chunk"].iloc[0] == 0:
            return _hw_state(frame["value"].to_numpy(float)[lo:hi], points, trend, seasonal, period)
        held = row.get("begin")
        return np.zeros((cycle + 2, len(points))) if held is None else np.asarray(held, float).reshape(cycle + 2, -1)

    def advance(frame, lo, hi, row, want):
        columns = ["chunk", *named, "sse", "state", "n"]
        if frame is None:
            return pd.DataFrame(columns=columns)
        points = _lattice_points(row, trend, seasonal)
        state, sse = scan.smooth(frame["value"].to_numpy(float)[lo:hi], points, begin_of(frame, lo, hi, row, points), *kinds)
        n, last = int(frame["n"].iloc[0]), int(frame["pos"].iloc[hi - 1])
        state = state.ravel() if want == "all" or last == n - 1 else np.zeros(0)
        return pd.DataFrame([{"chunk": int(frame["chunk"].iloc[0]), **{c: row[c] for c in named}, "sse": sse, "state": state, "n": n}], columns=columns)

    passed = f"{at}, sse array<double>, state array<double>, n bigint"

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        """The state each chunk begins with, from the chunks' maps."""
        frame = frame.sort_values("chunk", ignore_index=True)
        row = frame.iloc[0]
        points = _lattice_points(row, trend, seasonal)
        with np.errstate(all="ignore"):
            carry = np.linalg.matrix_power(scan.smoothing_map(points, cycle, length, *kinds), chunk // length)
        out, state = [], None
        for _, r in frame.iterrows():
            out.append({**{c: r[c] for c in [*keys, "chunk", *named]}, "begin": np.zeros(0) if state is None else state.ravel()})
            ends = np.asarray(r["state"], float).reshape(cycle + 2, -1)
            state = ends if state is None else np.einsum("pij,jp->ip", carry, state) + ends
        return pd.DataFrame(out, columns=[*keys, "chunk", *named, "begin"])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        row = frame.iloc[-1]
        points = _lattice_points(row, trend, seasonal)
        sse = np.sum([np.asarray(x, float) for x in frame["sse"]], axis=0)
        found = _hw_best(points, sse, np.asarray(row["state"], float).reshape(cycle + 2, -1), row["radius"], int(row["n"]))
        return pd.DataFrame([{**{k: row[k] for k in keys}, **found}], columns=[*keys, *names])

    names = [f.split()[0] for f in _HW_FITTED.split(", ")] + ["radius"]
    for _ in range(rounds):
        ends = on_chunks_with(rows, keys, best.select(*keys, *named), lambda f, lo, hi, r: advance(f, lo, hi, r, "all"), passed, chunk)
        begins = cut_lineage(ends.groupBy(*keys).applyInPandas(compose, f"{head}, {at}, begin array<double>"))
        errors = on_chunks_joined(rows, keys, begins, lambda f, lo, hi, r: advance(f, lo, hi, r, "last"), passed, chunk)
        best = cut_lineage(errors.groupBy(*keys).applyInPandas(settle, f"{head}, {_HW_FITTED}, radius double"))
    return best.drop("radius")


def fit_holt_winters(
    series: DataFrame, keys, trend: str | None = "add", seasonal: str | None = "add", seasonal_periods: int = 12,
    chunk: int = CHUNK, parameters: tuple[float, float, float] | None = None,
) -> DataFrame:
    """Smoothing parameters and final states per series (M5).

    The parameters come from a lattice search: every round scores a whole lattice, then the lattice contracts around the best
    point. Given ``parameters`` (alpha, beta, gamma) are used as they are. A series of up to ``chunk`` values takes one task
    for all rounds; longer ones two passes a round, a chunk a task. Only multiplicative parts of longer series
    go through their chunks one after another.
    """
    if trend not in KINDS or seasonal not in KINDS:
        raise ValueError("trend and seasonal are 'add', 'mul' or None")
    if seasonal and seasonal_periods < 2:
        raise ValueError("a season needs at least two steps")
    keys = list(keys)
    chunk = max(chunk, 2 * seasonal_periods)
    sized = with_size(series, keys)
    rows = sized.where(F.col("n") >= (2 * seasonal_periods if seasonal else 3))
    rounds = LATTICE_ROUNDS if parameters is None else 1
    start = dict(zip(("alpha", "beta", "gamma", "radius"), (0.5, 0.5, 0.5, 0.49) if parameters is None else (*map(float, parameters), 0.0)))
    if "mul" in (trend, seasonal):
        best = rows.groupBy(*keys).agg(*[F.lit(v).alias(c) for c, v in start.items()])
        return _hw_folded(rows, keys, best, trend, seasonal, seasonal_periods, chunk, rounds)
    head = _key_schema(rows, keys)
    names = [f.split()[0] for f in _HW_FITTED.split(", ")]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("pos")["value"].to_numpy(float)
        found = _hw_fit(values, trend, seasonal, seasonal_periods, start, rounds)
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, **found}], columns=[*keys, *names])

    fitted = rows.where(F.col("n") <= chunk).select(*keys, "pos", "value").groupBy(*keys).applyInPandas(whole, f"{head}, {_HW_FITTED}")
    if _longest(rows) <= chunk:
        return fitted
    long = rows.where(F.col("n") > chunk)
    best = long.groupBy(*keys).agg(*[F.lit(v).alias(c) for c, v in start.items()])
    return fitted.unionByName(_hw_scanned(long, keys, best, trend, seasonal, seasonal_periods, chunk, rounds))


def _hw_forecast(row, trend, seasonal, period, horizon, level_of):
    h = np.arange(1, horizon + 1)
    base = row["level"] + h * row["slope"] if trend == "add" else row["level"] * row["slope"] ** h if trend == "mul" else np.full(horizon, row["level"])
    season = np.asarray(row["season"], float)
    if seasonal:
        s = season[(int(row["rows"]) + h - 1) % len(season)]
        base = base + s if seasonal == "add" else base * s
    variance = row["sse"] / max(int(row["rows"]) - 3, 1)
    reaction = row["alpha"] * (1 + h * (row["beta"] if trend else 0.0))
    if seasonal:
        reaction = reaction + row["gamma"] * (h % period == 0)
    growth = 1 + np.concatenate([[0.0], np.cumsum(reaction**2)[:-1]])
    reach = NormalDist().inv_cdf(1 - level_of / 2) * np.sqrt(variance * growth)
    return pd.DataFrame({"h": h, "predicted": base, "predicted_lower": base - reach, "predicted_upper": base + reach})


def _per_series(fitted: DataFrame, keys, forecast) -> DataFrame:
    keys = list(keys)

    def run(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                out = forecast(row)
                for i, k in enumerate(keys):
                    out.insert(i, k, [row[k]] * len(out))
                yield out

    return fitted.mapInPandas(run, f"{_key_schema(fitted, keys)}, {FORECAST}")


def forecast_holt_winters(
    fitted: DataFrame, keys, horizon: int, trend="add", seasonal="add", seasonal_periods: int = 12, alpha: float = 0.05,
) -> DataFrame:
    """Mean and (1 - alpha) interval for steps 1..horizon (M5)."""
    return _per_series(
        fitted, keys, lambda row: _hw_forecast(row, trend, seasonal, seasonal_periods, horizon, alpha),
    )


# ---- ARIMA -----------------------------------------------------------------

NEWTON_ROUNDS = 50  # at most
SHARES = (1.0, 0.5, 0.25, 0.1, 0.0)  # of the way from zero to the first guess
DAMPING = (0.0, 0.1, 1.0, 10.0)  # Levenberg-Marquardt candidates of a round; staying put is the fifth
CANDIDATES = 5
SETTLED = 1e-11  # relative gain at which a series stops
_ARIMA_FITTED = (
    "coefficients array<double>, rows bigint, tail array<double>, residuals array<double>, sse double, gradient double, variance double"
)


def _difference_polynomial(phi, d):
    """Coefficients a of y[t] = sum a[i] y[t-1-i] + ... for AR part phi and d differences."""
    poly = np.concatenate([[1.0], -np.asarray(phi, float)])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    return -poly[1:]


def _regress(parts: DataFrame, keys, width: int) -> DataFrame:
    """Least squares from summed cross products; the response is the last column."""
    keys = list(keys)
    sums = parts.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((width, width))
        gram[frame["i"], frame["j"]] = frame["v"]
        gram = gram + gram.T - np.diag(np.diag(gram))
        beta = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=None)[0] if width > 1 else np.zeros(0)
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "beta": beta}])

    return sums.groupBy(*keys).applyInPandas(solve, f"{_key_schema(parts, keys)}, beta array<double>")


def _products(x: np.ndarray) -> pd.DataFrame:
    gram = x.T @ x
    i, j = np.triu_indices(x.shape[1])
    return pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": gram[i, j]})


_EMPTY_PRODUCTS = pd.DataFrame({"i": np.zeros(0, "int32"), "j": np.zeros(0, "int32"), "v": np.zeros(0)})


def _lags(w, t, count):
    return [w[t - i] for i in range(1, count + 1)]


def _first_guess(sized: DataFrame, keys, p: int, d: int, q: int, chunk: int) -> DataFrame:
    """Two-stage regression (Hannan and Rissanen, 1982): long AR, then lags of values and residuals."""
    keys = list(keys)
    means = sized.groupBy(*keys).agg(F.avg("value").alias("mean"))
    long = max(p, q) + 12 if q else 0

    def differenced(frame, row):
        w = frame["value"].to_numpy(float) - (row["mean"] if d == 0 else 0.0)
        for _ in range(d):
            w = np.concatenate([[np.nan], np.diff(w)])
        return w

    def rows_from(frame, lo, hi, need):
        start = lo if frame["pos"].iloc[0] > 0 else max(lo, need)
        return np.arange(start, hi)

    side = means
    if q:
        def stage_one(frame, lo, hi, row):
            if frame is None:
                return _EMPTY_PRODUCTS.copy()
            w = differenced(frame, row)
            t = rows_from(frame, lo, hi, d + long)
            return _products(np.column_stack([*_lags(w, t, long), w[t]])) if len(t) else _EMPTY_PRODUCTS.copy()

        parts = on_chunks_with(sized, keys, side, stage_one, "i int, j int, v double", chunk, long + d)
        side = means.join(_regress(parts, keys, long + 1).withColumnRenamed("beta", "long"), keys)

    def stage_two(frame, lo, hi, row):
        if frame is None:
            return _EMPTY_PRODUCTS.copy()
        w = differenced(frame, row)
        t = rows_from(frame, lo, hi, d + long + max(p, q))
        if not len(t):
            return _EMPTY_PRODUCTS.copy()
        past = []
        if q:
            ar = np.asarray(row["long"], float)
            e = w.copy()
            for i, a in enumerate(ar, 1):
                e[i:] -= a * w[:-i]
            past = _lags(e, t, q)
        return _products(np.column_stack([*_lags(w, t, p), *past, w[t]]))

    if p + q == 0:
        return means.withColumn("beta", F.array().cast("array<double>"))
    parts = on_chunks_with(sized, keys, side, stage_two, "i int, j int, v double", chunk, d + long + max(p, q))
    return means.join(_regress(parts, keys, p + q + 1), keys, "left")


def _arima_need(order) -> int:
    p, d, q = order
    return d + 2 * max(p, q) + (12 if q else 0) + p + q + int(d == 0) + 5


def _guess(values: np.ndarray, order) -> np.ndarray:
    """:func:`_first_guess` of a series in memory."""
    p, d, q = order
    mean = values.mean()
    w = np.concatenate([np.full(d, np.nan), np.diff(values, d)]) if d else values - mean
    long = max(p, q) + 12 if q else 0
    past = []
    t = np.arange(d + long + max(p, q), len(w))
    if q:
        early = np.arange(d + long, len(w))
        ar = _least_squares(np.column_stack([*_lags(w, early, long), w[early]]))
        e = w.copy()
        for i, x in enumerate(ar, 1):
            e[i:] -= x * w[:-i]
        past = _lags(e, t, q)
    beta = _least_squares(np.column_stack([*_lags(w, t, p), *past, w[t]])) if p + q else np.zeros(0)
    return np.concatenate([beta, [mean] if d == 0 else []])


def _least_squares(x: np.ndarray) -> np.ndarray:
    gram = x.T @ x
    return np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=None)[0]


def _opening_moves(guess: np.ndarray, order) -> tuple[np.ndarray, np.ndarray]:
    """From no dynamics to the first guess, so that a poor guess cannot win."""
    origin = np.zeros(len(guess))
    if order[1] == 0:
        origin[-1] = guess[-1]
    return origin, np.array([(guess - origin) * share for share in SHARES])


def _next_moves(sums: np.ndarray, base: np.ndarray, moves: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, float, float]:
    """(place of the best candidate, its coefficients, Gauss-Newton moves from there, its loss, cosine of its residuals and slopes)."""
    k = len(base)
    loss = np.where(np.isfinite(sums[:, 0]), sums[:, 0], np.inf)
    at = int(np.argmin(loss))
    g, hess = sums[at, 1 : 1 + k], sums[at, 1 + k :].reshape(k, k)
    after = np.zeros((CANDIDATES, k))
    if k and np.isfinite(hess).all():
        for i, damp in enumerate(DAMPING):
            after[i] = -np.linalg.lstsq(hess + damp * np.diag(np.diag(hess)), g, rcond=None)[0]
    size = np.sqrt(np.maximum(np.diag(hess), 1e-300) * max(loss[at], 1e-300))
    return at, base + moves[at], after, float(loss[at]), float(np.max(np.abs(g) / size, initial=0.0))


def _arima_fit(values: np.ndarray, order, given=None) -> dict:
    """Coefficients and closing values of one series in memory."""
    p, d, q = order
    keep = p + d
    guess = _guess(values, order) if given is None else np.asarray(given, float)
    k = len(guess)
    base, moves = _opening_moves(guess, order) if given is None else (guess, np.zeros((1, k)))
    best = np.inf
    for _ in range(1 if given is not None else NEWTON_ROUNDS):
        done = [scan.residual_sums(values, keep, base + m, order, np.zeros((q, k + 1))) for m in moves]
        at, base, moves, loss, gradient = _next_moves(np.array([x[0] for x in done]), base, moves)
        closing = done[at][1]
        if not np.isfinite(loss) or best - loss <= SETTLED * loss:
            break
        best = loss
    return {
        "coefficients": base, "rows": len(values), "tail": values[len(values) - keep :], "residuals": closing[:, 0],
        "sse": loss, "gradient": gradient, "variance": loss / (len(values) - keep),
    }


def _arima_scanned(sized: DataFrame, keys, order, chunk: int, given=None) -> DataFrame:
    """Gauss-Newton rounds of two parallel passes (one without a moving average), however many chunks a series has."""
    p, d, q = order
    k = p + q + int(d == 0)
    width, keep = k + 1, p + d
    size = 1 + k + k * k
    count = CANDIDATES if given is None else 1
    head = _key_schema(sized, keys)
    named = ["coefficients", "moves", "best"]
    carried = "coefficients array<double>, moves array<double>, best double"
    if given is None:
        guess = _first_guess(sized, keys, p, d, q, chunk)

        def opened(frames):
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    beta = np.zeros(p + q) if row["beta"] is None else np.asarray(row["beta"], float)
                    base, moves = _opening_moves(np.concatenate([beta, [row["mean"]] if d == 0 else []]), order)
                    out.append({**{c: row[c] for c in keys}, "coefficients": base, "moves": moves.ravel(), "best": np.inf})
                yield pd.DataFrame(out, columns=[*keys, *named])

        state = guess.mapInPandas(opened, f"{head}, {carried}")
    else:
        fixed = [F.array(*[F.lit(float(x)) for x in given]) if len(given) else F.array().cast("array<double>"), F.array_repeat(F.lit(0.0), k), F.lit(float("inf"))]
        state = sized.select(*keys).distinct().select(*keys, *[c.alias(n) for c, n in zip(fixed, named)])
    kinds = f"chunk int, {carried}, rows bigint, sums array<double>, after array<double>, tail array<double>, n bigint"

    def candidates(row) -> np.ndarray:
        return np.asarray(row["coefficients"], float) + np.asarray(row["moves"], float).reshape(count, k)

    def advance(frame, lo, hi, row):
        columns = [f.split()[0] for f in kinds.split(", ")]
        if frame is None:
            return pd.DataFrame(columns=columns)
        y = frame["value"].to_numpy(float)[max(0, lo - keep) : hi]
        held = row.get("begin")
        begins = np.zeros((count, q, width)) if held is None or not len(held) else np.asarray(held, float).reshape(count, q, width)
        done = [scan.residual_sums(y, keep, theta, order, begin) for theta, begin in zip(candidates(row), begins)]
        return pd.DataFrame(
            [{
                "chunk": int(frame["chunk"].iloc[0]), **{c: row[c] for c in named}, "rows": len(y) - keep, "sums": np.concatenate([x[0] for x in done]),
                "after": np.concatenate([x[1].ravel() for x in done]), "tail": y[len(y) - keep :], "n": int(frame["n"].iloc[0]),
            }], columns=columns,
        )

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        """The residuals and slopes each chunk begins with, from the chunks' maps."""
        frame = frame.sort_values("chunk", ignore_index=True)
        thetas = candidates(frame.iloc[0])
        maps: dict[int, list] = {}
        out, state = [], np.zeros((count, q * width))
        for _, r in frame.iterrows():
            out.append({**{c: r[c] for c in [*keys, "chunk", *named]}, "begin": state.ravel()})
            steps = int(r["rows"])
            if steps not in maps:
                maps[steps] = [scan.residual_map(theta, order, steps) for theta in thetas]
            with np.errstate(all="ignore"):
                state = np.array([m @ x for m, x in zip(maps[steps], state)]) + np.asarray(r["after"], float).reshape(count, -1)
        return pd.DataFrame(out, columns=[*keys, "chunk", *named, "begin"])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        row = frame.iloc[-1]
        sums = np.sum([np.asarray(x, float) for x in frame["sums"]], axis=0).reshape(count, size)
        at, base, moves, loss, gradient = _next_moves(sums, np.asarray(row["coefficients"], float), np.asarray(row["moves"], float).reshape(count, k))
        closing = np.asarray(row["after"], float).reshape(count, q, width)[at, :, 0]
        found = {"coefficients": base, "rows": row["n"], "tail": row["tail"], "residuals": closing, "sse": loss, "gradient": gradient, "variance": loss / (row["n"] - keep)}
        settled = not np.isfinite(loss) or row["best"] - loss <= SETTLED * loss
        more = {"moves": moves.ravel() * (not settled), "best": loss, "settled": settled}
        return pd.DataFrame([{**{c: row[c] for c in keys}, **found, **more}], columns=[*keys, *found, *more])

    chosen = None
    for _ in range(NEWTON_ROUNDS if given is None else 1):
        side = state.select(*keys, *named)
        passed = on_chunks_with(sized, keys, side, advance, kinds, chunk, keep)
        if q:
            begins = cut_lineage(passed.groupBy(*keys).applyInPandas(compose, f"{head}, chunk int, {carried}, begin array<double>"))
            passed = on_chunks_joined(sized, keys, begins, advance, kinds, chunk, keep)
        chosen = cut_lineage(passed.groupBy(*keys).applyInPandas(settle, f"{head}, {_ARIMA_FITTED}, moves array<double>, best double, settled boolean"))
        if chosen.where(~F.col("settled")).isEmpty():
            break
        state = chosen
    return chosen.drop("moves", "best", "settled")


def fit_arima(
    series: DataFrame, keys, order: tuple[int, int, int] = (1, 1, 1), chunk: int = CHUNK, coefficients=None,
) -> DataFrame:
    """Conditional least squares ARIMA per series (M6): coefficients, variance and closing values.

    Starts from a two-stage regression, then refines by damped Gauss-Newton. Without differencing a mean is fitted. Given
    ``coefficients`` (autoregressive, moving average, mean) are used as they are. ``gradient`` is the largest cosine
    between the residuals and their derivative by a coefficient: zero at the least squares solution. A series of up to ``chunk``
    values is fitted by one task; longer ones in parallel passes over their chunks.
    """
    p, d, q = order
    if min(order) < 0:
        raise ValueError("orders cannot be negative")
    if coefficients is not None and len(coefficients) != p + q + int(d == 0):
        raise ValueError("one coefficient for each lag, and the mean without differencing")
    keys = list(keys)
    chunk = max(chunk, 4 * (p + d + q + 16))
    sized = with_size(series, keys).where(F.col("n") >= _arima_need(order))
    head = _key_schema(sized, keys)
    names = [f.split()[0] for f in _ARIMA_FITTED.split(", ")]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        found = _arima_fit(frame.sort_values("pos")["value"].to_numpy(float), order, coefficients)
        return pd.DataFrame([{**{c: frame[c].iloc[0] for c in keys}, **found}], columns=[*keys, *names])

    fitted = sized.where(F.col("n") <= chunk).select(*keys, "pos", "value").groupBy(*keys).applyInPandas(whole, f"{head}, {_ARIMA_FITTED}")
    if _longest(sized) <= chunk:
        return fitted
    return fitted.unionByName(_arima_scanned(sized.where(F.col("n") > chunk), keys, order, chunk, coefficients))


def _arima_forecast(row, order, horizon, alpha):
    p, d, q = order
    theta = np.asarray(row["coefficients"], float)
    ar, ma = theta[:p], theta[p : p + q]
    shift = theta[-1] if d == 0 else 0.0
    full = _difference_polynomial(ar, d)
    past = list(np.asarray(row["tail"], float) - shift)
    shocks = list(np.asarray(row["residuals"], float)[::-1])  # the latest last
    mean, psi = [], [1.0]
    for h in range(1, horizon + 1):
        value = sum(a * past[-i] for i, a in enumerate(full, 1))
        value += sum(m * shocks[-(j - h + 1)] for j, m in enumerate(ma, 1) if j >= h)
        past.append(value)
        mean.append(value + shift)
        weight = sum(a * psi[h - i] for i, a in enumerate(full, 1) if i <= h)
        psi.append(weight + (ma[h - 1] if h <= q else 0.0))
    spread = np.sqrt(row["variance"] * np.cumsum(np.square(psi[:horizon])))
    reach = NormalDist().inv_cdf(1 - alpha / 2) * spread
    mean = np.array(mean)
    return pd.DataFrame({
        "h": np.arange(1, horizon + 1), "predicted": mean, "predicted_lower": mean - reach, "predicted_upper": mean + reach,
    })


def forecast_arima(fitted: DataFrame, keys, order, horizon: int, alpha: float = 0.05) -> DataFrame:
    """Mean and (1 - alpha) interval for steps 1..horizon (M6)."""
    return _per_series(fitted, keys, lambda row: _arima_forecast(row, order, horizon, alpha))


# ---- the model protocol ----------------------------------------------------


class _OwnPast:
    """Univariate model in the shape of the regression models; only the target is used."""

    needs_scaling = False
    supports_grid = True
    supports_attribution = False

    def fit(self, train: DataFrame, features, target: str):
        self.features = []
        series = train.select(F.lit(0).alias("s"), "pos", F.col(target).cast("double").alias("value"))
        low = series.agg(F.min("pos"), F.max("pos")).first()
        self.offset, self.last = int(low[0]), int(low[1])
        self.state = self._fit(series.withColumn("pos", F.col("pos") - self.offset)).first()
        if self.state is None:
            raise ValueError("the series is too short for the model")
        self.state = {k: v for k, v in self.state.asDict().items() if k != "s"}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Forecasts for rows after the training rows, matched by position."""
        horizon = int((df.agg(F.max("pos")).first()[0] or self.last) - self.last)
        table = self.forecast(df.sparkSession, max(horizon, 1))
        steps = table.withColumn("pos", F.col("h") + F.lit(self.last).cast("bigint")).drop("h")
        return df.join(steps, "pos", "left")

    def forecast(self, spark, horizon: int) -> DataFrame:
        seed = spark.range(1).select(F.lit(0).alias("s"))
        state = self.state
        return _per_series(seed, ["s"], lambda row: self._rows(state, horizon)).drop("s")

    def importance(self, spark) -> DataFrame:
        return spark.createDataFrame([], "feature string, importance double")


class HoltWinters(_OwnPast):
    """Triple exponential smoothing (M5)."""

    def __init__(self, trend="add", seasonal="add", seasonal_periods=12, alpha=0.05):
        self.trend, self.seasonal, self.seasonal_periods, self.alpha = trend, seasonal, seasonal_periods, alpha

    def _fit(self, series):
        return fit_holt_winters(series, ["s"], self.trend, self.seasonal, self.seasonal_periods)

    def _rows(self, state, horizon):
        return _hw_forecast(state, self.trend, self.seasonal, self.seasonal_periods, horizon, self.alpha)


class Arima(_OwnPast):
    """ARIMA(p, d, q) (M6)."""

    def __init__(self, order=(1, 1, 1), alpha=0.05):
        self.order, self.alpha = tuple(order), alpha

    def _fit(self, series):
        return fit_arima(series, ["s"], self.order)

    def _rows(self, state, horizon):
        return _arima_forecast(state, self.order, horizon, self.alpha)


def _setting_error(values: np.ndarray, cut: int, setting: dict, name: str) -> float | None:
    """Mean squared error of the forecasts for ``values[cut:]`` made from those before; None if they are too few."""
    if name == "arima":
        order = tuple(setting["order"])
        if cut < _arima_need(order):
            return None
        table = _arima_forecast(_arima_fit(values[:cut], order), order, len(values) - cut, 0.05)
    else:
        trend, seasonal, period = setting.get("trend", "add"), setting.get("seasonal", "add"), setting.get("seasonal_periods", 12)
        if cut < (2 * period if seasonal else 3):
            return None
        start = {"alpha": 0.5, "beta": 0.5, "gamma": 0.5, "radius": 0.49}
        table = _hw_forecast(_hw_fit(values[:cut], trend, seasonal, period, start, LATTICE_ROUNDS), trend, seasonal, period, len(values) - cut, 0.05)
    error = float(np.mean((values[cut:] - table["predicted"].to_numpy()) ** 2))
    return error if np.isfinite(error) else None


def grid_forecasts(series: DataFrame, keys, settings: list[dict], name: str, test_size: float = 0.2, chunk: int = CHUNK) -> DataFrame:
    """Best setting per series by mean squared error on its last rows (M11), and that error.

    The setting is a further key: one job fits all series of up to ``chunk`` values with all settings. Longer series, and
    multiplicative parts, take a fit of their own per setting. A setting whose fit is impossible is left out.
    """
    keys = list(keys)
    sized = with_size(series, keys).withColumn("_cut", (F.col("n") * F.lit(1 - test_size)).cast("bigint"))
    together = [i for i, s in enumerate(settings) if "mul" not in (s.get("trend"), s.get("seasonal"))]
    in_memory = F.col("n") <= chunk
    head = _key_schema(sized, keys)

    def error(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("pos")["value"].to_numpy(float)
        at = int(frame["at"].iloc[0])
        mse = _setting_error(values, int(frame["_cut"].iloc[0]), settings[at], name)
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "mse": mse, "setting": str(settings[at])}], columns=[*keys, "mse", "setting"]).astype({"mse": float})

    spread = sized.where(in_memory).withColumn("at", F.explode(F.array(*map(F.lit, together)) if together else F.array().cast("array<int>")))
    table = spread.select(*keys, "at", "_cut", "pos", "value").groupBy(*keys, "at").applyInPandas(error, f"{head}, mse double, setting string")
    longest = _longest(sized)
    for i, s in enumerate(settings):
        own = sized.where(~in_memory) if i in together else sized
        if i in together and longest <= chunk:
            continue
        train = own.where(F.col("pos") < F.col("_cut")).withColumn("n", F.col("_cut"))
        test = own.where(F.col("pos") >= F.col("_cut"))
        horizon = int(test.agg(F.max(F.col("pos") - F.col("_cut") + 1)).first()[0] or 0)
        if not horizon:
            continue
        if name == "arima":
            steps = forecast_arima(fit_arima(train, keys, s["order"], chunk), keys, s["order"], horizon)
        else:
            steps = forecast_holt_winters(fit_holt_winters(train, keys, **s, chunk=chunk), keys, horizon, **s)
        joined = test.withColumn("h", (F.col("pos") - F.col("_cut") + 1).cast("int")).join(steps, [*keys, "h"])
        mse = F.avg((F.col("value") - F.col("predicted")) * (F.col("value") - F.col("predicted")))
        table = table.unionByName(joined.groupBy(*keys).agg(mse.alias("mse")).withColumn("setting", F.lit(str(s))))
    table = table.where(F.col("mse").isNotNull() & ~F.isnan("mse"))
    return table.groupBy(*keys).agg(F.min_by("setting", "mse").alias("setting"), F.min("mse").alias("mse"))


def load(meta: dict, path: str, spark):
    """Univariate model from its bundle metadata."""
    if meta["kind"] == "HoltWinters":
        params = {k: meta["params"][k] for k in ("trend", "seasonal", "seasonal_periods", "alpha")}
        model = HoltWinters(**params)
    else:
        model = Arima(meta["params"]["order"], meta["params"]["alpha"])
    model.features, model.state = [], meta["state"]
    model.offset, model.last = meta["params"]["offset"], meta["params"]["last"]
    return model
