"""Linear models solved from cross products, which one pass over the rows adds up.

Cross products of rows in time order are kept per segment between fold bounds. Their running sums are the cross products
of every expanding training set, so all folds and all penalties are solved without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FLAT = 1e-10  # a deviation below this share of the values counts as none
SWEEPS = 10_000
STILL = 1e-13


@dataclass
class LinearFit:
    """Weights of standardised features; a prediction is ``intercept`` plus weights times (x - center) / scale."""

    weights: np.ndarray
    centers: np.ndarray
    scales: np.ndarray
    intercept: float


def _filled(rows: DataFrame, features, target: str) -> tuple[DataFrame, np.ndarray]:
    """Rows with a target, and the means that cross products are taken about."""
    rows = rows.where(F.col(target).isNotNull())
    names = [*features, target]
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(features)]).first()
    lacking = [c for i, c in enumerate(features) if means[f"z{i}"]]
    if lacking:
        raise ValueError(f"null features: {', '.join(lacking)}")
    return rows, np.array([means[f"m{i}"] or 0.0 for i in range(len(names))])


def _values(batch: pa.RecordBatch, shift: np.ndarray) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(shift))]) - shift


def cross_products(rows: DataFrame, features, target: str, shift: np.ndarray, segment: Column | None = None) -> dict[int, np.ndarray]:
    """Sums of products of (1, features, target) less ``shift``, by segment.

    Tasks add up their rows; of every segment one number a pair of columns is shuffled per task, and one reaches the driver.
    """
    width = len(features) + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _values(batch, shift)])
            of = batch.column(width - 1).to_numpy(zero_copy_only=False)
            for s in np.unique(of).tolist():
                part = x[of == s]
                found[s] = found.get(s, 0.0) + part.T @ part
        for s, gram in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([gram.ravel()], pa.list_(pa.float64()))], names=["segment", "gram"])

    columns = [F.col(c).cast("double") for c in (*features, target)]
    sums = rows.select(*columns, (F.lit(0) if segment is None else segment).cast("int").alias("segment_")).mapInArrow(add, "segment int, gram array<double>")
    sums = sums.select("segment", F.posexplode("gram").alias("at", "v")).groupBy("segment", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["segment"], np.zeros(width * width))[r["at"]] = r["v"]
    return {s: g.reshape(width, width) for s, g in out.items()}


def descend(gram: np.ndarray, pull: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coordinate descent on half the mean squared error with penalties ``l1`` |w| and ``l2`` w ** 2 / 2."""
    w = np.zeros(len(pull))
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] + l2 <= 0:
                continue
            rho = pull[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (gram[j, j] + l2)
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most <= STILL * np.max(np.abs(w), initial=1e-300):
            break
    return w


def solve(gram: np.ndarray, shift: np.ndarray, kind: str, alpha: float, l1_ratio: float) -> LinearFit:
    """The fit to rows with these cross products; constant features get weight zero."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    spread = gram[1:, 1:] / n - np.outer(mean, mean)
    center = shift + mean
    deviation = np.sqrt(np.maximum(np.diag(spread), 0.0))
    used = deviation > FLAT * np.abs(center)
    scale = np.where(used, deviation, 1.0)
    z = spread[:-1, :-1] / np.outer(scale[:-1], scale[:-1]) * np.outer(used[:-1], used[:-1])
    pull = spread[:-1, -1] / scale[:-1] * used[:-1]
    if kind == "ridge":
        weights = np.linalg.lstsq(z + alpha / n * np.eye(len(pull)), pull, rcond=None)[0]
    else:
        share = 1.0 if kind == "lasso" else l1_ratio
        weights = descend(z, pull, alpha * share, alpha * (1 - share))
    return LinearFit(weights, center[:-1], scale[:-1], float(center[-1]))


def fit(rows: DataFrame, features, target: str, kind: str, alpha: float, l1_ratio: float) -> LinearFit:
    """One fit, from one pass over the rows after that for the means. Rows without target are left out."""
    rows, shift = _filled(rows, features, target)
    grams = cross_products(rows, features, target, shift)
    if not grams:
        raise ValueError("no training rows")
    return solve(grams[0], shift, kind, alpha, l1_ratio)


def predicted(found: LinearFit, features) -> Column:
    out = F.lit(float(found.intercept))
    for part in parts(found, features):
        out = out + part
    return out


def parts(found: LinearFit, features) -> list[Column]:
    """What each feature adds to a prediction."""
    return [(F.col(f) - F.lit(float(c))) * F.lit(float(w / s)) for f, w, c, s in zip(features, found.weights, found.centers, found.scales)]


def fold_scores(frame: DataFrame, features, target: str, settings: list[tuple[str, float, float]], bounds: list[tuple[int, int]]) -> list[tuple[int, int, dict]]:
    """(setting, fold, mse, mae and r2) of every (kind, alpha, l1_ratio) on every expanding fold, in three passes whatever their number.

    ``frame`` has a position ``pos``; ``bounds`` are the first and the last but one position of each fold's test rows, one fold after another.
    """
    rows, shift = _filled(frame, features, target)
    starts = [begin for begin, _ in bounds]
    segment = sum((F.col("pos") >= b).cast("int") for b in starts)
    grams = cross_products(rows.where(F.col("pos") < starts[-1]), features, target, shift, segment)
    width = len(features) + 2
    running, fits = np.zeros((width, width)), []
    for fold in range(len(bounds)):
        running = running + grams.get(fold, 0.0)
        if not running[0, 0]:
            raise ValueError("a fold without training rows")
        fits.append([solve(running, shift, *s) for s in settings])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _values(batch, shift)
            of = batch.column(width - 1).to_numpy(zero_copy_only=False)
            out = []
            for fold in np.unique(of).tolist():
                own = x[of == fold]
                y = own[:, -1]
                for s, found in enumerate(fits[fold]):
                    e = y + shift[-1] - found.intercept - (own[:, :-1] + shift[:-1] - found.centers) @ (found.weights / found.scales)
                    out.append((s, fold, len(e), np.abs(e).sum(), e @ e, y.sum(), y @ y, y.min(), y.max()))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, sums, strict=True)], schema=sums)

    sums = pa.schema([("setting", pa.int32()), ("fold", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in ("off", "square", "y", "yy", "low", "high"))])
    tested = rows.where((F.col("pos") >= starts[0]) & (F.col("pos") < bounds[-1][1]))
    columns = [F.col(c).cast("double") for c in (*features, target)]
    kinds = "setting int, fold int, n long, off double, square double, y double, yy double, low double, high double"
    scored = tested.select(*columns, (segment - 1).cast("int").alias("fold_")).mapInArrow(score, kinds)
    merged = scored.groupBy("setting", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "off", "square", "y", "yy")], F.min("low").alias("low"), F.max("high").alias("high"))
    out = []
    for r in sorted(merged.collect(), key=lambda r: (r["setting"], r["fold"])):
        n, mse = r["n"], r["square"] / r["n"]
        spread = r["yy"] / n - (r["y"] / n) ** 2
        r2 = None if n < 2 else float(mse == 0) if r["low"] == r["high"] else 1 - mse / spread
        out.append((r["setting"], r["fold"], {"mse": mse, "mae": r["off"] / n, "r2": r2}))
    return out
