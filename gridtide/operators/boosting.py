"""Boosted regression trees from mergeable gradient histograms.

Features are cut into bins once. A tree grows from sums of gradients, second derivatives and rows per node, feature and bin; these
add up over tasks, so what leaves a task depends on nodes, features and bins, never on rows. The three
families grow differently: level by level, best leaf first, or with one split for a whole level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridtide.operators.quantiles import exact_quantiles
from gridtide.session import cut_lineage

BINS = 256
IN_MEMORY = 200_000  # training rows that one task fits by itself
CUT_EVERY = 10  # rounds between stored fits
LEAST_GAIN = 1e-9  # of what the finest split of the root would save


@dataclass
class Family:
    growth: str
    pull: float  # added to the second derivatives
    least_rows: int
    most_leaves: int | None = None


FAMILIES = {"xgboost": Family("level", 1.0, 1), "lightgbm": Family("leaf", 0.0, 20, 31), "catboost": Family("symmetric", 3.0, 1)}


@dataclass
class Trees:
    """An ensemble as one table of nodes: a leaf has feature -1, ``left`` and ``right`` are places in the table."""

    start: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add_node(self) -> int:
        for column, empty in zip((self.feature, self.bin, self.threshold, self.left, self.right, self.value, self.gain), (-1, -1, 0.0, -1, -1, 0.0, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, threshold: float, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.threshold[node], self.gain[node] = feature, at, threshold, gain
        self.left[node], self.right[node] = self.add_node(), self.add_node()
        return self.left[node], self.right[node]

    def leaves_of(self, x: np.ndarray, binned: bool = False, since: int = 0) -> np.ndarray:
        """Node of every row in every tree from ``since`` on; all trees step down together."""
        feature, left, right = (np.array(c, int) for c in (self.feature, self.left, self.right))
        limit = np.array(self.bin if binned else self.threshold)
        node = np.tile(np.array(self.roots[since:], int), (len(x), 1))
        row = np.arange(len(x))[:, None]
        while node.size:
            at = feature[node]
            inner = at >= 0
            if not inner.any():
                break
            low = x[row, np.maximum(at, 0)] <= limit[node]  # a missing value goes right
            node = np.where(inner, np.where(low, left[node], right[node]), node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + np.array(self.value)[self.leaves_of(x)].sum(axis=1) if self.roots else np.full(len(x), self.start)

    def importances(self, features: int) -> np.ndarray:
        total = np.bincount(np.maximum(self.feature, 0), np.where(np.array(self.feature) >= 0, self.gain, 0.0), features) if self.feature else np.zeros(features)
        return total / total.sum() if total.sum() else total

    def to_json(self) -> dict:
        return asdict(self)


Histograms = Callable[[Trees, list[int]], np.ndarray]


def histograms_of(bins: np.ndarray, slope: np.ndarray, node: np.ndarray, wanted: list[int]) -> np.ndarray:
    """Gradient sums and rows, wanted x features x bins x 2."""
    out = np.zeros((len(wanted), bins.shape[1], BINS, 2))
    for i, w in enumerate(wanted):
        own = node == w
        for f in range(bins.shape[1]):
            at = bins[own, f]
            out[i, f, :, 0] = np.bincount(at, slope[own], BINS)
            out[i, f, :, 1] = np.bincount(at, minlength=BINS)
    return out


def _gains(h: np.ndarray, family: Family) -> np.ndarray:
    """Loss saved by each split of a node, features x bins; impossible ones are -inf."""
    low = np.cumsum(h, axis=1)
    whole = low[:, -1:, :]
    high = whole - low

    def score(s):
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + family.pull, 1e-300)

    gain = score(low) + score(high) - score(whole)
    possible = (low[..., 1] >= family.least_rows) & (high[..., 1] >= family.least_rows)
    return np.where(possible, gain, -np.inf)


def grow(trees: Trees, histograms: Histograms, cuts: list[np.ndarray], family: Family, max_depth: int) -> list[int]:
    """Adds one tree; its leaves. ``histograms`` is asked once a level, by best leaf first once a split."""
    root = trees.add_node()
    trees.roots.append(root)
    known = {root: histograms(trees, [root])[0]}
    g, n = known[root][..., 0], known[root][..., 1]
    least = LEAST_GAIN * float((g**2 / np.maximum(n, 1.0)).sum(axis=1).max())
    depth, leaves = {root: 0}, [root]

    def best(node: int) -> tuple[float, int, int]:
        gain = _gains(known[node], family)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return float(gain[f, b]), int(f), int(b)

    def divide(node: int, gain: float, f: int, b: int) -> tuple[int, int]:
        pair = trees.split(node, f, b, float(cuts[f][b]), gain)
        leaves.remove(node)
        leaves.extend(pair)
        depth.update(dict.fromkeys(pair, depth[node] + 1))
        return pair

    def complete(pairs: list[tuple[int, int, int]]) -> None:
        """Histograms of new children: the left by a pass, the right as what is left of the parent."""
        for (parent, low, high), h in zip(pairs, histograms(trees, [p[1] for p in pairs]) if pairs else []):
            known[low], known[high] = h, known[parent] - h

    if family.growth == "level":
        frontier = [root]
        for _ in range(max_depth):
            pairs = []
            for node in frontier:
                gain, f, b = best(node)
                if gain > least:
                    pairs.append((node, *divide(node, gain, f, b)))
            frontier = [n for p in pairs for n in p[1:]]
            if not frontier or depth[frontier[0]] == max_depth:
                break
            complete(pairs)
    elif family.growth == "symmetric":
        frontier = [root]
        for level in range(max_depth):
            each = np.array([_gains(known[n], family) for n in frontier])
            total = np.where(np.isfinite(each), each, 0.0).sum(axis=0)
            f, b = np.unravel_index(int(np.argmax(total)), total.shape)
            if total[f, b] <= least:
                break
            pairs = [(n, *divide(n, max(0.0, float(e[f, b])) if np.isfinite(e[f, b]) else 0.0, int(f), int(b))) for n, e in zip(frontier, each)]
            frontier = [n for p in pairs for n in p[1:]]
            if level + 1 < max_depth:
                complete(pairs)
    else:
        open_ = [(*best(root), root)]
        while open_ and len(leaves) < (family.most_leaves or 1 << max_depth):
            gain, f, b, node = max(open_, key=lambda o: (o[0], -o[3]))
            open_ = [o for o in open_ if o[3] != node]
            if gain <= least:
                break
            pair = divide(node, gain, f, b)
            if depth[pair[0]] < max_depth:
                complete([(node, *pair)])
                open_ += [(*best(n), n) for n in pair]
    return leaves


def bin_cuts(rows: DataFrame, features, accuracy: float = 1e-4) -> list[np.ndarray]:
    """Cut points of each feature: its values but the largest if they are few, else quantiles from a mergeable sketch.

    Missing values share the last bin with what lies above all cuts.
    """
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    found = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), [0.0, *shares, 1.0], accuracy)
    return [np.unique(np.array(q, float))[:-1] if q else np.zeros(0) for q in found]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.int32)


def _slopes(y: np.ndarray, fit: np.ndarray, quantile: float | None) -> np.ndarray:
    return fit - y if quantile is None else np.where(y > fit, -quantile, 1.0 - quantile)


def _leaf_means(trees: Trees, leaves: list[int], sums: np.ndarray, family: Family, rate: float) -> None:
    for leaf, (g, n) in zip(leaves, sums):
        trees.value[leaf] = -rate * g / max(n + family.pull, 1e-300)


def fit_in_memory(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], family: Family, rounds: int, max_depth: int, rate: float, quantile: float | None) -> Trees:
    bins = _binned(x, cuts)
    trees = Trees(float(y.mean()) if quantile is None else float(np.quantile(y, quantile)))
    fit = np.full(len(y), trees.start)
    for _ in range(rounds):
        slope = _slopes(y, fit, quantile)
        leaves = grow(trees, lambda t, wanted: histograms_of(bins, slope, t.leaves_of(bins, True, len(t.roots) - 1)[:, 0], wanted), cuts, family, max_depth)
        node = trees.leaves_of(bins, True, len(trees.roots) - 1)[:, 0]
        if quantile is None:
            _leaf_means(trees, leaves, np.array([[slope[node == leaf].sum(), (node == leaf).sum()] for leaf in leaves]), family, rate)
        else:
            for leaf in leaves:
                trees.value[leaf] = rate * float(np.quantile((y - fit)[node == leaf], quantile)) if (node == leaf).any() else 0.0
        fit = fit + np.array(trees.value)[node]
    return trees


def fit_distributed(rows: DataFrame, features, target: str, cuts: list[np.ndarray], family: Family, rounds: int, max_depth: int, rate: float, quantile: float | None) -> Trees:
    """The same ensemble with the rows in Spark: a pass per request for histograms, the fit stored every few rounds."""
    width = len(features)
    columns = [F.col(c).cast("double") for c in (*features, target)]
    start = rows.agg(F.avg(target)).first()[0] if quantile is None else exact_quantiles(rows.select(F.lit(0).alias("one"), F.col(target).cast("double").alias("y")), ["one"], "y", {"q": quantile}).first()["q"]
    trees = Trees(float(start))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
            kept = pa.FixedSizeListArray.from_arrays(pa.array(_binned(x, cuts).ravel(), pa.int32()), width).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([kept, batch.column(width), pa.array(np.full(len(x), trees.start))], names=["bins", "y", "fit"])

    state = cut_lineage(rows.select(*columns).mapInArrow(place, "bins array<int>, y double, fit double"))
    stored = 0

    def read(batch: pa.RecordBatch, upto: Trees, since: int, whole: int):
        bins = np.asarray(batch.column(0).flatten()).reshape(-1, width)
        y, fit = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
        node = upto.leaves_of(bins, True, since)
        if whole > since:
            fit = fit + np.array(upto.value)[node[:, : whole - since]].sum(axis=1)
        return bins, y, fit, node

    def ask(t: Trees, wanted: list[int]) -> np.ndarray:
        since, whole = stored, len(t.roots) - 1

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), width, BINS, 2))
            for batch in batches:
                bins, y, fit, node = read(batch, t, since, whole)
                total += histograms_of(bins, _slopes(y, fit, quantile), node[:, -1], wanted)
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total.ravel()[held])], names=["at", "v"])

        sums = state.mapInArrow(count, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(len(wanted) * width * BINS * 2)
        out[sums["at"]] = sums["v"]
        return out.reshape(len(wanted), width, BINS, 2)

    def fitted(t: Trees, since: int, whole: int, schema: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, y, fit, node = read(batch, t, since, whole)
                if schema.startswith("leaf"):
                    yield pa.RecordBatch.from_arrays([pa.array(node[:, -1], pa.int64()), pa.array(y - fit)], names=["leaf", "rest"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fit)], names=["bins", "y", "fit"])

        return state.mapInArrow(run, schema)

    for turn in range(rounds):
        leaves = grow(trees, ask, cuts, family, max_depth)
        left = fitted(trees, stored, len(trees.roots) - 1, "leaf long, rest double")
        if quantile is None:
            sums = {r["leaf"]: (-r["g"], r["n"]) for r in left.groupBy("leaf").agg(F.sum("rest").alias("g"), F.count("*").alias("n")).collect()}
            _leaf_means(trees, leaves, np.array([sums.get(leaf, (0.0, 0)) for leaf in leaves]), family, rate)
        else:
            steps = {r["leaf"]: r["q"] for r in exact_quantiles(left, ["leaf"], "rest", {"q": quantile}).collect()}
            for leaf in leaves:
                trees.value[leaf] = rate * float(steps.get(leaf, 0.0))
        if (turn + 1) % CUT_EVERY == 0:
            state = cut_lineage(fitted(trees, stored, len(trees.roots), "bins array<int>, y double, fit double"))
            stored = len(trees.roots)
    return trees


def fit(rows: DataFrame, features, target: str, family: str, rounds: int, max_depth: int, rate: float, quantiles=(None,), in_memory: int = IN_MEMORY) -> list[Trees]:
    """One ensemble per entry of ``quantiles`` (None: squared error). Rows without target are left out, nulls in features are missing values.

    Up to ``in_memory`` rows are fitted by one task, more in passes over all rows.
    """
    chosen = FAMILIES[family]
    features = list(features)
    rows = rows.where(F.col(target).isNotNull()).select(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in features], F.col(target).cast("double").alias("y_"))
    cuts = bin_cuts(rows, features)
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    if n > in_memory:
        return [fit_distributed(rows, features, "y_", cuts, chosen, rounds, max_depth, rate, q) for q in quantiles]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*features, "y_"])  # the same sums whatever the partitioning
        x, y = frame[features].to_numpy(float), frame["y_"].to_numpy(float)
        made = [fit_in_memory(x, y, cuts, chosen, rounds, max_depth, rate, q) for q in quantiles]
        return pd.DataFrame([{"at": i, **t.to_json()} for i, t in enumerate(made)])

    kinds = "at int, start double, roots array<int>, feature array<int>, bin array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gain array<double>"
    found = rows.groupBy(F.lit(0).alias("one_")).applyInPandas(lambda f: whole(f.drop(columns="one_", errors="ignore")), kinds).collect()
    return [Trees(**{k: v for k, v in r.asDict().items() if k != "at"}) for r in sorted(found, key=lambda r: r["at"])]


# ---- attributions ----------------------------------------------------------


@dataclass
class Paths:
    """Every leaf's conditions, put together by feature: low < x <= high."""

    leaf: np.ndarray
    feature: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    value: np.ndarray
    start: float


def leaf_paths(trees: Trees) -> Paths:
    leaf, feature, lows, highs, value = [], [], [], [], []

    def walk(node: int, limits: dict[int, tuple[float, float]]) -> None:
        f = trees.feature[node]
        if f < 0:
            leaf.append(node)
            feature.append(np.array(list(limits), int))
            lows.append(np.array([x[0] for x in limits.values()]))
            highs.append(np.array([x[1] for x in limits.values()]))
            value.append(trees.value[node])
            return
        low, high = limits.get(f, (-np.inf, np.inf))
        walk(trees.left[node], {**limits, f: (low, min(high, trees.threshold[node]))})
        walk(trees.right[node], {**limits, f: (max(low, trees.threshold[node]), high)})

    for root in trees.roots:
        walk(root, {})
    return Paths(np.array(leaf, int), feature, lows, highs, np.array(value), trees.start)


def patterns(paths: Paths, x: np.ndarray) -> Iterator[np.ndarray]:
    """For each leaf, the features of its path that a row satisfies, as bits."""
    for f, low, high in zip(paths.feature, paths.low, paths.high):
        own = x[:, f]
        inside = np.where(np.isnan(own), np.isinf(high) & (high > 0), (own > low) & (own <= high))
        yield inside @ (1 << np.arange(len(f))) if len(f) else np.zeros(len(x), int)


def shares(paths: Paths, counts: list[np.ndarray]) -> tuple[list[np.ndarray], float]:
    """For each leaf a table (row's pattern x feature of the path) of what the leaf adds to an attribution, and the mean prediction.

    With a background row, features that the row alone satisfies must all be taken from it, those that the background row
    alone satisfies must not; a leaf that neither satisfies in some feature is out of reach. The chance of that over
    all orders of the features has a closed form. ``counts`` are background rows by leaf and pattern.
    """
    out, base = [], paths.start
    for f, value, count in zip(paths.feature, paths.value, counts):
        d, n = len(f), count.sum()
        full = (1 << d) - 1
        factorial = np.cumprod([1.0, *range(1, 2 * d + 2)])
        table = np.zeros((1 << d, d))
        bit = 1 << np.arange(d)
        seen = np.flatnonzero(count)
        for mine in range(1 << d):
            theirs = seen[(seen | mine) == full]
            for z in theirs.tolist():
                a, b = mine & ~z, z & ~mine
                na, nb = a.bit_count(), b.bit_count()
                weight = value * count[z] / n
                if na:
                    table[mine, (a & bit) > 0] += weight * factorial[na - 1] * factorial[nb] / factorial[na + nb]
                if nb:
                    table[mine, (b & bit) > 0] -= weight * factorial[na] * factorial[nb - 1] / factorial[na + nb]
        out.append(table)
        base += value * count[full] / n
    return out, float(base)


def _matrix(batch: pa.RecordBatch, features: int, first: int = 0) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(features)])


def attributions(trees: Trees, df: DataFrame, background: DataFrame, features, row_id: str) -> DataFrame:
    """Exact Shapley values of the ensemble against all rows of ``background``: ``row_id``, ``feature``, ``attribution``, ``base_value``.

    A leaf sees of a background row only which features of its path that row satisfies. So the background is one pass of
    counts by leaf and pattern, whatever its size, and a row's parts are looked up by leaf and pattern.
    ``base_value`` is the background's mean prediction; it and a row's parts sum to the row's prediction.
    """
    features = list(features)
    paths = leaf_paths(trees)
    ends = np.cumsum([0, *(1 << len(f) for f in paths.feature)])
    inputs = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1], np.int64)
        for batch in batches:
            for i, p in enumerate(patterns(paths, _matrix(batch, len(features)))):
                total[ends[i] : ends[i + 1]] += np.bincount(p, minlength=ends[i + 1] - ends[i])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["at", "n"])

    found = background.select(*inputs).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(ends[-1], np.int64)
    total[found["at"]] = found["n"]
    if len(paths.leaf) and not total.any():
        raise ValueError("no background rows")
    tables, base = shares(paths, [total[a:b] for a, b in zip(ends, ends[1:])])
    kind = df.schema[row_id].dataType.simpleString()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(features)))
            for f, table, p in zip(paths.feature, tables, patterns(paths, _matrix(batch, len(features), 1))):
                out[:, f] += table[p]
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(features)), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts], names=[row_id, "parts"])

    told = df.select(row_id, *inputs).mapInArrow(explain, f"`{row_id}` {kind}, parts array<double>")
    names = F.array(*map(F.lit, features))
    return told.select(row_id, F.explode(F.arrays_zip(names.alias("feature"), F.col("parts").alias("attribution"))).alias("p")).select(row_id, "p.feature", "p.attribution", F.lit(base).alias("base_value"))
