"""Near-duplicate vectors through product quantisation: coarse lists, residual codes, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.components import components
from gridtide.llm.tables import stored

SAMPLE = 20_000  # vectors that centroids and code books are fitted on
BLOCK = 2048  # members or queries of a list that one task compares
LIST = 300  # vectors of a list, about
PROBES = 8  # further lists that a vector visits


@dataclass
class Index:
    """Centroids of the lists, and a code book per subspace for what a unit vector leaves over its centroid."""

    centroids: np.ndarray
    books: np.ndarray  # subspaces x codes x width

    def distances(self, unit: np.ndarray) -> np.ndarray:
        d = (unit**2).sum(1)[:, None] - 2 * unit @ self.centroids.T + (self.centroids**2).sum(1)
        return np.maximum(d, 0.0)

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each subspace, and how far the coded vector lies from the true one."""
        parts = rest.reshape(len(rest), len(self.books), -1)
        code = np.empty(parts.shape[:2], np.uint8)
        off = np.zeros(len(rest))
        for s, book in enumerate(self.books):
            d = ((parts[:, s, None, :] - book[None]) ** 2).sum(2)
            code[:, s] = d.argmin(1)
            off += d.min(1)
        return code, np.sqrt(off)


def _kmeans(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least entries of each row (all, if there are fewer), least first."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1)
    some = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1), 1)


def fit_index(sample: np.ndarray, lists: int, subspaces: int = 8, codes: int = 32, seed: int = 1) -> Index:
    """Fits on unit vectors (a bounded sample). The width is padded with zeros to a multiple of ``subspaces``."""
    rng = np.random.default_rng(seed)
    centroids = _kmeans(sample, min(lists, len(sample)), 8, rng)
    rest = sample - centroids[Index(centroids, np.zeros((1, 1, 1))).distances(sample).argmin(1)]
    parts = rest.reshape(len(rest), subspaces, -1)
    books = np.stack([_kmeans(np.ascontiguousarray(parts[:, s]), min(codes, len(rest)), 6, rng) for s in range(subspaces)])
    return Index(centroids, books)


def _unit(blobs: pd.Series, width: int, padded: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and scaled to length one with padding."""
    full = np.frombuffer(b"".join(blobs), np.float64).reshape(-1, width)
    scaled = full / np.abs(full).max(1)[:, None]
    unit = np.zeros((len(full), padded))
    unit[:, :width] = scaled / np.sqrt((scaled**2).sum(1))[:, None]
    return full, unit


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", subspaces: int = 8, sample: int = SAMPLE, probes: int | None = PROBES) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    Two vectors link if their cosine in double precision is ``threshold`` or more. Null or zero vectors, and
    those with null or non-finite components or with another length than most, link with nothing. Equal
    vectors form a class that is compared once; its size counts in ``n_links``. ``component_id`` is the
    smallest id reachable, the own one without links. Other columns are ignored.

    Every class goes to the list of its nearest centroid, coded by its residual. As a query it visits its own
    list and, of the lists whose bisecting plane with its own cell is within reach, the ``probes`` nearest: a linked
    vector lies at most r = sqrt(2 - 2 threshold) away on the unit sphere, so it cannot sit beyond such a plane. A pair
    is missed only if neither vector visits the other's list; with ``probes`` None all lists within reach are visited and no link
    is lost. Lists grow in number with the vectors (up to the size of the sample), so the work of a vector does
    not. In a list a table lookup gives each query's distance to every coded member; members
    farther than r plus their own coding error are out, the rest are decided by the exact cosine. Lists are
    cut into blocks of members and of queries, each pair of blocks being one group. A group returns counts and
    a spanning forest, not its pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = "v is not null and size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157e308)"
    rows = stored(rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False))), "vectors")
    size = rows.where("sound").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if size is None:
        return plain
    width = size["w"]
    padded = -(-width // subspaces) * subspaces
    usable = rows.where(F.col("sound") & (F.size("v") == width))
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()

    def blobs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"], "n": f["n"], "blob": [np.asarray(x, np.float64).tobytes() for x in f["v"]]})

    packed = classes.select("node", "n", "v").mapInPandas(blobs, "node long, n long, blob binary")
    every = max(1, -(-total // sample))
    fitted = packed.where(F.pmod(F.xxhash64("blob"), F.lit(every)) == 0).select("blob").toArrow().to_pandas()
    if fitted.empty:
        fitted = packed.select("blob").limit(sample).toArrow().to_pandas()
    lists = int(min(len(fitted), max(1, total // LIST)))
    index = fit_index(_unit(fitted["blob"].sort_values(), width, padded)[1], lists, subspaces)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    centroids = index.centroids

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            unit = _unit(f["blob"], width, padded)[1]
            d = index.distances(unit)
            order = np.argsort(d, axis=1) if probes is None else _nearest(d, probes + 1)
            own, near = order[:, 0], order[:, 1:]
            code, off = index.codes(unit - centroids[own])
            gap = np.take_along_axis(d, near, 1) - d[np.arange(len(f)), own][:, None]
            between = np.sqrt(np.maximum(((centroids[near] - centroids[own][:, None]) ** 2).sum(2), 1e-12))
            visits = gap <= 2 * between * reach
            row, place = np.nonzero(visits)
            seen = [x.tobytes() for x in np.where(visits, near, -1).astype(np.int32)]
            home = f.assign(place=own, home=own, own=True, code=[c.tobytes() for c in code], off=off, visits=seen)
            away = f.iloc[row].assign(place=near[row, place], home=own[row], own=False, code=None, off=0.0, visits=None)
            yield pd.concat([home, away])[["place", "home", "own", "node", "n", "blob", "code", "off", "visits"]]

    dealt = stored(packed.mapInPandas(deal, "place int, home int, own boolean, node long, n long, blob binary, code binary, off double, visits binary"), "vector-lists")
    blocks = dealt.groupBy("place").agg(
        F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("m"), F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("q")
    )
    placed = dealt.join(blocks.where("m > 0"), "place")
    member = placed.where("own").select("place", F.pmod(F.xxhash64("node"), F.col("m")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(True).alias("member"), "home", "own", "node", "n", "blob", "code", "off", "visits")
    query = placed.select("place", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("q")).cast("int").alias("j"), F.lit(False).alias("member"), "home", "own", "node", "n", "blob", "code", "off", "visits")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        is_member = f["member"].to_numpy(bool)
        m, q = f[is_member], f[~is_member]
        if m.empty or q.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        m_full, _ = _unit(m["blob"], width, padded)
        q_full, q_unit = _unit(q["blob"], width, padded)
        code = np.frombuffer(b"".join(m["code"]), np.uint8).reshape(len(m), -1)
        limit = (reach + m["off"].to_numpy()) ** 2
        m_id, q_id = m["node"].to_numpy(), q["node"].to_numpy()
        m_n, q_n = m["n"].to_numpy(), q["n"].to_numpy()
        q_own = q["own"].to_numpy(bool)
        visited = np.frombuffer(b"".join(m["visits"]), np.int32).reshape(len(m), -1)
        place, q_home = int(f["place"].iloc[0]), q["home"].to_numpy()
        m_count, q_count = np.zeros(len(m), np.int64), np.zeros(len(q), np.int64)
        label = {}
        m_scale, q_scale = np.abs(m_full).max(1)[:, None], np.abs(q_full).max(1)[:, None]
        m_full, q_full = m_full / m_scale, q_full / q_scale
        m_norm, q_norm = np.sqrt((m_full**2).sum(1)), np.sqrt((q_full**2).sum(1))
        edges = []
        for at in range(0, len(q), 256):
            some = slice(at, at + 256)
            rest = (q_unit[some] - centroids[place]).reshape(-1, subspaces, padded // subspaces)
            seen = np.zeros((len(rest), len(m)))
            for s in range(subspaces):
                table = ((rest[:, s, None, :] - index.books[s][None]) ** 2).sum(2)
                seen += table[:, code[:, s]]
            x, y = np.nonzero(seen <= limit[None] + 1e-9)
            x += at
            fresh = ~q_own[x] | (q_id[x] < m_id[y])  # pairs within a list once
            x, y = x[fresh], y[fresh]
            if not len(x):
                continue
            cosine = np.concatenate([np.einsum("ij,ij->i", q_full[x[c : c + 65536]], m_full[y[c : c + 65536]]) for c in range(0, len(x), 65536)]) / (q_norm[x] * m_norm[y])
            x, y = x[cosine >= threshold], y[cosine >= threshold]
            # a pair whose two vectors visit each other's list counts in the list of higher number
            once = (q_home[x] <= place) | ~(visited[y] == q_home[x][:, None]).any(1)
            x, y = x[once], y[once]
            np.add.at(q_count, x, m_n[y])
            np.add.at(m_count, y, q_n[x])
            for a, b in zip(q_id[x].tolist(), m_id[y].tolist(), strict=True):  # union by labels
                while label.setdefault(a, a) != a:
                    label[a] = label[label[a]]
                    a = label[a]
                while label.setdefault(b, b) != b:
                    label[b] = label[label[b]]
                    b = label[b]
                if a != b:
                    label[max(a, b)] = min(a, b)
                    edges.append((min(a, b), max(a, b)))
        out = [pd.DataFrame({"a": ids[c > 0], "n": c[c > 0]}) for ids, c in ((m_id, m_count), (q_id, q_count))]
        tree = pd.DataFrame(edges, columns=["a", "b"], dtype="int64").assign(n=0)
        return pd.concat([o.assign(b=-1) for o in out] + [tree])[["a", "b", "n"]].astype("int64")

    found = stored(member.unionByName(query).groupBy("place", "i", "j").applyInPandas(compare, "a long, b long, n long"), "vector-links")
    counts = found.where("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    reached = components(found.where("b >= 0").select("a", "b"))
    told = classes.join(counts, "node", "left").join(reached, "node", "left").select("v", "n", "least", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("label", "node").alias("label"))
    named = told.groupBy("label").agg(F.min("least").alias("component_id"))
    told = told.join(named, "label").select("v", (F.col("n") - 1 + F.col("linked")).alias("n_links"), "component_id")
    linked = usable.select("vec_id", "v").join(told, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    rest = rows.where(~(F.col("sound") & (F.size("v") == width))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(rest)
