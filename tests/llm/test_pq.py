import numpy as np
import pytest

from gridtide.llm import pq


def plain(rows, threshold=0.95):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and all(x is not None for x in v):
            a = np.array(v, np.float64)
            if len(a) and np.isfinite(a).all() and a.any():
                good[i] = a / np.linalg.norm(a / np.abs(a).max()) / np.abs(a).max()
    n, label = [0] * len(rows), list(range(len(rows)))
    links = {i: [j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] >= threshold] for i in good}
    out, seen = [], {}
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], []
        seen[i] = i
        while todo:
            x = todo.pop()
            group.append(x)
            for y in links.get(x, []):
                if y not in seen:
                    seen[y] = i
                    todo.append(y)
        least = min(rows[g][0] for g in group)
        out += [(rows[g][0], len(links.get(g, [])), least, rows[g][0] == least) for g in group]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(tuple(r) for r in pq.near_vectors(frame, **options).collect())


@pytest.mark.parametrize("block, sample", [(2048, 20_000), (40, 200)])
def test_equals_brute_force(spark, monkeypatch, block, sample):
    monkeypatch.setattr(pq, "BLOCK", block)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 24))
    points = np.concatenate([c + rng.normal(size=(n, 24)) * s for c, n, s in zip(centre, rng.integers(1, 60, 40), rng.uniform(0.02, 0.5, 40), strict=True)]).astype(np.float32)
    rows = [(int(i) * 3, p.tolist()) for i, p in enumerate(points)] + [(5000 + i, points[7].tolist()) for i in range(30)]
    assert found(spark, rows, sample=sample, probes=None) == found(spark, rows, sample=sample) == plain(rows)


def test_many_lists_lose_no_link(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(5000, 8)).astype(np.float32)  # many neighbours, several lists
    got = found(spark, [(i, p.tolist()) for i, p in enumerate(points)], probes=None)
    unit = points.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert [g[1] for g in got] == want.tolist()
    some = np.array([g[1] for g in found(spark, [(i, p.tolist()) for i, p in enumerate(points)])])
    assert (some <= want).all() and some.sum() >= 0.98 * want.sum()


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-38, 0.0]), (12, [3e38, 1e37])]
    assert found(spark, rows) == sorted(plain(rows))
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]
    clash = spark.createDataFrame([(1, [1.0, 2.0], 3, 4)], "vec_id long, embedding array<float>, n int, v int")
    assert pq.near_vectors(clash).columns == ["vec_id", "n_links", "component_id", "kept"]
