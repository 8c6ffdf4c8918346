"""The region cover against a plain crossing count over all edges."""

import numpy as np
import pandas as pd
import pytest

from gridtide.operators import spatial as S

RINGS = "region_id int, region string, ring_id int, seq int, lon double, lat double"


def ring(region_id, ring_id, points):
    return [(region_id, f"r{region_id}", ring_id, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def wavy(center, size, n, waves):
    t = np.arange(n) / n * 2 * np.pi
    r = size * (1 + 0.3 * np.sin(waves * t))
    return np.column_stack([center[0] + r * np.cos(t), center[1] + r * np.sin(t)])


def plain(rows, places):
    """Lowest region id whose edges cross an odd number of times to the east, half-open in latitude."""
    edges = {}
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RINGS.split(", ")])
    for (rid, _), g in frame.groupby(["region_id", "ring_id"]):
        p = g.sort_values("seq")[["lon", "lat"]].to_numpy()
        edges.setdefault(rid, []).append(np.hstack([p, np.roll(p, -1, axis=0)]))
    out = {}
    for rid in sorted(edges, reverse=True):
        x1, y1, x2, y2 = np.concatenate(edges[rid]).T
        for lat, lon in places:
            spans = (np.minimum(y1, y2) <= lat) & (lat < np.maximum(y1, y2))
            meets = x1[spans] + (lat - y1[spans]) / (y2[spans] - y1[spans]) * (x2[spans] - x1[spans])
            if (meets > lon).sum() % 2:
                out[lat, lon] = rid
    return out


SHAPES = {
    "square": ring(0, 0, [(0, 0), (8, 0), (8, 8), (0, 8)]),
    "overlap and hole": ring(2, 0, wavy((0, 0), 10, 300, 7)) + ring(2, 1, wavy((0, 0), 4, 90, 3)) + ring(1, 0, wavy((6, 3), 5, 200, 5)) + ring(7, 0, [(-9, -9), (9, -9), (9, 9), (-9, 9)]),
    "lattice": ring(3, 0, [(i, (i % 2) * 4) for i in range(17)] + [(16, 8), (0, 8)]),
    "comb": ring(4, 0, [p for i in range(40) for p in ((i * 0.4, 0), (i * 0.4, 6), (i * 0.4 + 0.2, 6), (i * 0.4 + 0.2, 0))] + [(16, -1), (0, -1)]),
}


@pytest.mark.parametrize("leaf", [16, 64])
@pytest.mark.parametrize("name", SHAPES)
def test_places_equal_a_plain_count(spark, name, leaf):
    rows = SHAPES[name]
    rng = np.random.default_rng(1)
    lon, lat = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    places = set(zip(rng.uniform(lat.min() - 1, lat.max() + 1, 1500), rng.uniform(lon.min() - 1, lon.max() + 1, 1500)))
    steps = np.linspace(0, 1, 17)  # on the cells' own sides too
    places |= {(lat.min() + a * np.ptp(lat), lon.min() + b * np.ptp(lon)) for a in steps for b in steps}
    places |= {(float(round(a)), float(round(b))) for a, b in list(places)[:300]}
    cells = spark.createDataFrame([(float(a), float(b)) for a, b in places], "latitude double, longitude double")
    shapes = spark.createDataFrame(rows, RINGS)
    cover = S.region_cover(shapes, leaf)
    assert (cover.levels != [0]) == (len(rows) > leaf)
    got = {(r.latitude, r.longitude): r.region_id for r in S.with_region(cells, shapes, cover).collect()}
    assert got == plain(rows, [(float(a), float(b)) for a, b in places])


def test_long_boundary_is_spread(spark):
    """A ring of 100 000 vertices within one degree: no cell keeps more than a few edges, no task most of them."""
    rows = ring(0, 0, wavy((-70.0, -33.5), 0.3, 100_000, 40))
    shapes = spark.createDataFrame(rows, RINGS).repartition(8)
    cover = S.region_cover(shapes)
    sizes = cover.leaves.selectExpr("size(regions[0].edges) as n").toPandas()["n"]
    assert sizes.max() <= S.LEAF_EDGES and sizes.sum() < 150_000
    rng = np.random.default_rng(3)
    places = list(zip(rng.uniform(-34, -33, 400).tolist(), rng.uniform(-70.5, -69.5, 400).tolist()))
    cells = spark.createDataFrame(places, "latitude double, longitude double")
    assert {(r.latitude, r.longitude): r.region_id for r in S.with_region(cells, shapes, cover).collect()} == plain(rows, places)


def test_no_rings_and_one_scan(spark, sf_dir):
    from gridtide.plans.fixtures import grid, rings

    cells = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "latitude double, longitude double")
    assert S.mask_cells(cells, spark.createDataFrame([], RINGS)).collect() == []
    assert S.mask_cells(cells, spark.createDataFrame(SHAPES["square"], RINGS)).count() == 1
    plan = S.regional_means(grid(spark, sf_dir), rings(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
