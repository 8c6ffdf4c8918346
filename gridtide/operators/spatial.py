"""Regional aggregation of gridded weather held as long tables.

Grid columns: ``variable, time[, step_hours][, level], latitude, longitude, value``.
Ring columns: ``region_id, region, ring_id, seq, lon, lat`` in lon/lat degrees.
"""

from __future__ import annotations

import warnings

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridtide.operators.rollups import listed
from gridtide.session import cut_lineage

LEAF_EDGES = 64  # a cover cell with more is split
DEEPEST = 20
_CELL = ["level", "ix", "iy"]


def ring_edges(rings: DataFrame) -> DataFrame:
    """Closed polygon edges (x1, y1)-(x2, y2), one row each."""
    line = W.partitionBy("region_id", "ring_id").orderBy("seq")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rings.select(
        "region_id", "region", "ring_id",
        F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.coalesce(F.lead("lon").over(line), F.first("lon").over(whole)).alias("x2"),
        F.coalesce(F.lead("lat").over(line), F.first("lat").over(whole)).alias("y2"),
    )


@dataclass
class Cover:
    """Cells of a quadtree that together cover all regions: ``level``, ``ix``, ``iy`` and ``regions``.

    ``regions`` has the regions a cell lies in or whose boundary it meets, lowest id first: ``odd`` tells
    whether the cell's upper right corner lies within, ``edges`` are the boundary edges that meet the cell.
    """

    leaves: DataFrame
    levels: list[int]
    left: float
    bottom: float
    width: float
    height: float

    def cell(self, lon: str, lat: str, level: str) -> list[Column]:
        """``ix`` and ``iy`` of a place at a level; the last cells hold their upper sides."""
        side = f"shiftleft(1L, {level})"
        return [
            F.expr(f"least({side} - 1, cast(floor(({at} - {low!r}D) / {size!r}D * {side}) as bigint))").alias(name)
            for at, low, size, name in ((lon, self.left, self.width, "ix"), (lat, self.bottom, self.height, "iy"))
        ]

    def right_of(self, level: str = "level", ix: str = "ix") -> str:
        return f"({self.left!r}D + ({ix} + 1) * {self.width!r}D / shiftleft(1L, {level}))"

    def top_of(self, level: str = "level", iy: str = "iy") -> str:
        return f"({self.bottom!r}D + ({iy} + 1) * {self.height!r}D / shiftleft(1L, {level}))"


def _crossings(x: str, y: str, right: str, top: str, e: str = "") -> str:
    """Times the boundary edge ``e`` is crossed on the way from (x, y) east to the cell's right side, then up to its top.

    East of that corner the number of crossings is known by its parity. Edges own their lower end; whether the upward
    way crosses an edge follows from where the edge crosses the place's latitude, so both parts agree at any place.
    """
    x1, y1, x2, y2 = (f"{e}{c}" for c in ("x1", "y1", "x2", "y2"))

    def spans(at: str) -> str:
        return f"(least({y1}, {y2}) <= {at} and {at} < greatest({y1}, {y2}))"

    def meets(at: str) -> str:
        return f"({x1} + ({at} - {y1}) / nullif({y2} - {y1}, 0) * ({x2} - {x1}))"

    def above(at: str) -> str:
        rising = f"(({x2} > {x1}) = ({y2} > {y1}))"
        inside = f"if({rising}, {meets(at)} <= {right}, {meets(at)} > {right})"
        return f"case when {at} < least({y1}, {y2}) then true when {at} >= greatest({y1}, {y2}) then false else {inside} end"

    east = f"if({spans(y)} and {meets(y)} > {x} and {meets(y)} <= {right}, 1, 0)"
    up = f"if((({x1} <= {right}) <> ({x2} <= {right})) and ({above(y)}) <> ({above(top)}), 1, 0)"
    return f"({east} + {up})"


def region_cover(rings: DataFrame, leaf: int = LEAF_EDGES, deepest: int = DEEPEST) -> Cover | None:
    """Quadtree over the rings, split until a cell meets at most ``leaf`` edges; None without any ring.

    Edges are rows that move to the children they meet; a child's corner is told from its parent's, so no edge meets
    anything beyond its own cell. A boundary in one place is spread over as many cells, and tasks, as it needs.
    """
    n, left, right, bottom, top = rings.agg(F.count("*"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if not n:
        return None
    cover = Cover(rings, [0], left, bottom, (right - left) or 1.0, (top - bottom) or 1.0)
    root = [F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("iy")]
    of = ["region_id", "region"]
    shape = ["x1", "y1", "x2", "y2"]
    edges = ring_edges(rings).select(*root, *of, *shape)
    cells = rings.select(*root, *of, F.lit(0).alias("odd")).distinct()
    done_edges, done_cells = [], []
    for level in range(deepest if n > leaf else 0):
        crowded = cut_lineage(edges.groupBy(*_CELL).agg(F.count("*").alias("_n")).where(F.col("_n") > leaf).select(*_CELL))
        if crowded.isEmpty():
            break
        done_edges.append(edges.join(crowded, _CELL, "left_anti"))
        done_cells.append(cells.join(crowded, _CELL, "left_anti"))
        split = edges.join(crowded, _CELL)
        child = F.explode(F.expr("array(struct(0 as dx, 0 as dy), struct(1 as dx, 0 as dy), struct(0 as dx, 1 as dy), struct(1 as dx, 1 as dy))")).alias("_to")
        lower = [F.lit(level + 1).alias("level"), F.expr("2 * ix + _to.dx").alias("ix"), F.expr("2 * iy + _to.dy").alias("iy")]
        corner = (cover.right_of("(level + 1)", "(2 * ix + _to.dx)"), cover.top_of("(level + 1)", "(2 * iy + _to.dy)"))
        crossed = split.select("*", child).select(*lower, *of, F.expr(_crossings(*corner, cover.right_of(), cover.top_of())).alias("_c"))
        crossed = crossed.groupBy(*_CELL, *of).agg(F.sum("_c").alias("_c"))
        below = cells.join(crowded, _CELL).select("odd", *_CELL, *of, child).select(*lower, *of, "odd")
        below = below.join(crossed, [*_CELL, *of], "left").select(*_CELL, *of, F.expr("cast((odd + coalesce(_c, 0)) % 2 as int)").alias("odd"))
        moved = split.select("*", child).select(*lower, *of, *shape)
        edges, cells = cut_lineage(moved.where(_meets_cell(cover))), cut_lineage(below)
    for part in done_edges:
        edges = edges.unionByName(part)
    for part in done_cells:
        cells = cells.unionByName(part)
    held = edges.groupBy(*_CELL, *of).agg(F.collect_list(F.struct(*shape)).alias("edges"))  # few, but for edges that meet in one point
    known = cells.join(held, [*_CELL, *of], "left").where("odd = 1 or edges is not null")
    by_cell = known.groupBy(*_CELL).agg(F.array_sort(F.collect_list(F.struct(*of, "odd", F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).alias("edges")))).alias("regions"))
    if done_edges:
        by_cell = cut_lineage(by_cell)
        cover.levels = sorted(r["level"] for r in by_cell.select("level").distinct().collect())
    cover.leaves = by_cell
    return cover


def _meets_cell(cover: Cover) -> Column:
    """False only for edges that surely miss the cell: their box does, or all corners lie to one side of their line."""
    right, top = cover.right_of(), cover.top_of()
    left, bottom = cover.right_of(ix="(ix - 1)"), cover.top_of(iy="(iy - 1)")

    def side(x: str, y: str) -> str:
        return f"((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))"

    corners = ", ".join(side(x, y) for x in (left, right) for y in (bottom, top))
    slack = "(1e-9 * (abs(x2 - x1) + abs(y2 - y1)))"
    box = f"least(x1, x2) <= {right} + 1e-9 and greatest(x1, x2) >= {left} - 1e-9 and least(y1, y2) <= {top} + 1e-9 and greatest(y1, y2) >= {bottom} - 1e-9"
    return F.expr(f"{box} and least({corners}) <= {slack} and greatest({corners}) >= -{slack}")


def with_region(places: DataFrame, rings: DataFrame, cover: Cover | None = None) -> DataFrame:
    """``places`` inside a region with its ``region_id`` and ``region``, the lowest id of several.

    A place is looked up in the one cell of the cover that holds it, by an equi-join; only cells on a boundary
    have edges to compare. One row in, at most one out: the places are neither counted nor grouped. They are
    repeated once per level of the cover before that join.
    """
    cover = region_cover(rings) if cover is None else cover
    if cover is None:
        return places.where(F.lit(False)).select("*", F.lit(None).cast("int").alias("region_id"), F.lit(None).cast("string").alias("region"))
    box = f"longitude between {cover.left!r}D and {cover.left + cover.width!r}D and latitude between {cover.bottom!r}D and {cover.bottom + cover.height!r}D"
    levels = F.explode(F.array(*map(F.lit, cover.levels))) if len(cover.levels) > 1 else F.lit(cover.levels[0])
    named = {c: f"_{c}" for c in _CELL}
    held = places.where(box).withColumn("_level", levels)
    held = held.withColumns({f"_{name}": c for name, c in zip(("ix", "iy"), cover.cell("longitude", "latitude", "_level"))})
    found = held.join(cover.leaves.withColumnsRenamed(named), list(named.values()))
    right, top = cover.right_of("_level", "_ix"), cover.top_of("_level", "_iy")
    if cover.levels == [0]:  # one cell: nothing lies beyond its right side
        crossings = "if(latitude >= least(e.y1, e.y2) and latitude < greatest(e.y1, e.y2) and e.x1 + (latitude - e.y1) / nullif(e.y2 - e.y1, 0) * (e.x2 - e.x1) > longitude, 1, 0)"
    else:
        crossings = _crossings("longitude", "latitude", right, top, "e.")
    first = F.expr(f"get(filter(regions, r -> (r.odd + aggregate(r.edges, 0, (n, e) -> n + {crossings})) % 2 = 1), 0)")
    found = found.withColumn("_in", first).where("_in is not null")
    return found.select(*places.columns, F.col("_in.region_id").alias("region_id"), F.col("_in.region").alias("region"))


def mask_cells(cells: DataFrame, rings: DataFrame) -> DataFrame:
    """Region of each distinct (latitude, longitude) cell (C7); cells in none are left out."""
    return with_region(cells.select("latitude", "longitude").distinct(), rings)


def valid_time(grid: DataFrame, out: str = "datetime", time_column: str | None = None, warn_only: bool = False) -> DataFrame:
    """Time a value is valid for: the caller's column if the table has it, time + step, else valid_time, time or datetime.

    A table without any of them is an error, or with ``warn_only`` is returned unchanged with a warning.
    """
    have = set(grid.columns)
    if time_column in have:
        moment: Column = F.col(time_column)
    elif {"time", "step_hours"} <= have:
        moment = F.col("time") + F.make_dt_interval(hours=F.col("step_hours").cast("int"))
    else:
        known = [c for c in ("valid_time", "time", "datetime") if c in have]
        if not known:
            message = f"no time column among {sorted(have)}"
            if warn_only:
                warnings.warn(message, stacklevel=2)
                return grid
            raise ValueError(message)
        moment = F.col(known[0])
    return grid.withColumn(out, moment.cast("timestamp_ntz"))


def regional_means(grid: DataFrame, rings: DataFrame, by_level: bool | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Unweighted mean over cells per variable, valid time and region.

    Values are first summed per cell and time on the map side, so a crowded cell
    shuffles one row per task; these sums are looked up in the regions' cover. The grid is read once. With
    pressure levels the result is the mean of the levels' means.
    """
    if by_level is None:
        by_level = "level" in grid.columns
    timed = valid_time(grid)
    level = ["level"] if by_level else []
    cells = timed.groupBy("variable", "datetime", *level, "latitude", "longitude").agg(
        F.sum("value").alias("_s"), F.count("value").alias("_c"),
    )
    placed = with_region(cells, rings) if mask is None else cells.join(mask, ["latitude", "longitude"])
    means = placed.groupBy("variable", "datetime", *level, "region").agg(
        F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean_value"),
    )
    if by_level:
        means = means.groupBy("variable", "datetime", "region").agg(F.avg("mean_value").alias("mean_value"))
    return means


def regions_wide(means: DataFrame, regions: list[str]) -> DataFrame:
    """One column per region; times without any value are dropped, a region outside the list is an error."""
    means = means.withColumn("region", listed("region", regions))
    by = [c for c in ("variable", "datetime") if c in means.columns]
    cells = [F.max(F.when(F.col("region") == r, F.col("mean_value"))).alias(r) for r in regions]
    wide = means.groupBy(*by).agg(*cells)
    return wide.na.drop(how="all", subset=list(regions))


def first_slice(grid: DataFrame) -> DataFrame:
    """Rows of each variable's earliest time."""
    starts = grid.groupBy("variable").agg(F.min("time").alias("time"))
    return grid.join(starts, ["variable", "time"], "left_semi")


def grid_summary(grid: DataFrame) -> DataFrame:
    """Shape and ranges per variable (A10)."""
    stats = [F.count("*").alias("n_values"), F.count_if(F.col("value").isNull()).alias("n_null")]
    for c in ("time", "latitude", "longitude"):
        stats += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    ranges = grid.groupBy("variable").agg(*stats)
    # One distinct per axis at a time keeps each shuffle to (variable, axis value).
    for c in ("time", "latitude", "longitude"):
        sizes = grid.select("variable", c).distinct().groupBy("variable").agg(F.count(c).alias(f"n_{c}"))
        ranges = ranges.join(sizes, "variable")
    return ranges


def region_preview(rings: DataFrame) -> DataFrame:
    """Rings, vertices and bounding box per region."""
    return rings.groupBy("region_id", "region").agg(
        F.count_distinct("ring_id").alias("n_rings"), F.count("*").alias("n_vertices"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
    )
