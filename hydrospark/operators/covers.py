"""Covers of polygons by grid cells, so that points meet areas in an equi-join on their cell.

A cell that no edge touches lies wholly inside or outside; points in it need no test. A cell with edges carries what the
even-odd test needs there: of each ring the parity of the edges that every point of the cell has on its right, and the few
edges for which that differs from point to point.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import crosses
from ..sources.shared import ship, small, written

CELL = ["body_id", "cx", "cy"]
_EDGE = "struct<ax: double, ay: double, bx: double, by: double>"
_COVER = f"body_id string, cx long, cy long, step double, feature int, zone_id string, inside boolean, shapes array<array<struct<odd: boolean, edges: array<{_EDGE}>>>>"


def grid_steps(features: DataFrame, cells: int = 4096, per_feature: int = 16) -> DataFrame:
    """(body_id, step): a cell size for each body such that the boxes of all its features take about `cells` or `per_feature` cells a feature, whichever is more.

    A box of w x h takes at most (w / step + 1) * (h / step + 1) cells; the step makes each part of that sum at most a third of the number, so many thin boxes stay cheap too.
    """
    v = F.flatten(F.flatten("polygons"))
    low, high = (lambda k: F.array_min(F.transform(v, lambda p: p[k]))), (lambda k: F.array_max(F.transform(v, lambda p: p[k])))
    box = features.select("body_id", (high("lon") - low("lon")).alias("w"), (high("lat") - low("lat")).alias("h")).filter("w IS NOT NULL")
    by = box.groupBy("body_id").agg(F.sum(F.col("w") * F.col("h")).alias("area"), F.sum(F.col("w") + F.col("h")).alias("around"), F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(float(cells)), F.col("n") * float(per_feature))
    step = F.greatest(F.sqrt(3 * F.col("area") / most), 3 * F.col("around") / most)
    return by.select("body_id", F.when(step > 0, step).otherwise(1.0).alias("step"))


def _edges(polygons: list) -> list[list[np.ndarray]]:
    """By polygon and ring its edges (ax, ay, bx, by), each from the vertex on to the one before; rings of fewer than three points hold nothing."""
    out = []
    for polygon in polygons:
        rings = []
        for i, ring in enumerate(polygon or []):
            p = np.array([(x["lon"], x["lat"]) for x in ring], float).reshape(-1, 2)
            if len(p) >= 3:
                rings.append(np.hstack([p, np.roll(p, 1, axis=0)]))
            elif i == 0:
                break  # without an outer ring there is no polygon
        if rings:
            out.append(rings)
    return out


def _touched(edges: np.ndarray, step: float) -> set[tuple[int, int]]:
    """Cells that an edge touches or nearly touches."""
    near = 1e-9 * step
    lo, hi = edges[:, [0, 1]], edges[:, [2, 3]]
    first = np.floor((np.minimum(lo[:, 0], hi[:, 0]) - near) / step).astype(np.int64)
    last = np.floor((np.maximum(lo[:, 0], hi[:, 0]) + near) / step).astype(np.int64)
    n = last - first + 1
    at = np.repeat(np.arange(len(edges)), n)
    cx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[at]
    (ax, ay), (bx, by) = edges[at, :2].T, edges[at, 2:].T
    dx = np.where(bx == ax, 1.0, bx - ax)
    # the stretch of the edge inside the column
    t = np.stack([(cx * step - near - ax) / dx, ((cx + 1) * step + near - ax) / dx])
    t = np.where(bx == ax, np.array([[0.0], [1.0]]), np.clip(np.sort(t, axis=0), 0, 1))
    y = np.sort(ay + t * (by - ay), axis=0)
    tall = 1e-12 * np.abs(y).max(initial=0.0) + near
    low, high = np.floor((y[0] - tall) / step).astype(np.int64), np.floor((y[1] + tall) / step).astype(np.int64)
    m = high - low + 1
    cy = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low, m)
    return set(zip(np.repeat(cx, m).tolist(), cy.tolist()))


def _row_shapes(polygons: list[list[np.ndarray]], cy: int, xs: list[int], step: float) -> Iterator[list]:
    """For cells of one row their rings: parity of the edges on every point's right, and the edges that must be tested."""
    near = 1e-9 * step
    y0, y1 = cy * step - near, (cy + 1) * step + near
    band = []
    for rings in polygons:
        kept = []
        for e in rings:
            low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
            some = (high > y0) & (low <= y1) & (high > low)
            e, low, high = e[some], low[some], high[some]
            kept.append((e, (low <= y0) & (high > y1), np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])))
        band.append(kept)
    for cx in xs:
        x0, x1 = cx * step - near, (cx + 1) * step + near
        shapes = []
        for kept in band:
            rings = []
            for e, whole, left, right in kept:
                sure = whole & (left > x1)
                rings.append((bool(sure.sum() % 2), e[~sure & (right >= x0)]))
            shapes.append(rings)
        yield shapes


def _inside_rows(polygons: list[list[np.ndarray]], step: float, cx0: int, cx1: int, cy: int) -> np.ndarray:
    """Whether the centres of a row's cells lie inside."""
    y, x = (cy + 0.5) * step, (np.arange(cx0, cx1 + 1) + 0.5) * step
    out = np.zeros(len(x), bool)
    for rings in polygons:
        here = None
        for e in rings:
            e = e[(e[:, 1] > y) != (e[:, 3] > y)]
            at = np.sort((e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
            odd = (len(at) - np.searchsorted(at, x, side="right")) % 2 == 1
            here = odd if here is None else here & ~odd
        out |= here
    return out


def cover_of(polygons: list, step: float) -> Iterator[tuple[int, int, bool, list | None]]:
    """(cx, cy, inside, shapes) of the cells of one geometry; shapes is None where no edge is near."""
    own = _edges(polygons)
    if not own:
        return
    edges = np.vstack([e for rings in own for e in rings])
    by_row = defaultdict(list)
    for cx, cy in sorted(_touched(edges, step)):
        by_row[cy].append(cx)
    for cy, xs in by_row.items():
        for cx, shapes in zip(xs, _row_shapes(own, cy, xs, step)):
            yield cx, cy, False, shapes
        cx0, cx1 = xs[0], xs[-1]
        free = _inside_rows(own, step, cx0, cx1, cy)
        free[np.array(xs) - cx0] = False
        for i in np.nonzero(free)[0]:
            yield cx0 + int(i), cy, True, None


def _struct(shapes: list | None) -> list | None:
    return shapes and [[{"odd": odd, "edges": [dict(zip(("ax", "ay", "bx", "by"), e)) for e in edges.tolist()]} for odd, edges in rings] for rings in shapes]


def covers(features: DataFrame) -> DataFrame:
    """Cells of features (body_id, feature, zone_id, polygons), written: one row (body_id, cx, cy, step, near) per cell that a feature of the body may touch, with those features in order.

    Cells are bounded by `grid_steps`, a feature is covered by itself, and what a cell carries grows with the edges near it, not with a whole polygon.
    """
    ship(features.sparkSession)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = pa.struct([(k, pa.float64()) for k in ("ax", "ay", "bx", "by")])
        shapes = pa.list_(pa.list_(pa.struct([("odd", pa.bool_()), ("edges", pa.list_(edge))])))
        schema = pa.schema([("body_id", pa.string()), ("cx", pa.int64()), ("cy", pa.int64()), ("step", pa.float64()), ("feature", pa.int32()), ("zone_id", pa.string()), ("inside", pa.bool_()), ("shapes", shapes)])
        for b in batches:
            for f in b.to_pylist():
                cells = iter(cover_of(f["polygons"], f["step"]))
                while some := [(f["body_id"], cx, cy, f["step"], f["feature"], f["zone_id"], inside, _struct(own)) for cx, cy, inside, own in itertools.islice(cells, 4096)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*some), schema)], schema=schema)

    rows = features.select("body_id", F.col("feature").cast("int").alias("feature"), "zone_id", "polygons").join(grid_steps(features), "body_id").mapInArrow(cover, _COVER)
    each = F.sort_array(F.collect_list(F.struct("feature", "zone_id", "inside", "shapes"))).alias("near")
    return written(rows.groupBy(*CELL).agg(F.first("step").alias("step"), each), "cells")


def _in_shapes(lon: Column, lat: Column, shapes: Column) -> Column:
    odd = lambda r: (F.size(F.filter(r["edges"], lambda e: crosses(lon, lat, e["ax"], e["ay"], e["bx"], e["by"]))) % 2 == 1) != r["odd"]
    return F.exists(shapes, lambda p: odd(p[0]) & ~F.exists(F.slice(p, 2, 1_000_000), odd))


def with_hits(points: DataFrame, features: DataFrame, x: str, y: str, name: str = "hits") -> DataFrame:
    """Adds the features (feature, zone_id) of the point's body that hold it, in order; none: an empty array.

    Cells and steps are broadcast where their bytes allow, else joined by a shuffle on (body, cell), which deals out a crowded body; either way a point meets one row.
    """
    cells = covers(features)
    steps = cells.groupBy("body_id").agg(F.first("step").alias("step"))
    lon, lat = F.col(x), F.col(y)
    at = points.join(small(steps), "body_id", "left").withColumns({"cx": F.floor(lon / F.col("step")), "cy": F.floor(lat / F.col("step"))}).drop("step")
    near = F.filter(F.coalesce("near", F.array()), lambda f: f["inside"] | _in_shapes(lon, lat, f["shapes"]))
    found = F.transform(near, lambda f: F.struct(f["feature"].alias("feature"), f["zone_id"].alias("zone_id")))
    return at.join(small(cells).drop("step"), CELL, "left").select(*points.columns, found.alias(name))
