"""Polygons as a quadtree of cells: inner cells hold all of their points, boundary cells a few edges.

A cell without an edge is wholly inside or outside; one with more than a few
edges is cut into sixteen, until the finest size. Every boundary cell knows of
one point of its own whether it lies inside, so a point of the cell is told by
the edges between the two, and no outline is looked at as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEST, SOUTH = -192.0, -96.0
COARSEST, CUT = 16.0, 4
#: Where in a cell its known point lies, in parts of its size: off the places where outlines tend to run.
REFERENCE = (0.6180339887, 0.3819660113)
TOUCH = 1e-9


def cell_size(level: Column | int) -> Column | float:
    return COARSEST / CUT**level if isinstance(level, int) else F.lit(COARSEST) / F.pow(F.lit(float(CUT)), level)


def _ring_edges(rings: Sequence[Sequence[Sequence[float]]]) -> np.ndarray:
    """x1, y1, x2, y2 of all edges of a polygon's rings; a ring need not be closed."""
    parts = []
    for ring in rings or ():
        p = np.array([q[:2] for q in ring or () if q is not None and None not in q[:2]], float).reshape(-1, 2)
        if len(p) >= 2:
            parts.append(np.hstack([p, np.roll(p, -1, 0)]))
    edges = np.concatenate(parts) if parts else np.zeros((0, 4))
    return edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]


def _crossing(edges: np.ndarray, x0: float, y0: float, x: float, y: float) -> bool:
    """Whether an odd number of edges parts two points: up from the first at its x, then along at the second's y."""
    x1, y1, x2, y2 = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        up = (x1 > x0) != (x2 > x0)
        at = y1 + (x0 - x1) * (y2 - y1) / (x2 - x1)
        n = np.count_nonzero(up & ((at > y0) != (at > y)))
        along = (y1 > y) != (y2 > y)
        at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return (n + np.count_nonzero(along & ((at > x0) != (at > x)))) % 2 == 1


def _meets(edges: np.ndarray, x: float, y: float, size: float) -> np.ndarray:
    """Which edges come into a cell or touch it."""
    x1, y1, x2, y2 = edges.T
    x, y, size = x - TOUCH, y - TOUCH, size + 2 * TOUCH
    box = (np.minimum(x1, x2) <= x + size) & (np.maximum(x1, x2) >= x) & (np.minimum(y1, y2) <= y + size) & (np.maximum(y1, y2) >= y)
    side = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (x, x + size) for cy in (y, y + size)]
    return box & ~((np.minimum.reduce(side) > 0) | (np.maximum.reduce(side) < 0))


def cover_cells(rings: Sequence[Sequence[Sequence[float]]], most_edges: int, levels: int) -> Iterator[tuple[int, int, int, bool, float, float, np.ndarray]]:
    """Cells of one polygon: level, column, row, whether its known point lies inside, that point, edges (none: an inner cell)."""
    edges = _ring_edges(rings)
    if len(edges) < 3:
        return
    far = (float(edges[:, [0, 2]].min()) - 1.0, float(edges[:, [1, 3]].min()) - 1.0)
    low = [math.floor((edges[:, [i, i + 2]].min() - TOUCH - o) / COARSEST) for i, o in ((0, WEST), (1, SOUTH))]
    high = [math.floor((edges[:, [i, i + 2]].max() + TOUCH - o) / COARSEST) for i, o in ((0, WEST), (1, SOUTH))]
    todo = [(0, cx, cy, *far, False, edges) for cx in range(low[0], high[0] + 1) for cy in range(low[1], high[1] + 1)]
    while todo:
        level, cx, cy, x0, y0, known, own = todo.pop()
        size = cell_size(level)
        x, y = WEST + cx * size, SOUTH + cy * size
        here = own[_meets(own, x, y, size)]
        rx, ry = x + REFERENCE[0] * size, y + REFERENCE[1] * size
        inside = known != _crossing(own, x0, y0, rx, ry)
        if not len(here):
            if inside:
                yield level, cx, cy, True, rx, ry, here
        elif len(here) <= most_edges or level == levels:
            yield level, cx, cy, inside, rx, ry, here
        else:
            todo += [(level + 1, cx * CUT + i, cy * CUT + j, rx, ry, inside, here) for i in range(CUT) for j in range(CUT)]


def cover(polygons: DataFrame, keys: Sequence[str], shape: str = "polygons", most_edges: int = 12, levels: int = 5) -> DataFrame:
    """``keys``, part, level, cx, cy, inner, inside, rx, ry and edges (x1, y1, x2, y2) of the cells of every part of every polygon.

    Parts without three edges have no cells. A row's outline is cut in one task; rows are dealt to all.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, parts in enumerate(batch.column("shape").to_pylist()):
                for part, rings in enumerate(parts or ()):
                    found = list(cover_cells(rings, most_edges, levels))
                    if found:
                        level, cx, cy, inside, rx, ry, edges = zip(*found, strict=True)
                        n = len(found)
                        flat = pa.array(np.concatenate(edges).reshape(-1))
                        edge = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([4 * len(e) for e in edges])]).astype(np.int32), flat)
                        own = batch.column("keys").take(pa.array([i] * n))
                        yield pa.RecordBatch.from_arrays([own, *[pa.array([part] * n, pa.int32()), pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array([not len(e) for e in edges]), pa.array(inside), pa.array(rx), pa.array(ry)], edge], ["keys", "part", "level", "cx", "cy", "inner", "inside", "rx", "ry", "edges"])

    src = polygons.select(F.struct(*keys).alias("keys"), F.col(shape).alias("shape"))
    kind = src.schema["keys"].dataType.simpleString()
    cells = src.mapInArrow(fn, f"keys {kind}, part int, level int, cx long, cy long, inner boolean, inside boolean, rx double, ry double, edges array<double>")
    return cells.select("keys.*", "part", "level", "cx", "cy", "inner", "inside", "rx", "ry", "edges")


def _held(boundary: bool) -> Column:
    """Whether the cell's polygon holds the point (lon, lat), from the cell's edges alone."""
    x, y, rx, ry = (F.col(c) for c in ("lon", "lat", "rx", "ry"))
    edges = F.transform(F.sequence(F.lit(0), (F.size("edges") / 4).cast("int") - 1), lambda i: F.slice("edges", 4 * i + 1, 4))
    part = lambda e: (e[0], e[1], e[2], e[3])
    over = lambda a, b, z: (a > z) != (b > z)
    between = lambda z, a, b: (z > a) != (z > b)

    def parted(e: Column) -> Column:
        x1, y1, x2, y2 = part(e)
        up = over(x1, x2, rx) & between(y1 + (rx - x1) * (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0)), ry, y)
        along = over(y1, y2, y) & between(x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)), rx, x)
        return F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(along, F.lit(False)).cast("int")

    def touched(e: Column) -> Column:
        x1, y1, x2, y2 = part(e)
        line = F.abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) < TOUCH
        return line & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))

    inside = (F.col("inside").cast("int") + F.aggregate(edges, F.lit(0), lambda n, e: n + parted(e))) % 2 == 1
    return F.col("inner") | inside | (F.exists(edges, touched) if boundary else F.lit(False))


def candidates(points: DataFrame, point: str, cells: DataFrame, equal: Sequence[str] = (), levels: int = 5) -> DataFrame:
    """Points with the cells that they lie in: one a part at most, as a part's cells are apart."""
    level = F.explode(F.array(*[F.lit(k) for k in range(levels + 1)])).alias("level")
    at = points.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").select(point, "lon", "lat", *equal, level)
    size = cell_size(F.col("level"))
    at = at.withColumns({"cx": F.floor((F.col("lon") - WEST) / size), "cy": F.floor((F.col("lat") - SOUTH) / size)})
    return at.join(cells, ["level", "cx", "cy", *equal])


def contains(points: DataFrame, point: str, polygons: DataFrame, geo: str, shape: str = "polygons", equal: Sequence[str] = (), boundary: bool = True, most_edges: int = 12, levels: int = 5) -> DataFrame:
    """Pairs of ``point`` and ``geo`` where a polygon holds the point (lon, lat).

    ``shape`` is an array of polygons, each an array of rings (the first outside,
    the others holes), each an array of [lon, lat]. ``equal`` are columns that
    must agree on both sides. A point meets one cell of a polygon: an inner one
    holds it as it is, in a boundary one it meets the cell's few edges. Points on
    an edge count if ``boundary``. Points without a coordinate and polygons
    without three edges hold nothing; overlapping parts count once.
    """
    cells = cover(polygons, [geo, *equal], shape, most_edges, levels)
    return candidates(points, point, cells, equal, levels).where(_held(boundary)).select(point, geo).distinct()
