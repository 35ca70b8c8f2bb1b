"""Geometry as column expressions and as numpy kernels for the planners of grid joins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres (fixed value).
EARTH_RADIUS_M = 6_371_008.8


def valid_point(lat: Column, lon: Column) -> Column:
    """True where both numbers are there, finite and within 90 / 180 degrees."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return ok & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres; null where a coordinate is null or NaN."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would pass over a null and answer half the globe
    return 2 * radius * F.asin(F.when(h <= 1, F.sqrt(h)).when(h < 1.1, F.lit(1.0)))


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres, 111,320 m a degree."""
    dx = (lon2 - lon1) * F.cos(F.radians(lat1))
    dy = lat2 - lat1
    return F.sqrt(dx * dx + dy * dy) * 111_320.0


def plane_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat0: float) -> Column:
    """Distance in km in a local plane about latitude lat0."""
    kx = 111.320 * math.cos(math.radians(lat0))
    dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * 110.574
    return F.sqrt(dx * dx + dy * dy)


def cell_trunc(c: Column, size: float) -> Column:
    """Grid cell that truncates toward zero."""
    return (c / F.lit(size)).cast("bigint")


def cell_floor(c: Column, size: float) -> Column:
    """Grid cell by floor."""
    return F.floor(c / F.lit(size))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Plane distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def ring_contains(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring, an array of struct<x,y>.

    A ring of fewer than three points contains nothing; a point on the boundary
    counts for one of the two neighbours only.
    """
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when(_crosses(x, y, F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))), 1).otherwise(0),
    )
    return F.when(n >= 3, crossings % 2 == 1).otherwise(F.lit(False))


def _crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
    at = (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax
    return ((ay > y) != (by > y)) & F.coalesce(x < at, F.lit(False))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of struct<x,y> (positive: counterclockwise)."""
    n = F.size(ring)
    return F.when(
        n >= 3,
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            F.lit(0.0),
            lambda acc, i: acc
            + F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))["x"] * F.element_at(ring, i)["y"]
            - F.element_at(ring, i)["x"] * F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))["y"],
        )
        / 2,
    ).otherwise(F.lit(0.0))


# --- numpy kernels of the coverage planner ---------------------------------------------------


def np_haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def cell_size(level: int) -> float:
    """Side in degrees of a cell of the world grid at a level."""
    return 180.0 / (1 << level)


def circle_cover(lat: float, lon: float, radius_m: float, depth: int = 3, max_level: int = 20) -> list[tuple[int, int, int, bool]]:
    """Adaptive cover of a circle on the sphere: (level, ix, iy, interior).

    Starts from cells about as wide as the circle and splits only the cells that
    its rim passes, ``depth`` times. The number of cells is bounded by the depth,
    not by the radius. ix wraps around at 180 degrees.
    """
    deg = math.degrees(radius_m / EARTH_RADIUS_M)
    level = 0
    while level < max_level - depth and cell_size(level + 1) >= max(deg, 1e-5):
        level += 1
    s = cell_size(level)
    top = 90 - abs(lat)
    half = 180.0 if deg >= top else math.degrees(math.asin(min(1.0, math.sin(math.radians(deg)) / math.cos(math.radians(lat)))))
    lo_y, hi_y = math.floor((max(-90, lat - deg) + 90) / s), math.floor((min(90, lat + deg) + 90) / s)
    if half >= 179.99:
        xs = np.arange(0, 2 << level)
    else:
        xs = np.arange(math.floor((lon - half + 180) / s), math.floor((lon + half + 180) / s) + 1)
        if len(xs) >= 2 << level:
            xs = np.arange(0, 2 << level)
    ix, iy = (a.ravel() for a in np.meshgrid(xs, np.arange(lo_y, hi_y + 1)))
    out: list[tuple[int, int, int, bool]] = []
    for step in range(depth + 1):
        s = cell_size(level)
        x0, y0 = ix * s - 180, iy * s - 90
        near, far = _cell_range(lat, lon, x0, y0, s)
        keep = near <= radius_m * (1 + 1e-9) + 0.01
        inside = far <= radius_m * (1 - 1e-9) - 0.01
        wrap = 2 << level
        if step == depth:
            done, split = keep, np.zeros_like(keep)
        else:
            done, split = keep & inside, keep & ~inside
        out += [(level, int(a), int(b), bool(c)) for a, b, c in zip(ix[done] % wrap, iy[done], inside[done])]
        if not split.any():
            break
        sx, sy = ix[split], iy[split]
        ix = np.concatenate([2 * sx, 2 * sx + 1, 2 * sx, 2 * sx + 1])
        iy = np.concatenate([2 * sy, 2 * sy, 2 * sy + 1, 2 * sy + 1])
        level += 1
    return sorted(set(out))


def _cell_range(lat: float, lon: float, x0, y0, s: float):
    """Least and greatest distance in metres from a point to each cell."""
    x1, y1 = x0 + s, np.minimum(y0 + s, 90.0)
    far = np.maximum.reduce([np_haversine(lat, lon, y, x) for y in (y0, y1) for x in (x0, x1)])
    # beyond half the globe the farthest point may lie inside an edge
    far = np.where(s > 45, np.pi * EARTH_RADIUS_M, far)
    mid = (x0 + x1) / 2
    around = mid + 360 * np.round((lon - mid) / 360)
    dlon = np.maximum(0, np.abs(lon - around) - s / 2)
    inside_x = dlon == 0
    # on the nearest meridian the nearest latitude is closed-form, then clamped
    phi = np.degrees(np.arctan2(np.sin(math.radians(lat)), np.cos(math.radians(lat)) * np.cos(np.radians(np.where(inside_x, 0, dlon)))))
    at = np.clip(phi, y0, y1)
    near = np_haversine(lat, 0.0, at, dlon)
    for y in (y0, y1):
        near = np.minimum(near, np_haversine(lat, 0.0, y, dlon))
    return near, far


def polygon_cover(rings: list[list[tuple[float, float]]], depth: int = 4, max_level: int = 20, most_edges: int = 64) -> list[tuple[int, int, int, bool, bool, list[tuple]]]:
    """Adaptive cover of an even-odd polygon in lon/lat: (level, ix, iy, interior, centre, edges).

    A cell that no edge passes lies wholly inside or outside, which its centre
    decides; cells that an edge passes are split ``depth`` times, and further while
    more than ``most_edges`` pass and the grid has a finer level. A boundary cell has
    the edges that pass it and whether its centre lies inside: enough for the exact test of a
    point in it. Empty rings give no cells. Rings don't cross 180 degrees.
    """
    edges = np.array(
        [(a[0], a[1], b[0], b[1]) for r in rings if r is not None and len(r) >= 3 for a, b in zip(r, [*r[1:], r[0]])],
        dtype=float,
    ).reshape(-1, 4)
    if not len(edges):
        return []
    xlo, xhi = edges[:, [0, 2]].min(), edges[:, [0, 2]].max()
    ylo, yhi = edges[:, [1, 3]].min(), edges[:, [1, 3]].max()
    level = 0
    while level < max_level - depth and cell_size(level + 1) >= max(xhi - xlo, yhi - ylo, 1e-5):
        level += 1
    s = cell_size(level)
    xs, ys = np.arange(math.floor((xlo + 180) / s), math.floor((xhi + 180) / s) + 1), np.arange(math.floor((ylo + 90) / s), math.floor((yhi + 90) / s) + 1)
    ix, iy = (a.ravel() for a in np.meshgrid(xs, ys))
    # cells of one level at a time, with the pairs of a cell and an edge that may pass it
    cell, edge = (a.ravel() for a in np.meshgrid(np.arange(len(ix)), np.arange(len(edges))))
    last, out = level + depth, []
    while len(ix):
        s = cell_size(level)
        x0, y0 = ix * s - 180, iy * s - 90
        hit = _edges_in_box(edges[edge], x0[cell] - 1e-12, y0[cell] - 1e-12, x0[cell] + s + 1e-12, y0[cell] + s + 1e-12)
        cell, edge = cell[hit], edge[hit]
        passing = np.bincount(cell, minlength=len(ix))
        split = (passing > 0) & ((level < last) | (passing > most_edges)) & (level < max_level)
        done = np.flatnonzero(~split)
        centre = np_even_odd(edges, x0[done] + s / 2, y0[done] + s / 2)
        order = np.argsort(cell, kind="stable")
        ends = np.cumsum(passing)
        for c, inside in zip(done, centre):
            if passing[c] or inside:
                own = edges[edge[order[ends[c] - passing[c] : ends[c]]]]
                out.append((level, int(ix[c]) % (2 << level), int(iy[c]), not passing[c], bool(inside), [tuple(e) for e in own.tolist()]))
        place = np.cumsum(split) - 1
        kept = split[cell]
        cell, edge, n = place[cell[kept]], edge[kept], int(split.sum())
        ix, iy = ix[split], iy[split]
        ix, iy = np.concatenate([2 * ix + i for i in (0, 1) for _ in (0, 1)]), np.concatenate([2 * iy + j for _ in (0, 1) for j in (0, 1)])
        cell, edge = np.concatenate([cell + q * n for q in range(4)]), np.tile(edge, 4)
        level += 1
    return sorted(out)


def np_even_odd(edges, x, y, at_once: int = 1 << 22):
    """Even-odd test of points (arrays) against all edges, in blocks of bounded size."""
    ax, ay, bx, by = edges.T
    out, step = np.zeros(len(x), dtype=bool), max(1, at_once // len(edges))
    for i in range(0, len(x), step):
        px, py = x[i : i + step, None], y[i : i + step, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (bx - ax) * (py - ay) / (by - ay) + ax
        out[i : i + step] = (((ay > py) != (by > py)) & (px < at)).sum(1) % 2 == 1
    return out


def across_edges(cx: Column, cy: Column, px: Column, py: Column, edges: Column) -> Column:
    """Whether the way from a cell's centre to a point crosses its edges an odd number of times."""
    dx, dy = px - cx, py - cy

    def crossed(e: Column) -> Column:
        # sides of the edge's ends as seen along the way, and of the way's ends as seen along the edge
        a = dx * (e["ay"] - cy) - dy * (e["ax"] - cx)
        b = dx * (e["by"] - cy) - dy * (e["bx"] - cx)
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        c = ex * (cy - e["ay"]) - ey * (cx - e["ax"])
        d = ex * (py - e["ay"]) - ey * (px - e["ax"])
        return ((a >= 0) != (b >= 0)) & ((c >= 0) != (d >= 0))

    return F.size(F.filter(edges, crossed)) % 2 == 1


def _edges_in_box(e, x0, y0, x1, y1):
    """Which segments pass a box (Liang-Barsky)."""
    ax, ay, bx, by = e.T
    dx, dy = bx - ax, by - ay
    lo, hi, ok = np.zeros(len(e)), np.ones(len(e)), np.ones(len(e), dtype=bool)
    for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = q / p
        lo = np.where(p < 0, np.maximum(lo, t), lo)
        hi = np.where(p > 0, np.minimum(hi, t), hi)
        ok &= ~((p == 0) & (q < 0))
    return ok & (lo <= hi)
