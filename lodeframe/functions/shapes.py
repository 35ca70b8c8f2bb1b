"""Shapes as nested arrays: measures as column expressions, cutting and simplifying in Arrow batches.

A ring is array<struct<x double, y double>>, a polygon array<ring>, a line like a ring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def ring(*xy: tuple[Column, Column]) -> Column:
    """A ring of given corners."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in xy])


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle as a ring."""
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def _edges(r: Column, f) -> Column:
    """Sum over the edges of a closed ring."""
    n = F.size(r)
    at = lambda i: F.element_at(r, i)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, i: acc + f(at(F.when(i == 1, n).otherwise(i - 1)), at(i)))


def signed_area(r: Column) -> Column:
    """Shoelace area about the first corner, positive counterclockwise; 0 below three corners."""
    x0, y0 = F.element_at(r, 1)["x"], F.element_at(r, 1)["y"]
    s = _edges(r, lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0)) / 2
    return F.when(F.size(r) >= 3, s).otherwise(F.lit(0.0))


def vertex_mean(r: Column) -> Column:
    """Mean of the corners as a struct; null for an empty ring."""
    n = F.nullif(F.size(r), F.lit(0))
    return F.struct((F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p["x"]) / n).alias("x"), (F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p["y"]) / n).alias("y"))


def centroid(r: Column) -> Column:
    """Area-weighted centroid as a struct; the mean of the corners where the area is nil."""
    a = signed_area(r)
    x0, y0 = F.element_at(r, 1)["x"], F.element_at(r, 1)["y"]
    cross = lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)
    cx = x0 + _edges(r, lambda p, q: (p["x"] + q["x"] - 2 * x0) * cross(p, q)) / (6 * F.nullif(a, F.lit(0.0)))
    cy = y0 + _edges(r, lambda p, q: (p["y"] + q["y"] - 2 * y0) * cross(p, q)) / (6 * F.nullif(a, F.lit(0.0)))
    m = vertex_mean(r)
    return F.struct(F.coalesce(cx, m["x"]).alias("x"), F.coalesce(cy, m["y"]).alias("y"))


def bbox(r: Column) -> Column:
    """Bounds of a ring as struct<x0,y0,x1,y1>."""
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def decimate(r: Column, target: int = 40, most: int = 80) -> Column:
    """Every k-th corner, with k from the length, at most ``most``."""
    step = F.greatest(F.lit(1), F.floor(F.size(r) / target).cast("int"))
    return F.slice(F.filter(r, lambda p, i: i % step == 0), 1, most)


def line_length_m(line: Column) -> Column:
    """Haversine length of a line of lon/lat points."""
    from .geo import haversine_m

    n = F.size(line)
    at = lambda i: F.element_at(line, i)
    total = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.lit(0.0), lambda acc, i: acc + haversine_m(at(i - 1)["y"], at(i - 1)["x"], at(i)["y"], at(i)["x"]))
    return F.when(n >= 2, total).otherwise(F.lit(0.0))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments cross properly (each end of one strictly beside the other)."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def segments_meet(a: Column, b: Column, c: Column, d: Column, tolerance: float = 1e-12) -> Column:
    """Whether two closed segments have a point in common, touching ends and collinear overlaps included."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    turn = lambda p, q, r: F.when(F.abs(side(p, q, r)) <= tolerance, 0).otherwise(F.signum(side(p, q, r)).cast("int"))
    within = lambda p, q, r, k: (r[k] >= F.least(p[k], q[k]) - tolerance) & (r[k] <= F.greatest(p[k], q[k]) + tolerance)
    on = lambda p, q, r: (turn(p, q, r) == 0) & within(p, q, r, "x") & within(p, q, r, "y")
    apart = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    return apart | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def mercator(lon: Column, lat: Column) -> Column:
    """World position 0..1 of the web Mercator plane."""
    s = F.sin(F.radians(lat))
    return F.struct(((lon + 180) / 360).alias("x"), (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)).alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    """Longitude and latitude of a world position."""
    return F.struct((x * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh((0.5 - y) * 2 * math.pi))).alias("lat"))


def tile_of(lon: Column, lat: Column, zoom: int) -> Column:
    """Map tile of a point, clamped to the grid."""
    w, n = mercator(lon, lat), 1 << zoom
    cell = lambda v: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return F.struct(cell(w["x"]).alias("x"), cell(w["y"]).alias("y"))


# WGS 84, the scale on the central meridian, and the coefficients of the Krueger series in powers of the third flattening.
WGS84_A, WGS84_F, UTM_SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996
_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BACKWARD = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_LATITUDE = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def _series(coefficients: list[float], term) -> Column:
    return reduce(lambda a, b: a + b, [c * term(2 * (k + 1)) for k, c in enumerate(coefficients)])


def utm_to_lonlat(easting: Column, northing: Column, zone: Column, northern: bool = True) -> Column:
    """Longitude and latitude of a UTM position, to a micrometre or so within the zone."""
    up = (northing - (0.0 if northern else 1e7)) / (UTM_SCALE * _RECTIFYING)
    across = (easting - 5e5) / (UTM_SCALE * _RECTIFYING)
    xi = up - _series(_BACKWARD, lambda k: F.sin(k * up) * F.cosh(k * across))
    eta = across - _series(_BACKWARD, lambda k: F.cos(k * up) * F.sinh(k * across))
    conformal = F.asin(F.sin(xi) / F.cosh(eta))
    lat = conformal + _series(_LATITUDE, lambda k: F.sin(k * conformal))
    lon = F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + zone * 6 - 183
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def lonlat_to_utm(lon: Column, lat: Column, zone: Column, northern: bool = True) -> Column:
    """UTM position of a point in a zone, as struct<easting,northing>."""
    e, phi, off = 2 * math.sqrt(_N) / (1 + _N), F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    up = xi + _series(_FORWARD, lambda k: F.sin(k * xi) * F.cosh(k * eta))
    across = eta + _series(_FORWARD, lambda k: F.cos(k * xi) * F.sinh(k * eta))
    k = UTM_SCALE * _RECTIFYING
    return F.struct((5e5 + k * across).alias("easting"), ((0.0 if northern else 1e7) + k * up).alias("northing"))


# --- numpy kernels --------------------------------------------------------------------------------


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a ring inside a convex counterclockwise ring (Sutherland-Hodgman)."""
    out = subject
    for p, q in zip(window, np.roll(window, -1, axis=0)):
        if not len(out):
            break
        e = q - p
        side = e[0] * (out[:, 1] - p[1]) - e[1] * (out[:, 0] - p[0])
        new = []
        for i in range(len(out)):
            j = i - 1
            if (side[i] >= 0) != (side[j] >= 0):
                t = side[j] / (side[j] - side[i])
                new.append(out[j] + t * (out[i] - out[j]))
            if side[i] >= 0:
                new.append(out[i])
        out = np.array(new).reshape(-1, 2)
    return out


def np_area(r: np.ndarray) -> float:
    if len(r) < 3:
        return 0.0
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def union_area(boxes: np.ndarray) -> float:
    """Area of the union of rectangles (x0, y0, x1, y1) by strips between their sides."""
    b = boxes[(boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])]
    if not len(b):
        return 0.0
    xs, total = np.unique(b[:, [0, 2]]), 0.0
    for lo, hi in zip(xs[:-1], xs[1:]):
        y = b[(b[:, 0] <= lo) & (b[:, 2] >= hi)][:, [1, 3]]
        y = y[y[:, 0].argsort()]
        end = -np.inf
        for a, c in y:
            total += (hi - lo) * max(0.0, c - max(a, end))
            end = max(end, c)
    return float(total)


def douglas_peucker(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Simplified line: ends stay, a point stays if it is farther than the tolerance from its chord."""
    n = len(line)
    keep = np.zeros(n, dtype=bool)
    if n <= 2:
        return line
    keep[[0, -1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b <= a + 1:
            continue
        p, q, mid = line[a], line[b], line[a + 1 : b]
        e = q - p
        m = float(e @ e)
        t = np.clip((mid - p) @ e / m, 0, 1)[:, None] if m > 0 else 0.0
        d = np.hypot(*(mid - (p + t * e)).T)
        i = int(d.argmax())
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return line[keep]


def _ring_udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import json

        read = lambda t: np.array([(p["x"], p["y"]) for p in json.loads(t)], dtype=float).reshape(-1, 2)
        for a, b in parts:
            yield pd.Series([f(read(x), read(y) if isinstance(y, str) else y) if x is not None and y is not None else None for x, y in zip(a, b)])

    return run


def overlap_area(a: Column, convex: Column) -> Column:
    """Area that a ring shares with a convex counterclockwise ring."""
    return _ring_udf(lambda s, w: abs(np_area(clip_convex(s, w))), "double")(F.to_json(a), F.to_json(convex))


def clip(a: Column, convex: Column) -> Column:
    """Ring of the part inside a convex counterclockwise ring."""
    return _ring_udf(lambda s, w: [{"x": float(x), "y": float(y)} for x, y in clip_convex(s, w)], RING)(F.to_json(a), F.to_json(convex))


def simplify(line: Column, tolerance: float) -> Column:
    """Douglas-Peucker simplification of a line."""
    return _ring_udf(lambda s, t: [{"x": float(x), "y": float(y)} for x, y in douglas_peucker(s, t)], RING)(F.to_json(line), F.lit(float(tolerance)))


def interior_point(r: Column) -> Column:
    """A point surely inside a ring: the middle of the widest stretch on a scan line through it; null for an empty area."""

    @F.pandas_udf("struct<x:double,y:double>")
    def run(s: pd.Series) -> pd.DataFrame:
        import json

        out = []
        for t in s:
            p = np.array([(q["x"], q["y"]) for q in json.loads(t)], dtype=float).reshape(-1, 2) if t is not None else np.zeros((0, 2))
            if abs(np_area(p)) == 0:
                out.append((None, None))
                continue
            ys = np.unique(p[:, 1])
            i = int(np.diff(ys).argmax())
            y = (ys[i] + ys[i + 1]) / 2
            a, b = p, np.roll(p, -1, axis=0)
            hit = (a[:, 1] > y) != (b[:, 1] > y)
            xs = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
            w = xs[1::2] - xs[::2]
            j = int(w.argmax())
            out.append((float((xs[2 * j] + xs[2 * j + 1]) / 2), float(y)))
        return pd.DataFrame(out, columns=["x", "y"])

    return run(F.to_json(r))
