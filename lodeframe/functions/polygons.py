"""Polygon assembly and repair in Arrow batches: rings to polygons, date line, containment, collapsed lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import RING, np_area

MULTIPOLYGON = f"array<array<{RING}>>"


def inside(x: float, y: float, ring: np.ndarray, tolerance: float = 0.0) -> bool:
    """Even-odd test; points within the tolerance of an edge count as inside."""
    a, b = ring, np.roll(ring, -1, axis=0)
    if tolerance:
        e, p = b - a, np.array([x, y]) - a
        t = np.clip((p * e).sum(1) / np.maximum((e * e).sum(1), 1e-300), 0, 1)
        if (np.hypot(*(p - t[:, None] * e).T) <= tolerance).any():
            return True
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((hit & (x < at)).sum() % 2)


def assemble(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings told apart by orientation (clockwise: outer, counterclockwise: hole) as polygons.

    A hole goes to the smallest outer ring that holds its first corner; one without
    becomes an outer ring. Rings without area are dropped.
    """
    outer = [r for r in rings if np_area(r) < 0]
    holes = [r for r in rings if np_area(r) > 0]
    polys = [[r] for r in outer]
    for h in holes:
        homes = [p for p in polys if inside(*h[0], p[0], 1e-12)]
        if homes:
            min(homes, key=lambda p: abs(np_area(p[0]))).append(h)
        else:
            polys.append([h[::-1]])
    return polys


def unwrap(ring: np.ndarray) -> np.ndarray:
    """A ring with longitudes shifted by full turns so that no step exceeds half a turn."""
    if not len(ring):
        return ring
    x = ring[:, 0].copy()
    x[1:] -= 360 * np.cumsum(np.round(np.diff(ring[:, 0]) / 360))
    return np.column_stack([x, ring[:, 1]])


def covers(container: np.ndarray, subject: np.ndarray, tolerance: float = 1e-9) -> bool:
    """Whether a ring holds another one: all corners inside and no proper crossing of edges."""
    if not all(inside(x, y, container, tolerance) for x, y in subject):
        return False
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for a, b in zip(subject, np.roll(subject, -1, axis=0)):
        for c, d in zip(container, np.roll(container, -1, axis=0)):
            if side(a, b, c) * side(a, b, d) < -(tolerance**2) and side(c, d, a) * side(c, d, b) < -(tolerance**2):
                return False
    return True


def _rings(t: str) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in r], dtype=float).reshape(-1, 2) for r in json.loads(t)]


def _out(r: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in r]


def to_multipolygon(rings: Column) -> Column:
    """Multipolygon of an array of oriented rings; null stays null."""

    @F.pandas_udf(MULTIPOLYGON)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [[_out(r) for r in p] for p in assemble(_rings(t))] for t in s], dtype=object)

    return run(F.to_json(rings))


def unwrap_ring(ring: Column) -> Column:
    """A ring made continuous across 180 degrees."""

    @F.pandas_udf(RING)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _out(unwrap(_rings(f"[{t}]")[0])) for t in s], dtype=object)

    return run(F.to_json(ring))


def ring_covers(container: Column, subject: Column, tolerance: float = 1e-9) -> Column:
    """Whether one ring holds another, edges included."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([None if x is None or y is None else covers(_rings(f"[{x}]")[0], _rings(f"[{y}]")[0], tolerance) for x, y in zip(a, b)], dtype=object)

    return run(F.to_json(container), F.to_json(subject))


def collapsed(line: Column, cell: float) -> Column:
    """Whether a line falls into one point on a grid of a cell's size."""
    q = F.array_distinct(F.transform(line, lambda p: F.struct(F.round(p["x"] / cell).alias("x"), F.round(p["y"] / cell).alias("y"))))
    return F.size(q) < 2


def repair_collapsed(line: Column, cell: float) -> Column:
    """A collapsed line stretched to one cell eastward from its first point; others stay."""
    first = F.element_at(line, 1)
    grown = F.array(first, F.struct((first["x"] + cell).alias("x"), first["y"].alias("y")))
    return F.when(collapsed(line, cell), grown).otherwise(line)
