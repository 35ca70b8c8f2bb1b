"""Points in regions and points near points, as grid equi-joins.

A region (a circle on the sphere, or an even-odd polygon) is covered by cells of
a world quadtree: interior cells lie wholly inside, boundary cells are passed by
its rim. Points probe the cells that hold them, one for each level in use. A
match on an interior cell is accepted at once, a match on a boundary cell is put
to the exact test.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import broadcast_if_small, materialize

#: Bytes of a cell, and of an edge that it carries, as broadcast.
CELL_BYTES, EDGE_BYTES = 120, 64
CELLS = "_level int, _ix bigint, _iy bigint, _inside boolean"


def _level_key(level: Column, ix: Column, iy: Column) -> Column:
    """One bigint for a cell: levels up to 20 need 5 + 22 + 21 bits."""
    return F.shiftleft(level.cast("bigint"), 48).bitwiseOR(F.shiftleft(ix.cast("bigint"), 24)).bitwiseOR(iy.cast("bigint"))


def circle_cells(regions: DataFrame, id_col: str, lat: str, lon: str, radius_m: Column, depth: int = 3) -> DataFrame:
    """Cover of circular regions: id, anchor, radius and cell columns, one row a cell.

    Regions with an anchor that is no valid point, or with a null, NaN or negative
    radius, have no cells.
    """
    src = regions.select(F.col(id_col).alias("_rid"), F.col(lat).cast("double").alias("_rlat"), F.col(lon).cast("double").alias("_rlon"), radius_m.cast("double").alias("_rad"))
    src = src.where(geo.valid_point(F.col("_rlat"), F.col("_rlon")) & (F.col("_rad") >= 0) & ~F.isnan("_rad"))

    def cover(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [
                (r[0], r[1], r[2], r[3], *c)
                for r in pdf.itertuples(index=False)
                for c in geo.circle_cover(r[1], r[2], r[3], depth)
            ]
            yield pd.DataFrame(rows, columns=["_rid", "_rlat", "_rlon", "_rad", "_level", "_ix", "_iy", "_inside"])

    kind = src.schema["_rid"].dataType.simpleString()
    out = src.mapInPandas(cover, f"_rid {kind}, _rlat double, _rlon double, _rad double, {CELLS}")
    return out.withColumn("_cell", _level_key(F.col("_level"), F.col("_ix"), F.col("_iy")))


def polygon_cells(regions: DataFrame, id_col: str, rings_col: str, depth: int = 4) -> DataFrame:
    """Cover of polygons given as array<array<struct<x,y>>>: id and cells.

    A boundary cell carries only the edges that pass it (``_edges``), its centre (``_cx``,
    ``_cy``) and whether that lies inside (``_centre``), never whole rings. Null or empty rings give no cells.
    """
    flat = regions.select(F.col(id_col).alias("_rid"), F.to_json(rings_col).alias("_json")).where("_json is not null")
    kind = flat.schema["_rid"].dataType.simpleString()

    def cover(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        names = ["_rid", "_level", "_ix", "_iy", "_inside", "_centre", "_edges"]
        for pdf in parts:
            for rid, js in pdf.itertuples(index=False):  # a polygon at a time: its cells may be many
                found = geo.polygon_cover([[(p["x"], p["y"]) for p in r] for r in json.loads(js)], depth)
                yield pd.DataFrame([(rid, *c[:5], [dict(zip(("ax", "ay", "bx", "by"), e)) for e in c[5]]) for c in found], columns=names)

    # covers cost by the corner: regions are dealt out however few files they come in
    flat = flat.repartition(regions.sparkSession.sparkContext.defaultParallelism)
    cells = flat.mapInPandas(cover, f"_rid {kind}, {CELLS}, _centre boolean, _edges array<struct<ax:double,ay:double,bx:double,by:double>>")
    size = F.lit(180.0) / F.pow(F.lit(2.0), F.col("_level"))
    middle = {"_cx": (F.col("_ix") + 0.5) * size - 180, "_cy": (F.col("_iy") + 0.5) * size - 90}
    return cells.withColumns(middle).withColumn("_cell", _level_key(F.col("_level"), F.col("_ix"), F.col("_iy")))


def _probe(points: DataFrame, lat: str, lon: str, levels: list[int]) -> DataFrame:
    """Points with one row for each level in use; invalid points have none."""
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    keys = []
    for k in levels:
        s = geo.cell_size(k)
        ix = F.floor((x + 180) / F.lit(s)).cast("bigint") % F.lit(2 << k)
        iy = F.least(F.floor((y + 90) / F.lit(s)).cast("bigint"), F.lit((1 << k) - 1).cast("bigint"))
        keys.append(_level_key(F.lit(k), ix, iy))
    return points.where(geo.valid_point(y, x)).withColumn("_cell", F.explode(F.array(*keys)))


def _join_cells(points: DataFrame, cells: DataFrame, lat: str, lon: str, exact: Column, keep: list[str]) -> DataFrame:
    cells = materialize(cells, "cells")
    edges = F.sum(F.greatest(F.size("_edges"), F.lit(0))) if "_edges" in cells.columns else F.lit(0)
    seen = cells.groupBy("_level").agg(F.count(F.lit(1)), edges).collect() or [(0, 0, 0)]  # at most 21 levels
    levels, size = sorted(r[0] for r in seen), sum(r[1] * CELL_BYTES + r[2] * EDGE_BYTES for r in seen)
    hit = _probe(points, lat, lon, levels).join(broadcast_if_small(cells, size, 1), "_cell").where(F.col("_inside") | exact)
    return hit.select(*keep)


def points_in_circles(
    points: DataFrame, point_id: str, lat: str, lon: str, regions: DataFrame, region_id: str, rlat: str, rlon: str, radius_m: Column, depth: int = 3
) -> DataFrame:
    """Pairs of a point and a circular region that contains it.

    Distance is great-circle on the sphere, the rim counts as inside. Points that
    are null, NaN or beyond 90 / 180 degrees have no pair; repeated rows keep
    their pairs. Columns: the two ids.
    """
    pts = points.select(F.col(point_id).alias("_pid"), F.col(lat).alias("_plat"), F.col(lon).alias("_plon"))
    cells = circle_cells(regions, region_id, rlat, rlon, radius_m, depth)
    exact = geo.haversine_m(F.col("_plat"), F.col("_plon"), F.col("_rlat"), F.col("_rlon")) <= F.col("_rad")
    out = _join_cells(pts, cells, "_plat", "_plon", exact, ["_pid", "_rid"])
    return out.withColumnsRenamed({"_pid": point_id, "_rid": region_id})


def points_in_polygons(points: DataFrame, point_id: str, x: str, y: str, regions: DataFrame, region_id: str, rings: str, depth: int = 4) -> DataFrame:
    """Pairs of a point and an even-odd polygon (rings of struct<x,y>) that holds it."""
    pts = points.select(F.col(point_id).alias("_pid"), F.col(y).alias("_plat"), F.col(x).alias("_plon"))
    cells = polygon_cells(regions, region_id, rings, depth)
    exact = F.col("_centre") != geo.across_edges(F.col("_cx"), F.col("_cy"), F.col("_plon"), F.col("_plat"), F.col("_edges"))
    out = _join_cells(pts, cells, "_plat", "_plon", exact, ["_pid", "_rid"])
    return out.withColumnsRenamed({"_pid": point_id, "_rid": region_id})


def locations_within(points: DataFrame, lat: str, lon: str, distance_m: float, max_lat: float = 85.0) -> DataFrame:
    """Pairs of distinct locations of ``points`` no more than ``distance_m`` apart.

    Works on distinct coordinates, so any number of rows at one location count
    once: join the result to the rows on lat and lon for membership. Columns
    lat, lon, n, lat2, lon2, n2, metres with (lat, lon) < (lat2, lon2). Beyond
    ``max_lat`` the strips of longitude become one cell. Invalid points are left out.
    """
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    spots = points.where(geo.valid_point(y, x)).groupBy(y.alias("lat"), x.alias("lon")).agg(F.count(F.lit(1)).alias("n"))
    step = distance_m / geo.EARTH_RADIUS_M * 57.29577951308232
    band = F.floor((F.col("lat") + 90) / F.lit(step)).cast("bigint")

    def width(b: Column) -> Column:
        # degrees of longitude that surely hold the distance anywhere in bands b-1..b+1
        worst = F.least(F.abs((b - 1) * step - 90), F.lit(90.0))
        worst = F.greatest(worst, F.least(F.abs((b + 2) * step - 90), F.lit(90.0)))
        return F.when(worst >= max_lat, F.lit(360.0)).otherwise(F.lit(step) / F.cos(F.radians(worst)) * 1.01)

    def strips(b: Column) -> Column:
        return F.greatest(F.floor(F.lit(360.0) / width(b)).cast("bigint"), F.lit(1).cast("bigint"))

    def strip(b: Column) -> Column:
        return F.floor((F.col("lon") + 180) / (F.lit(360.0) / strips(b))).cast("bigint") % strips(b)

    a = spots.withColumn("_b", F.explode(F.array(band - 1, band, band + 1)))
    around = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: (strip(F.col("_b")) + d + strips(F.col("_b"))) % strips(F.col("_b"))))
    a = a.withColumn("_s", F.explode(around))
    b = spots.withColumn("_b", band).withColumn("_s", strip(F.col("_b"))).withColumnsRenamed({"lat": "lat2", "lon": "lon2", "n": "n2"})
    metres = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    ordered = (F.col("lat") < F.col("lat2")) | ((F.col("lat") == F.col("lat2")) & (F.col("lon") < F.col("lon2")))
    return a.join(b, ["_b", "_s"]).where(ordered).withColumn("metres", metres).where(F.col("metres") <= distance_m).drop("_b", "_s")
