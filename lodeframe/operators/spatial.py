"""Distance, overlap and crossing joins on uniform grids.

Every join is an equi-join on cells with the exact condition behind it. A cell's
side follows the greatest extent or distance, so each item meets a bounded number
of cells; a hot cell is split by AQE or dealt out by ``salt``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m, valid_point


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float | Column) -> Column:
    """All (cx, cy) cells that a box touches, as an array of structs."""
    lo_x, hi_x = F.floor(x0 / size), F.floor(x1 / size)
    lo_y, hi_y = F.floor(y0 / size), F.floor(y1 / size)
    return F.flatten(F.transform(F.sequence(lo_x, hi_x), lambda x: F.transform(F.sequence(lo_y, hi_y), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def within_distance(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], metres: float, max_lat: float = 80.0) -> DataFrame:
    """Pairs of rows no more than ``metres`` apart (haversine), with the distance as ``metres``.

    Column names of the sides must differ. Points that are null, NaN or out of range
    have no pair. A cell is as wide as the distance at ``max_lat``; each left point meets the
    cells that the distance reaches at its own latitude, all around where that holds a pole.
    Cells go around at 180 degrees.
    """
    lx, ly = (F.col(c).cast("double") for c in left_xy)
    rx, ry = (F.col(c).cast("double") for c in right_xy)
    step = metres / 111_000.0
    from math import cos, pi, radians, sin

    angle = min(metres / EARTH_RADIUS_M, pi / 2)
    around = max(1, int(360 * cos(radians(max_lat)) / step))  # columns of cells, a whole number of them around the globe
    wide = 360.0 / around
    wrapped = lambda c: F.struct(F.pmod(c["cx"], F.lit(around)).alias("cx"), c["cy"])
    far = F.when(F.abs(ly) + step >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.lit(sin(angle)) / F.cos(F.radians(ly)))) * 1.0001 + 1e-9)
    reach = F.array_distinct(F.transform(cells_of_box(lx - far, ly - step, lx + far, ly + step, wide), wrapped))
    a = left.where(valid_point(ly, lx)).withColumn("_c", F.explode(reach))
    b = right.where(valid_point(ry, rx)).withColumn("_c", F.struct(F.pmod(F.floor(rx / wide), F.lit(around)).alias("cx"), F.floor(ry / wide).alias("cy")))
    near = a.join(b, "_c").withColumn("metres", haversine_m(ly, lx, ry, rx)).where(F.col("metres") <= metres)
    return near.drop("_c")


def nearest_within(left: DataFrame, left_id: str, right: DataFrame, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], metres: float) -> DataFrame:
    """The nearest row of ``right`` for each row of ``left`` within a distance, ties to the least id: (left_id, right_id, metres).

    Rows with none in reach come out with nulls.
    """
    pairs = within_distance(left.select(left_id, *left_xy), right.select(right_id, *right_xy), left_xy, right_xy, metres)
    best = pairs.groupBy(left_id).agg(F.min(F.struct("metres", right_id)).alias("_b")).select(left_id, F.col(f"_b.{right_id}").alias(right_id), F.col("_b.metres").alias("metres"))
    return left.select(left_id).join(best, left_id, "left")


def boxes_meeting(a: DataFrame, b: DataFrame, abox: list[str], bbox: list[str], size: float) -> DataFrame:
    """Pairs of rows whose boxes (x0, y0, x1, y1 columns) meet, each pair once.

    A box lives on the level whose cells, ``size`` doubled as often as needed, are no
    smaller than it, and also lists its cells on the coarser levels in use: four cells a
    level at most, however large a box is. Two boxes are compared on the coarser of their
    levels, in the one cell that holds the lower left corner of their common part, so no distinct
    is needed. Boxes with a null or NaN side meet none.
    """
    A, B = [F.col(c) for c in abox], [F.col(c) for c in bbox]

    def level(box: list[Column]) -> Column:
        extent = F.greatest(box[2] - box[0], box[3] - box[1], F.lit(size))
        return F.ceil(F.log2(extent / size) - 1e-9).cast("int")

    known = lambda box: reduce(lambda p, q: p & q, [c.isNotNull() & ~F.isnan(c.cast("double")) for c in box])
    a, b = a.where(known(A)).withColumn("_ka", level(A)), b.where(known(B)).withColumn("_kb", level(B))
    used = sorted({r[0] for r in a.select("_ka").distinct().union(b.select("_kb").distinct()).collect()}) or [0]  # a few dozen levels at most
    at = F.array(*[F.lit(k) for k in used])
    spread = lambda df, box, k: df.withColumn("_k", F.explode(F.filter(at, lambda x: x >= F.col(k)))).withColumn(
        "_c", F.explode(cells_of_box(*box, F.lit(size) * F.pow(F.lit(2.0), F.col("_k"))))
    )
    cell = F.lit(size) * F.pow(F.lit(2.0), F.col("_k"))
    meet = (A[0] <= B[2]) & (B[0] <= A[2]) & (A[1] <= B[3]) & (B[1] <= A[3])
    home = (F.col("_c.cx") == F.floor(F.greatest(A[0], B[0]) / cell)) & (F.col("_c.cy") == F.floor(F.greatest(A[1], B[1]) / cell))
    pairs = spread(a, A, "_ka").join(spread(b, B, "_kb"), ["_k", "_c"])
    return pairs.where((F.col("_k") == F.greatest("_ka", "_kb")) & meet & home).drop("_c", "_k", "_ka", "_kb")


def neighbour_presence(points: DataFrame, others: DataFrame, point_xy: tuple[str, str], other_xy: tuple[str, str], size: float, offsets: list[tuple[int, int]]) -> DataFrame:
    """Points with ``near``: whether an other point lies in one of the cells at the offsets. Cells truncate toward zero."""
    cell = lambda c: (F.col(c) / F.lit(size)).cast("bigint")
    busy = others.where(F.col(other_xy[0]).isNotNull() & F.col(other_xy[1]).isNotNull()).select(cell(other_xy[0]).alias("_x"), cell(other_xy[1]).alias("_y")).distinct()
    offs = F.array(*[F.struct(F.lit(dx).cast("bigint").alias("dx"), F.lit(dy).cast("bigint").alias("dy")) for dx, dy in offsets])
    reach = busy.select(F.explode(F.transform(offs, lambda o: F.struct((F.col("_x") - o["dx"]).alias("_x"), (F.col("_y") - o["dy"]).alias("_y")))).alias("_c")).select("_c.*").distinct()
    p = points.withColumn("_x", cell(point_xy[0])).withColumn("_y", cell(point_xy[1]))
    return p.join(reach.withColumn("near", F.lit(True)), ["_x", "_y"], "left").withColumn("near", F.coalesce("near", F.lit(False))).drop("_x", "_y")
