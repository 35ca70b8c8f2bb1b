"""Spatial joins and shape functions over rows, sites and districts, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import shapes as S
from ..operators import regions, spatial
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

# Districts as diamonds in degrees: |dx| + |dy| <= radius_km / 100.
_D = "districts WHERE lat IS NOT NULL AND lon IS NOT NULL"
_OK = "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 180"
_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def _diamonds(spark, d):
    t = table(spark, d, "districts").where("lat is not null and lon is not null").withColumn("r", F.col("radius_km") / 100 + 0.0000013)
    x, y, r = F.col("lon"), F.col("lat"), F.col("r")
    return t.select("district_id", "state", "lat", "lon", "r", F.array(S.ring((x + r, y), (x, y + r), (x - r, y), (x, y - r))).alias("rings"))


def _points(spark, d):
    return table(spark, d, "rows_igs_b11").select("row_id", "lat", "lon")


_IN = f"SELECT r.row_id, x.district_id FROM (SELECT row_id, lat, lon FROM rows_igs_b11 WHERE {_OK}) r JOIN (SELECT district_id, lat, lon, radius_km / 100 + 0.0000013 AS rr FROM {_D}) x ON abs(r.lon - x.lon) + abs(r.lat - x.lat) < x.rr"


@query("j02_points_in_polygons", _IN)
def j02(spark, d):
    """All polygons that hold a point."""
    return regions.points_in_polygons(_points(spark, d), "row_id", "lon", "lat", _diamonds(spark, d), "district_id", "rings")


@query("j03_last_hit_wins", f"SELECT row_id, max(district_id) AS district_id FROM ({_IN}) GROUP BY 1")
def j03(spark, d):
    return j02(spark, d).groupBy("row_id").agg(F.max("district_id").alias("district_id"))


@query("j04_first_polygon", f"SELECT p.row_id, q.district_id FROM rows_igs_b11 p LEFT JOIN (SELECT row_id, min(district_id) AS district_id FROM ({_IN}) GROUP BY 1) q USING (row_id)")
def j04(spark, d):
    hit = j02(spark, d).groupBy("row_id").agg(F.min("district_id").alias("district_id"))
    return _points(spark, d).select("row_id").join(hit, "row_id", "left")


@query("j05_point_in_any_region", f"SELECT DISTINCT row_id FROM ({_IN})")
def j05(spark, d):
    """Semi-join by the three classes of cells: inside, outside, boundary."""
    return j02(spark, d).select("row_id").distinct()


@query(
    "j06_neighbour_presence",
    f"""WITH b AS (SELECT DISTINCT CAST(trunc(longitude / 0.02) AS BIGINT) AS cx, CAST(trunc(latitude / 0.02) AS BIGINT) AS cy FROM mrds_sites WHERE longitude IS NOT NULL AND latitude IS NOT NULL),
            o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
            n AS (SELECT DISTINCT cx - dx AS cx, cy - dy AS cy FROM b, o)
       SELECT row_id, n.cx IS NOT NULL AS near FROM (SELECT * FROM rows_igs_b11 WHERE {_OK}) r LEFT JOIN n ON n.cx = CAST(trunc(r.lon / 0.02) AS BIGINT) AND n.cy = CAST(trunc(r.lat / 0.02) AS BIGINT)""",
)
def j06(spark, d):
    offsets = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    return spatial.neighbour_presence(_points(spark, d).where(G.valid_point(F.col("lat"), F.col("lon"))), table(spark, d, "mrds_sites"), ("lon", "lat"), ("longitude", "latitude"), 0.02, offsets).select("row_id", "near")


@query(
    "j07_nearest_capped",
    f"""WITH r AS (SELECT row_id, lat, lon FROM rows_igs_b11 WHERE {_OK}), s AS (SELECT dep_id, latitude AS lat, longitude AS lon FROM mrds_sites WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude) <= 90 AND abs(longitude) <= 180),
        p AS (SELECT row_id, {_HAV.format(a='r.', b='s.')} AS m FROM r JOIN s ON abs(r.lat - s.lat) < 0.05)
        SELECT x.row_id, round(least(coalesce(min(m), 5000), 5000), 3) AS metres FROM rows_igs_b11 x LEFT JOIN p ON p.row_id = x.row_id AND m <= 5000 GROUP BY 1""",
)
def j07(spark, d):
    """Distance to the nearest site; 5000 m where none is nearer."""
    s = table(spark, d, "mrds_sites").select("dep_id", "longitude", "latitude")
    n = spatial.nearest_within(_points(spark, d), "row_id", s, "dep_id", ("lon", "lat"), ("longitude", "latitude"), 5000.0)
    return n.select("row_id", F.round(F.coalesce("metres", F.lit(5000.0)), 3).alias("metres"))


@query(
    "j09_sites_within_radius",
    f"""SELECT x.district_id, count(*) AS n FROM (SELECT district_id, lat, lon FROM {_D}) x JOIN (SELECT latitude AS lat, longitude AS lon FROM mrds_sites WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude) <= 90 AND abs(longitude) <= 180) s
        ON {_HAV.format(a='x.', b='s.')} <= 10000 GROUP BY 1""",
)
def j09(spark, d):
    x = table(spark, d, "districts").select("district_id", "lat", "lon")
    s = table(spark, d, "mrds_sites").select("dep_id", "longitude", "latitude")
    return spatial.within_distance(x, s, ("lon", "lat"), ("longitude", "latitude"), 10_000.0).groupBy("district_id").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark, d):
    """A segment for each district, its direction from its id."""
    t = table(spark, d, "districts").where("lat is not null and lon is not null")
    k = F.col("district_id") % 7 - 3
    return t.select("district_id", F.col("lon").alias("ax"), F.col("lat").alias("ay"), (F.col("lon") + 0.2).alias("bx"), (F.col("lat") + k * 0.05).alias("by"))


_L = f"(SELECT district_id, lon AS ax, lat AS ay, lon + 0.2 AS bx, lat + (district_id % 7 - 3) * 0.05 AS by_ FROM {_D})"


@query(
    "j10_nearest_segment",
    f"""WITH p AS (SELECT r.row_id, l.*, r.lon AS px, r.lat AS py, greatest(0.0, least(1.0, ((r.lon - ax) * (bx - ax) + (r.lat - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t
                   FROM (SELECT row_id, lat, lon FROM rows_igs_b11 WHERE {_OK}) r JOIN {_L} l ON r.lon BETWEEN l.ax - 0.1 AND l.bx + 0.1 AND r.lat BETWEEN least(ay, by_) - 0.1 AND greatest(ay, by_) + 0.1)
        SELECT row_id, round(min(sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (by_ - ay)), 2))), 6) AS dist FROM p WHERE sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (by_ - ay)), 2)) <= 0.1 GROUP BY 1""",
)
def j10(spark, d):
    """Nearest segment within a reach; segments are laid in all cells they may matter to, so long ones aren't missed."""
    reach, size = 0.1, 0.25
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    segs = _lines(spark, d).withColumn("_c", F.explode(spatial.cells_of_box(F.col("ax") - reach, lo - reach, F.col("bx") + reach, hi + reach, size)))
    pts = _points(spark, d).where(G.valid_point(F.col("lat"), F.col("lon"))).withColumn("_c", F.struct(F.floor(F.col("lon") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy")))
    dist = G.point_segment_distance(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pts.join(segs.drop("district_id"), "_c").withColumn("dist", dist).where(F.col("dist") <= reach).groupBy("row_id").agg(F.round(F.min("dist"), 6).alias("dist"))


def _side(p, q, r):
    return f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


@query(
    "j11_segment_crossings",
    f"""WITH l AS (SELECT district_id AS id, ax, ay, bx, by_ AS by FROM {_L})
        SELECT a.id, b.id AS id2 FROM l a JOIN l b ON a.id < b.id AND a.ax <= b.bx AND b.ax <= a.bx
        WHERE ((a.bx - a.ax) * (b.ay - a.ay) - (a.by - a.ay) * (b.ax - a.ax)) * ((a.bx - a.ax) * (b.by - a.ay) - (a.by - a.ay) * (b.bx - a.ax)) < 0
          AND ((b.bx - b.ax) * (a.ay - b.ay) - (b.by - b.ay) * (a.ax - b.ax)) * ((b.bx - b.ax) * (a.by - b.ay) - (b.by - b.ay) * (a.bx - b.ax)) < 0""",
)
def j11(spark, d):
    """Crossings of segments with one another, each pair once."""
    b = lambda t, s: t.select(*[F.col(c).alias(c + s) for c in ("district_id", "ax", "ay", "bx", "by")], F.least("ay", "by").alias("lo" + s), F.greatest("ay", "by").alias("hi" + s))
    one, two = b(_lines(spark, d), "1"), b(_lines(spark, d), "2")
    meet = spatial.boxes_meeting(one, two, ["ax1", "lo1", "bx1", "hi1"], ["ax2", "lo2", "bx2", "hi2"], 0.3).where("district_id1 < district_id2")
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return meet.where(S.segments_cross(p("ax1", "ay1"), p("bx1", "by1"), p("ax2", "ay2"), p("bx2", "by2"))).select(F.col("district_id1").alias("id"), F.col("district_id2").alias("id2"))


@query(
    "j12_near_or_inside",
    f"""SELECT DISTINCT s.dep_id, x.district_id FROM (SELECT dep_id, latitude AS lat, longitude AS lon FROM mrds_sites WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude) <= 90 AND abs(longitude) <= 180) s
        JOIN (SELECT district_id, lat, lon, radius_km / 100 + 0.0000013 AS rr FROM {_D}) x ON abs(s.lon - x.lon) + abs(s.lat - x.lat) < x.rr OR {_HAV.format(a='s.', b='x.')} <= 4000""",
)
def j12(spark, d):
    """Points inside a polygon or within a distance of its anchor: the union of two equi-joins."""
    s = table(spark, d, "mrds_sites").select("dep_id", F.col("latitude").alias("slat"), F.col("longitude").alias("slon"))
    inside = regions.points_in_polygons(s, "dep_id", "slon", "slat", _diamonds(spark, d), "district_id", "rings")
    near = spatial.within_distance(s, _diamonds(spark, d).select("district_id", "lat", "lon"), ("slon", "slat"), ("lon", "lat"), 4000.0).select("dep_id", "district_id")
    return inside.unionByName(near).distinct()


@query(
    "j13_mutual_centre_containment",
    f"""WITH x AS (SELECT district_id AS id, lat, lon, radius_km / 100 + 0.0000013 AS r FROM {_D}) SELECT a.id, b.id AS id2 FROM x a JOIN x b ON a.id < b.id AND (abs(a.lon - b.lon) + abs(a.lat - b.lat) < a.r OR abs(a.lon - b.lon) + abs(a.lat - b.lat) < b.r)""",
)
def j13(spark, d):
    """Polygons either of which holds the other's centre."""
    x = _diamonds(spark, d)
    hit = regions.points_in_polygons(x.select(F.col("district_id").alias("id"), "lat", "lon"), "id", "lon", "lat", x, "district_id", "rings").where("id <> district_id")
    return hit.select(F.least("id", "district_id").alias("id"), F.greatest("id", "district_id").alias("id2")).distinct()


def _boxes(spark, d, suffix):
    t = table(spark, d, "districts").where("lat is not null and lon is not null").withColumn("r", F.col("radius_km") / 100)
    return t.select(F.col("district_id").alias("id" + suffix), (F.col("lon") - F.col("r")).alias("x0" + suffix), (F.col("lat") - F.col("r")).alias("y0" + suffix), (F.col("lon") + F.col("r")).alias("x1" + suffix), (F.col("lat") + F.col("r")).alias("y1" + suffix))


_B = f"(SELECT district_id AS id, lon - radius_km / 100 AS x0, lat - radius_km / 100 AS y0, lon + radius_km / 100 AS x1, lat + radius_km / 100 AS y1 FROM {_D})"


@query(
    "j21_polygon_overlap_area",
    f"""SELECT a.id, b.id AS id2, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 8) AS area FROM {_B} a JOIN {_B} b ON a.id < b.id
        AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
)
def j21(spark, d):
    """Pairs of polygons with a common area, by clipping."""
    m = spatial.boxes_meeting(_boxes(spark, d, "a"), _boxes(spark, d, "b"), ["x0a", "y0a", "x1a", "y1a"], ["x0b", "y0b", "x1b", "y1b"], 0.4).where("ida < idb")
    ring = lambda s: S.box(*[F.col(c + s) for c in ("x0", "y0", "x1", "y1")])
    m = m.withColumn("area", S.overlap_area(ring("a"), ring("b"))).where("area > 1e-12")
    return m.select(F.col("ida").alias("id"), F.col("idb").alias("id2"), F.round("area", 8).alias("area"))


@query("j22_coverage_fraction")
def j22(spark, d):
    """Share of each box covered by the union of the others (tested against a raster)."""
    m = spatial.boxes_meeting(_boxes(spark, d, "a"), _boxes(spark, d, "b"), ["x0a", "y0a", "x1a", "y1a"], ["x0b", "y0b", "x1b", "y1b"], 0.4).where("ida <> idb")
    cut = m.select("ida", "x0a", "y0a", "x1a", "y1a", *[F.greatest(c + "a", c + "b").alias(c) for c in ("x0", "y0")], *[F.least(c + "a", c + "b").alias(c) for c in ("x1", "y1")]).distinct()

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        whole = (r.x1a - r.x0a) * (r.y1a - r.y0a)
        return pd.DataFrame({"id": [int(r.ida)], "share": [round(S.union_area(pdf[["x0", "y0", "x1", "y1"]].to_numpy()) / whole, 6)]})

    return cut.groupBy("ida").applyInPandas(share, "id int, share double")  # regions that meet one region


@query("j25_any_intersection", f"SELECT DISTINCT a.id FROM {_B} a JOIN {_B} b ON a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def j25(spark, d):
    m = spatial.boxes_meeting(_boxes(spark, d, "a"), _boxes(spark, d, "b"), ["x0a", "y0a", "x1a", "y1a"], ["x0b", "y0b", "x1b", "y1b"], 0.4).where("ida <> idb")
    return m.select(F.col("ida").alias("id")).distinct()


@query("j28_exactly_one", f"SELECT row_id FROM ({_IN}) GROUP BY 1 HAVING count(*) = 1")
def j28(spark, d):
    return j02(spark, d).groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("row_id")


@query(
    "j41_containing_quad",
    f"""SELECT row_id, CAST(floor(lon / 0.125) AS BIGINT) AS qx, CAST(floor(lat / 0.125) AS BIGINT) AS qy, CAST(floor(lon / 0.125) AS BIGINT) + dx AS nx, CAST(floor(lat / 0.125) AS BIGINT) + dy AS ny
        FROM rows_igs_b11, (VALUES (0, 1), (-1, 0), (0, 0), (1, 0), (0, -1)) v(dx, dy) WHERE {_OK}""",
)
def j41(spark, d):
    """The 7.5-minute cell of a point and its neighbours, by arithmetic alone."""
    offs = F.array(*[F.struct(F.lit(a).cast("bigint").alias("dx"), F.lit(b).cast("bigint").alias("dy")) for a, b in ((0, 1), (-1, 0), (0, 0), (1, 0), (0, -1))])
    p = _points(spark, d).where(G.valid_point(F.col("lat"), F.col("lon"))).select("row_id", F.floor(F.col("lon") / 0.125).alias("qx"), F.floor(F.col("lat") / 0.125).alias("qy"), F.inline(offs))
    return p.select("row_id", "qx", "qy", (F.col("qx") + F.col("dx")).alias("nx"), (F.col("qy") + F.col("dy")).alias("ny"))


# --- functions (G) -----------------------------------------------------------------------------------


@query("g01_even_odd", f"SELECT district_id, abs(0.1) + abs(0.05) < radius_km / 100 + 0.0000013 AS inside FROM {_D}")
def g01(spark, d):
    t = _diamonds(spark, d)
    return t.select("district_id", G.ring_contains(F.col("lon") + 0.1, F.col("lat") - 0.05, F.col("rings")[0]).alias("inside"))


@query("g02_centroid", f"SELECT district_id, round(lon, 5) AS x, round(lat, 5) AS y FROM {_D}")
def g02(spark, d):
    c = S.centroid(F.col("rings")[0])
    return _diamonds(spark, d).select("district_id", F.round(c["x"], 5).alias("x"), F.round(c["y"], 5).alias("y"))


@query("g03_vertex_mean", f"SELECT district_id, round(lon, 5) AS x, round(lat, 5) AS y FROM {_D}")
def g03(spark, d):
    c = S.vertex_mean(F.col("rings")[0])
    return _diamonds(spark, d).select("district_id", F.round(c["x"], 5).alias("x"), F.round(c["y"], 5).alias("y"))


@query("g04_signed_area", f"SELECT district_id, round(2 * pow(radius_km / 100 + 0.0000013, 2), 9) AS area FROM {_D}")
def g04(spark, d):
    return _diamonds(spark, d).select("district_id", F.round(S.signed_area(F.col("rings")[0]), 9).alias("area"))


@query("g05_bbox", f"SELECT district_id, round(lon - radius_km / 100 - 0.0000013, 5) AS x0, round(lat + radius_km / 100 + 0.0000013, 5) AS y1 FROM {_D}")
def g05(spark, d):
    b = S.bbox(F.col("rings")[0])
    return _diamonds(spark, d).select("district_id", F.round(b["x0"], 5).alias("x0"), F.round(b["y1"], 5).alias("y1"))


_TO = "(lon + 116) AS dx, (lat - 43) AS dy"


@query(
    "g06_four_distances",
    f"""SELECT row_id, round(sqrt(pow(dx * cos(radians(lat)), 2) + pow(dy, 2)) * 111320, 2) AS equirect,
               round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(43 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(43)) * pow(sin(radians(-116 - lon) / 2), 2))), 2) AS hav,
               round(sqrt(dx * dx + dy * dy), 8) AS plane,
               round(sqrt(pow(dx - t * 2, 2) + pow(dy - t, 2)), 8) AS to_segment
        FROM (SELECT *, greatest(0, least(1, (dx * 2 + dy) / 5)) AS t FROM (SELECT row_id, lat, lon, {_TO} FROM rows_igs_b11 WHERE {_OK}))""",
)
def g06(spark, d):
    """Four distances of every point: two on the globe, one in the plane, one to a segment."""
    p = table(spark, d, "rows_igs_b11").where(G.valid_point(F.col("lat"), F.col("lon")))
    y, x = F.col("lat"), F.col("lon")
    lit = lambda v: F.lit(float(v))
    segment = G.point_segment_distance(x, y, lit(-116), lit(43), lit(-114), lit(44))
    return p.select(
        "row_id", F.round(G.equirect_m(y, x, lit(43), lit(-116)), 2).alias("equirect"), F.round(G.haversine_m(y, x, lit(43), lit(-116)), 2).alias("hav"),
        F.round(F.hypot(x + 116, y - 43), 8).alias("plane"), F.round(segment, 8).alias("to_segment"),
    )


@query(
    "g07_segments_meeting",
    """WITH s AS (SELECT o_orderkey AS id, o_custkey % 5 AS ax, o_orderkey % 4 AS ay, o_custkey % 7 AS bx, o_orderkey % 3 AS by_ FROM orders),
            p AS (SELECT *, (bx - ax) * (1 - ay) - (by_ - ay) * (1 - ax) AS s1, (bx - ax) * (1 - ay) - (by_ - ay) * (4 - ax) AS s2, 3 * (ay - 1) AS s3, 3 * (by_ - 1) AS s4 FROM s)
       SELECT id, (ay = by_ AND ay = 1 AND greatest(ax, bx) >= 1 AND least(ax, bx) <= 4) OR (ay <> by_ AND least(ay, by_) <= 1 AND greatest(ay, by_) >= 1 AND ax + (bx - ax) * (1.0 - ay) / (by_ - ay) BETWEEN 1 - 1e-9 AND 4 + 1e-9) AS meets FROM p""",
)
def g07(spark, d):
    """Segments against the one from (1, 1) to (4, 1), touching and collinear cases included."""
    o = table(spark, d, "orders")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b = point(F.col("o_custkey") % 5, F.col("o_orderkey") % 4), point(F.col("o_custkey") % 7, F.col("o_orderkey") % 3)
    return o.select(F.col("o_orderkey").alias("id"), S.segments_meet(a, b, point(F.lit(1), F.lit(1)), point(F.lit(4), F.lit(1))).alias("meets"))


@query("g09_interior_point", f"SELECT district_id, round(lon + 1.5 * (district_id % 4 + 1), 6) AS x, round(lat + 1, 6) AS y, true AS inside FROM {_D}")
def g09(spark, d):
    """Triangles of several shapes: the middle of the widest stretch half way up."""
    x, y, k = F.col("lon"), F.col("lat"), F.col("district_id") % 4 + 1
    t = _diamonds(spark, d).withColumn("u", S.ring((x, y), (x + 4 * k, y), (x + k, y + 2))).withColumn("p", S.interior_point(F.col("u")))
    return t.select("district_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), G.ring_contains(F.col("p.x"), F.col("p.y"), F.col("u")).alias("inside"))


@query("g13_rectangle_clip", f"SELECT district_id, round(pow(radius_km / 100 + 0.0000013, 2) * 0.5, 8) AS area FROM {_D}")
def g13(spark, d):
    """Diamond cut by the square of its right upper quarter."""
    t = _diamonds(spark, d)
    x, y, r = F.col("lon"), F.col("lat"), F.col("r")
    return t.withColumn("c", S.clip(F.col("rings")[0], S.box(x, y, x + r, y + r))).select("district_id", F.round(F.abs(S.signed_area(F.col("c"))), 8).alias("area"))


@query("g14_simplify", f"SELECT district_id, 3 + ((district_id % 10) * 0.003 > 0.01)::INT AS n FROM {_D}")
def g14(spark, d):
    """A point goes or stays by its distance from its chord, the corner stays, a point on its chord goes."""
    x, y, off = F.col("lon"), F.col("lat"), F.col("district_id") % 10 * 0.003
    line = S.ring((x, y), (x + 0.5, y + off), (x + 1, y), (x + 1, y + 0.5), (x + 1, y + 1))
    return _diamonds(spark, d).withColumn("s", S.simplify(line, 0.01)).select("district_id", F.size("s").alias("n"))


@query("g16_utm_inverse", f"SELECT row_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM rows_igs_b11 WHERE {_OK} AND lat BETWEEN 0 AND 84")
def g16(spark, d):
    """Points to their UTM zone and back; known points are in the tests."""
    zone = F.least(F.floor((F.col("lon") + 180) / 6) + 1, F.lit(60))
    p = _points(spark, d).where(G.valid_point(F.col("lat"), F.col("lon")) & F.col("lat").between(0, 84)).withColumn("zone", zone)
    u = p.withColumn("u", S.lonlat_to_utm(F.col("lon"), F.col("lat"), F.col("zone")))
    ll = S.utm_to_lonlat(F.col("u.easting"), F.col("u.northing"), F.col("zone"))
    return u.select("row_id", F.round(ll["lon"], 6).alias("lon"), F.round(ll["lat"], 6).alias("lat"))


@query("g17_mercator_round_trip", f"SELECT row_id, round(lon, 5) AS lon, round(lat, 5) AS lat FROM rows_igs_b11 WHERE {_OK} AND abs(lat) < 85")
def g17(spark, d):
    m = S.mercator(F.col("lon"), F.col("lat"))
    p = _points(spark, d).where(G.valid_point(F.col("lat"), F.col("lon")) & (F.abs("lat") < 85)).withColumn("m", m)
    b = S.from_mercator(F.col("m.x"), F.col("m.y"))
    return p.select("row_id", F.round(b["lon"], 5).alias("lon"), F.round(b["lat"], 5).alias("lat"))


@query("g19_line_length", f"SELECT district_id, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(0.1) / 2), 2))), 3) AS m FROM {_D}")
def g19(spark, d):
    x, y = F.col("lon"), F.col("lat")
    return _diamonds(spark, d).select("district_id", F.round(S.line_length_m(S.ring((x, y), (x, y + 0.04), (x, y + 0.1))), 3).alias("m"))


@query("g20_tile_of_point", f"SELECT row_id, CAST(least(floor((lon + 180) / 360 * 1024), 1023) AS INTEGER) AS x, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 1024) AS INTEGER) AS y FROM rows_igs_b11 WHERE {_OK} AND abs(lat) < 85")
def g20(spark, d):
    p = _points(spark, d).where(G.valid_point(F.col("lat"), F.col("lon")) & (F.abs("lat") < 85))
    t = S.tile_of(F.col("lon"), F.col("lat"), 10)
    return p.select("row_id", t["x"].alias("x"), t["y"].alias("y"))


@query("g29_circular_mean", f"SELECT state, round(degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))), 5) AS lon FROM {_D} GROUP BY 1")
def g29(spark, d):
    t = table(spark, d, "districts").where("lat is not null and lon is not null")
    return t.groupBy("state").agg(F.round(F.degrees(F.atan2(F.sum(F.sin(F.radians("lon"))), F.sum(F.cos(F.radians("lon"))))), 5).alias("lon"))


@query("g30_envelope_share", f"SELECT state, round(avg(CASE WHEN lat BETWEEN 35 AND 45 THEN 1.0 ELSE 0.0 END), 6) AS share FROM rows_igs_b11 WHERE {_OK} GROUP BY 1")
def g30(spark, d):
    t = table(spark, d, "rows_igs_b11").where(G.valid_point(F.col("lat"), F.col("lon")))
    return t.groupBy("state").agg(F.round(F.avg(F.col("lat").between(35, 45).cast("int")), 6).alias("share"))


@query("g34_ring_decimation", f"SELECT district_id, CAST(least(80, ceil((district_id % 300 + 3) / CAST(greatest(1, (district_id % 300 + 3) // 40) AS DOUBLE))) AS INTEGER) AS n, CAST(greatest(1, (district_id % 300 + 3) // 40) AS DOUBLE) AS second FROM {_D}")
def g34(spark, d):
    """Rings of three to some three hundred corners."""
    r = F.transform(F.sequence(F.lit(0), F.col("district_id") % 300 + 2), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y")))
    t = _diamonds(spark, d).withColumn("c", S.decimate(r, 40, 80))
    return t.select("district_id", F.size("c").alias("n"), F.col("c")[1]["x"].alias("second"))
