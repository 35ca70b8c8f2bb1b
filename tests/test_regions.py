"""Points in regions against brute force, at poles, the date line and cell edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import geo, shapes
from lodeframe.operators import regions, spatial

R = geo.EARTH_RADIUS_M


def dist(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def _case(seed):
    rnd = random.Random(seed)
    centres = [(rnd.uniform(-89, 89), rnd.uniform(-180, 180), rnd.choice([0.5, 8, 60, 900])) for _ in range(25)]
    centres += [(89.9, 10, 300), (-90, 0, 50), (10, 179.99, 20), (0, -180, 5), (45, 0, 0)]
    pts = []
    for la, lo, r in centres:
        for _ in range(12):
            b, m = rnd.uniform(0, 2 * math.pi), rnd.uniform(0, 1.6) * r * 1000 / R
            la2 = math.degrees(math.asin(math.sin(math.radians(la)) * math.cos(m) + math.cos(math.radians(la)) * math.sin(m) * math.cos(b)))
            lo2 = lo + math.degrees(math.atan2(math.sin(b) * math.sin(m) * math.cos(math.radians(la)), math.cos(m) - math.sin(math.radians(la)) * math.sin(math.radians(la2))))
            pts.append((la2, (lo2 + 180) % 360 - 180))
    pts += [(90.0, 5.0), (-90.0, 180.0), (10.0, -180.0), (10.0, 180.0)]
    return centres, pts


@pytest.mark.parametrize("seed", [1, 2])
def test_circles_brute_force(spark, seed):
    centres, pts = _case(seed)
    p = spark.createDataFrame([(i, float(a), float(b), "x") for i, (a, b) in enumerate(pts)] + [(900, None, 1.0, "x"), (901, float("nan"), 1.0, "x"), (902, 91.0, 0.0, "x"), (903, 0.0, 181.0, "x")], "pid int, lat double, lon double, radius_km string")
    c = spark.createDataFrame([(i, float(a), float(b), float(r)) for i, (a, b, r) in enumerate(centres)] + [(90, None, 1.0, 5.0), (91, 1.0, 1.0, None), (92, 1.0, 1.0, -1.0)], "rid int, lat double, lon double, radius_km double")
    got = {(r.pid, r.rid) for r in regions.points_in_circles(p, "pid", "lat", "lon", c, "rid", "lat", "lon", F.col("radius_km") * 1000).collect()}
    want = {(i, j) for i, (a, b) in enumerate(pts) for j, (x, y, r) in enumerate(centres) if dist(a, b, x, y) <= r * 1000}
    assert got == want


def test_circles_empty_and_repeated(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "pid int, lat double, lon double")
    none = spark.createDataFrame([], "rid int, lat double, lon double, r double")
    assert regions.points_in_circles(p, "pid", "lat", "lon", none, "rid", "lat", "lon", F.col("r")).count() == 0
    one = spark.createDataFrame([(7, 0.0, 0.0, 10.0)], "rid int, lat double, lon double, r double")
    assert regions.points_in_circles(p, "pid", "lat", "lon", one, "rid", "lat", "lon", F.col("r")).count() == 2
    assert regions.points_in_circles(p.limit(0), "pid", "lat", "lon", one, "rid", "lat", "lon", F.col("r")).count() == 0


def test_interior_cells_are_inside():
    for la, lo, r in [(40, -110, 20e3), (80, 179.9, 30e3), (0, 0, 500)]:
        cells = geo.circle_cover(la, lo, r)
        assert any(c[3] for c in cells)
        for k, x, y, inside in cells:
            s = geo.cell_size(k)
            corners = [dist(la, lo, min(90, y * s - 90 + j * s), x * s - 180 + i * s) for i in (0, 1) for j in (0, 1)]
            assert not inside or max(corners) <= r


def test_polygons_brute_force(spark):
    rnd = random.Random(5)
    polys = []
    for i in range(12):
        x, y, n = rnd.uniform(-170, 170), rnd.uniform(-70, 70), rnd.randint(3, 9)
        a = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(x + math.cos(t) * rnd.uniform(0.2, 1.5), y + math.sin(t) * rnd.uniform(0.2, 1.5)) for t in a]
        hole = [(x - 0.05, y - 0.05), (x + 0.05, y - 0.05), (x + 0.05, y + 0.05)]
        polys.append((i, [ring, hole]))
    pts = [(i, p[1][0][0][0] + rnd.uniform(-2, 2), p[1][0][0][1] + rnd.uniform(-2, 2)) for i, p in enumerate(polys * 20)]
    as_rows = [(i, [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, rings in polys] + [(99, None), (98, [])]
    g = spark.createDataFrame(as_rows, "rid int, rings array<array<struct<x:double,y:double>>>")
    p = spark.createDataFrame(pts, "pid int, x double, y double")
    got = {(r.pid, r.rid) for r in regions.points_in_polygons(p, "pid", "x", "y", g, "rid", "rings").collect()}
    import numpy as np

    def inside(rings, x, y):
        edges = [np.array([(*a, *b) for a, b in zip(r, [*r[1:], r[0]])]) for r in rings]
        return sum(bool(geo.np_even_odd(e, np.array([x]), np.array([y]))[0]) for e in edges) % 2 == 1

    assert got == {(i, j) for i, x, y in pts for j, rings in polys if inside(rings, x, y)}


def test_locations_within(spark):
    rnd = random.Random(3)
    pts = [(rnd.uniform(60, 60.05), rnd.uniform(179.97, 180) if rnd.random() < 0.5 else rnd.uniform(-180, -179.97)) for _ in range(120)]
    pts += pts[:30]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts] + [(None, 1.0), (float("nan"), 0.0)], "lat double, lon double")
    got = {((r.lat, r.lon), (r.lat2, r.lon2)): (r.n, r.n2) for r in regions.locations_within(df, "lat", "lon", 800.0).collect()}
    u = sorted(set(pts))
    want = {(a, b): (pts.count(a), pts.count(b)) for i, a in enumerate(u) for b in u[i + 1 :] if dist(*a, *b) <= 800}
    assert got == want


@pytest.mark.parametrize("metres", [30_000.0, 500_000.0])
def test_within_distance_to_the_poles(spark, metres):
    rnd = random.Random(8)
    ps = [(i, rnd.choice([-1, 1]) * rnd.choice([rnd.uniform(70, 90), rnd.uniform(84, 86), rnd.uniform(89.7, 90)]), rnd.choice([rnd.uniform(-180, 180), rnd.uniform(0, 6), rnd.uniform(178, 180), -180.0])) for i in range(300)]
    ps += [(300, 90.0, 12.0), (301, -90.0, 0.0), (302, 85.0, 10.0), (303, 85.0, 12.5)]

    df = spark.createDataFrame(ps, "id int, y double, x double")
    got = sorted((r.id, r.oid) for r in spatial.within_distance(df, df.toDF("oid", "oy", "ox"), ("x", "y"), ("ox", "oy"), metres).collect())
    assert got == sorted((a[0], b[0]) for a in ps for b in ps if dist(*a[1:], *b[1:]) <= metres)
    assert (302, 303) in got


def test_nearest_and_boxes(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, None, 1.0)], "id int, x double, y double")
    b = spark.createDataFrame([(5, 0.001, 0.0), (4, -0.001, 0.0), (6, 50.0, 50.0)], "oid int, ox double, oy double")
    got = {r.id: r.oid for r in spatial.nearest_within(a, "id", b, "oid", ("x", "y"), ("ox", "oy"), 1000.0).collect()}
    assert got == {1: 4, 2: None, 3: None}
    boxes = [(i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate([(0, 0, 1, 1), (1, 1, 1, 1), (0.5, 0.5, 3, 0.1), (9, 9, 1, 1)])]
    l = spark.createDataFrame([tuple(float(v) if k else v for k, v in enumerate(t)) for t in boxes], "ia int, x0a double, y0a double, x1a double, y1a double")
    r = l.toDF("ib", "x0b", "y0b", "x1b", "y1b")
    m = spatial.boxes_meeting(l, r, ["x0a", "y0a", "x1a", "y1a"], ["x0b", "y0b", "x1b", "y1b"], 0.7).where("ia < ib")
    assert sorted((t.ia, t.ib) for t in m.collect()) == [(0, 1), (0, 2)]


def test_shape_kernels(spark):
    import numpy as np

    sq = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert abs(shapes.np_area(shapes.clip_convex(sq, np.array([(2, 2), (6, 2), (6, 6), (2, 6)], float)))) == 4
    assert len(shapes.clip_convex(sq, np.array([(9, 9), (10, 9), (10, 10)], float))) == 0
    assert shapes.union_area(np.array([(0, 0, 2, 2), (1, 1, 3, 3), (1, 1, 2, 2), (5, 5, 5, 9)], float)) == 7
    line = np.array([(0, 0), (1, 0.001), (2, 0), (2, 2)], float)
    assert shapes.douglas_peucker(line, 0.01).tolist() == [[0, 0], [2, 0], [2, 2]]


def test_utm_at_known_points(spark):
    """A tower in Toronto, the meridian arc to 45 degrees, and the equator three degrees off."""
    for e, n, zone, lon, lat in [(630_084.0, 4_833_438.5, 17, -79.387139, 43.642567), (500_000.0, 4_982_950.4, 31, 3.0, 45.0), (833_978.557, 0.0, 31, 6.0, 0.0)]:
        one = spark.range(1)
        back = one.select(shapes.utm_to_lonlat(F.lit(e), F.lit(n), F.lit(zone)).alias("u")).first().u
        there = one.select(shapes.lonlat_to_utm(F.lit(lon), F.lit(lat), F.lit(zone)).alias("u")).first().u
        assert abs(back.lon - lon) < 1.5e-5 and abs(back.lat - lat) < 1.5e-5
        assert abs(there.easting - e) < 1 and abs(there.northing - n) < 1
    south = spark.range(1).select(shapes.lonlat_to_utm(F.lit(3.0), F.lit(-45.0), F.lit(31), False).alias("u")).first().u
    assert abs(south.northing - (1e7 - 4_982_950.4)) < 1
    s = spark.range(1).select(shapes.utm_to_lonlat(F.lit(south.easting), F.lit(south.northing), F.lit(31), False).alias("u")).first().u
    assert abs(s.lat + 45) < 1e-9 and abs(s.lon - 3) < 1e-9


def test_polygons_with_many_corners(spark):
    """Cells carry their own edges: a polygon of 20,000 corners isn't copied to them, and every point is told right."""
    import numpy as np

    from lodeframe.functions import geo

    a = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    r = 1 + 0.3 * np.sin(9 * a)
    ring = [(float(x), float(y)) for x, y in zip(-114 + r * np.cos(a), 44 + r * np.sin(a))]
    hole = [(-114.2, 43.9), (-113.8, 43.9), (-113.8, 44.1), (-114.2, 44.1)]
    cells = geo.polygon_cover([ring, hole])
    assert max(len(c[5]) for c in cells) <= 64 and sum(len(c[5]) for c in cells) < 40_000
    schema = "id int, rings array<array<struct<x:double,y:double>>>"
    polys = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in q] for q in (ring, hole)]), (2, None), (3, []), (4, [[{"x": -114.0, "y": 44.0}]])], schema)
    rnd = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rnd.uniform(-115.5, -112.5, 4000), rnd.uniform(42.5, 45.5, 4000)))] + [(9001, None, 44.0), (9002, float("nan"), 1.0)]
    points = spark.createDataFrame(pts, "p int, x double, y double")
    plan = regions.points_in_polygons(points, "p", "x", "y", polys, "id", "rings")
    got = {x.p for x in plan.collect()}
    ex, ey = np.array(ring).T
    bx, by = np.roll(ex, -1), np.roll(ey, -1)

    def inside(x, y):
        c = (ey > y) != (by > y)
        odd = (c & (x < ex + (bx - ex) * (y - ey) / np.where(by == ey, 1, by - ey))).sum() % 2
        return bool(odd) and not (-114.2 < x < -113.8 and 43.9 < y < 44.1)

    assert got == {i for i, x, y in pts[:4000] if inside(x, y)}
    many = polys.where("id = 1").crossJoin(spark.range(200).select(F.col("id").cast("int").alias("k"))).select("k", "rings")
    plan = regions.points_in_polygons(points, "p", "x", "y", many, "k", "rings")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_very_different_size(spark):
    from lodeframe.operators import spatial

    rnd = random.Random(6)
    box = lambda i: (i, *(lambda x, y, w: (x, y, x + w, y + w / 2))(rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.choice([0.0, 0.01, 0.5, 3.0, 80.0])))
    a, b = [box(i) for i in range(120)] + [(999, 0.0, 0.0, 1000.0, 1000.0)], [box(i) for i in range(120)]
    kind = "{0} int, x{0} double, y{0} double, u{0} double, v{0} double"
    one, two = spark.createDataFrame(a + [(7777, None, 1.0, 2.0, 3.0)], kind.format("a")), spark.createDataFrame(b, kind.format("b"))
    got = spatial.boxes_meeting(one, two, ["xa", "ya", "ua", "va"], ["xb", "yb", "ub", "vb"], 0.3).select("a", "b").collect()
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_coverage_fraction_raster(spark):
    from lodeframe.plans.shapes import QUERIES, _boxes

    d = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(d):
        pytest.skip("no test data here")
    got = {r.id: r.share for r in QUERIES["j22_coverage_fraction"](spark, d).collect()}
    b = {r[0]: r[1:] for r in _boxes(spark, d, "a").collect()}
    import numpy as np

    for i in list(got)[:6]:
        x0, y0, x1, y1 = b[i]
        xs, ys = np.linspace(x0, x1, 201)[:-1] + (x1 - x0) / 400, np.linspace(y0, y1, 201)[:-1] + (y1 - y0) / 400
        X, Y = np.meshgrid(xs, ys)
        hit = np.zeros(X.shape, bool)
        for j, (p, q, r, s) in b.items():
            if j != i:
                hit |= (X >= p) & (X <= r) & (Y >= q) & (Y <= s)
        assert abs(hit.mean() - got[i]) < 0.01


def test_distance_of_missing_points_is_null(spark):
    nan, none = float("nan"), None
    t = spark.createDataFrame([(44.0, -114.0, 44.0, -114.0), (none, -114.0, 44.0, -114.0), (44.0, -114.0, 44.0, none), (nan, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 180.0), (90.0, 5.0, -90.0, 77.0)], "a double, b double, c double, d double")
    got = [r[0] for r in t.select(geo.haversine_m(*map(F.col, "abcd"))).collect()]
    assert got[:4] == [0.0, None, None, None] and got[4] == pytest.approx(math.pi * R) and got[5] == pytest.approx(math.pi * R)
