"""Placing and matching by name, contracts, layers and proofs: edge cases beside the SQL of the queries."""

import random

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import text
from lodeframe.operators import contracts as C
from lodeframe.operators import linking as L

ROW = "row long, state string, county string, district string, name string, further array<string>, excl array<string>, x double, y double, clash string"
SITE = "dep long, state string, county string, name string, sx double, sy double, clash string"
ANCHOR = "state string, county string, district string, ax double, ay double"


def test_locate_by_name(spark):
    sites = [
        (1, "ID", "Ada", "Golden Shovel Mine", -114.0, 44.0, "c"), (2, "ID", "Ada", "Golden Shovel No. 2", -114.01, 44.01, "c"), (3, "ID", "Boise", "Golden Shovel", -115.0, 43.0, "c"),
        (4, "ID", "Elko", "Lucky Peach", -110.0, 40.0, "c"), (5, "ID", "Elko", "Lucky Peach", -112.0, 40.0, "c"), (6, "ID", "Elko", "Old Wager Organ Claims", -113.0, 41.0, "c"), (7, "ID", "Elko", None, 1.0, 1.0, "c"), (8, "ID", "Elko", "Bad Point", 999.0, 1.0, "c"),
    ]
    rows = [
        (10, "ID", "ada", None, "The Golden Shovel (east drift)", None, None, None, None, "k"),
        (11, "ID", None, None, "Golden Shovel", None, None, None, None, "k"),  # three counties' worth of sites: no cluster
        (12, "ID", "Elko", "Bear Gulch (Elko)", "Lucky Peach", None, None, None, None, "k"),  # apart: the district's middle
        (13, "ID", "Elko", None, "Wager", ["wager organ"], [None, ""], None, None, "k"),
        (14, "ID", "Elko", None, "Wager", ["wager organ"], ["old wager"], None, None, "k"),
        (15, "ID", "Elko", None, "Golden Shovel", [], [], -1.0, 2.0, "k"),
        (16, None, None, None, None, None, None, None, None, "k"),
        (16, None, None, None, None, None, None, None, None, "k"),
    ]
    anchors = [("ID", "Elko", "Bear Gulch", -111.0, 41.0), ("ID", "Elko", "Bear Gulch", -112.0, 42.0), ("ID", None, "bear gulch", -113.0, 40.0), ("ID", None, "alone", 1.0, 1.0)]
    run = lambda r, s, a: {x.row: (x.x, x.y, x.dep, x.stage) for x in L.locate_by_name(spark.createDataFrame(r, ROW), spark.createDataFrame(s, SITE), spark.createDataFrame(a, ANCHOR)).collect()}
    got = run(rows, sites, anchors)
    assert got[10] == (-114.0, 44.0, 1, 1) and got[11] == (None,) * 4 and got[12] == (-112.0, 41.0, None, 3)
    assert got[13] == (-113.0, 41.0, 6, 2) and got[14] == (None,) * 4 and got[15] == (-1.0, 2.0, None, 0) and got[16] == (None,) * 4
    assert L.locate_by_name(spark.createDataFrame(rows, ROW), spark.createDataFrame([], SITE), spark.createDataFrame([], ANCHOR)).count() == len(rows)
    assert run([], sites, anchors) == {}


def test_match_existing(spark):
    new = "id long, state string, county string, name string, further array<string>, x double, y double"
    old = "eid long, state string, county string, name string, ex double, ey double"
    e = [(5, "ID", "Ada", "Golden Shovel", None, None), (4, "ID", None, "Golden Shovel Mine", -114.0, 44.0), (9, "ID", "Ada", "Inkwell Bench", None, None), (1, "NV", "Ada", "Golden Shovel", None, None), (2, "ID", "Ada", None, None, None)]
    n = [
        (1, "ID", "Ada", "The Golden Shovel", None, -114.05, 44.0), (2, "ID", "Ada", "Golden Shovel", None, -116.0, 44.0), (3, "ID", "Boise", "Golden Shovel", None, -116.0, 44.0),
        (4, "ID", "Ada", "Other", [None, "Other mine", "inkwell bench"], None, None), (5, "ID", "Boise", "Other", ["inkwell bench"], None, None), (6, None, None, None, None, None, None), (7, "ID", None, "Golden Shovel", None, None, None),
    ]
    got = {r.id: (r.match, r.by) for r in L.match_existing(spark.createDataFrame(n, new), spark.createDataFrame(e, old)).collect()}
    assert got == {1: (4, "name"), 2: (5, "name"), 3: (None, None), 4: (9, "alias"), 5: (None, None), 6: (None, None), 7: (4, "name")}
    assert L.match_existing(spark.createDataFrame(n, new), spark.createDataFrame([], old)).where("match is not null").count() == 0


def test_merge_districts(spark):
    rnd = random.Random(8)
    words = ["bear", "gulch", "elk", "creek", "old"]
    items = [("ID" if i % 2 else "NV", " ".join(rnd.sample(words, rnd.randint(1, 3))), rnd.randint(1, 6), round(-114 + rnd.random(), 4), round(44 + rnd.random(), 4)) for i in range(60)]
    want = []
    for st in ("ID", "NV"):
        kept = {}
        for _, name, n, lon, lat in sorted((x for x in items if x[0] == st), key=lambda x: (-x[2], x[1])):
            home = name if name in kept else next((k for k, m in kept.items() if (k in name or name in k) and abs(m[2] - lon) < 0.35 and abs(m[3] - lat) < 0.35), None)
            if home is None:
                kept[name] = [name, n, lon, lat]
            else:
                m = kept[home]
                kept[home] = [m[0], m[1] + n, round((m[2] * m[1] + lon * n) / (m[1] + n), 4), round((m[3] * m[1] + lat * n) / (m[1] + n), 4)]
        want += [(st, *m) for m in kept.values()]
    df = spark.createDataFrame(items + [(None, "x", 1, 0.0, 0.0), ("ID", "y", 1, None, 0.0)], "state string, name string, n int, lon double, lat double")
    got = L.merge_districts(df)
    if len({(x[0], x[1], x[2]) for x in items}) == len(items):  # ties of one name and count fall in any order
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.agg(F.sum("n")).first()[0] == sum(x[2] for x in items) and L.merge_districts(df.limit(0)).count() == 0


def test_contract(spark):
    t = spark.createDataFrame([(1, "ID", "a", -114.0, 44.0), (2, "ID", "b", -114.0, 45.0), (3, "NV", None, None, None), (4, None, "A%", float("nan"), 44.0)], "k int, st string, nm string, x double, y double")
    c = C.Contract(one_of={"states": "st"}, contains={"name": "nm"}, at_least={"least": "k"}, flag={"placed": "x is not null"}, point=("x", "y"), order=("-k",), default_limit=2, most=3)
    ids = lambda **ask: [r.k for r in c.rows(t, ask).collect()]
    assert ids() == [4, 3] and ids(limit=99) == [4, 3, 2] and ids(states=["ID"]) == [2, 1] and ids(states=[]) == [] and ids(name="A%") == [4] and ids(least=2, states=["ID"]) == [2]
    assert ids(near_lat=44.0, near_lon=-114.0) == [1] and ids(near_lat=44.0, near_lon=-114.0, radius_km=112) == [2, 1] and ids(placed=False, limit=1) == [4]
    assert c.count(t, {"states": ["ID"]}).first().n == 2
    with pytest.raises(ValueError, match="unknown"):
        ids(county="x")
    with pytest.raises(ValueError, match="together"):
        ids(near_lat=1.0)


def test_layer_keeps_or_rejects_every_row(spark):
    t = spark.createDataFrame([(1, " a ", 1.0), (2, "", 1.0), (3, "toolong", float("nan")), (4, "b", None), (5, "c", float("inf")), (6, "d", -9.0), (None, None, None)], "k int, s string, v double")
    layer = C.Layer({"k": C.Field("k", "int", True), "s": C.Field("s", required=True, limit=3), "v": C.Field("v", "double", low=0)}, "true", {"source": "t"})
    assert sorted(map(tuple, layer.project(t).collect())) == [(1, "a", 1.0, "t"), (4, "b", None, "t")]
    assert sorted((r.k or 0, r.faults) for r in layer.rejected(t).collect()) == [(0, ["k", "s"]), (2, ["s"]), (3, ["s", "v"]), (5, ["v"]), (6, ["v"])]
    assert layer.project(t).count() + layer.rejected(t).count() == 7 and layer.project(t.limit(0)).count() == 0


def test_attested_pages_and_zero(spark):
    kind = "p string, a int, b int, n int, t int"
    pages = [("whole", 1, 5, 3, 5), ("whole", 6, 9, 2, 5), ("overlap", 1, 5, 3, 5), ("overlap", 5, 9, 2, 5), ("short", 1, 5, 3, 5), ("two", 1, 2, 2, 4), ("two", 3, 4, 2, 5), ("null", 1, 2, 2, None), ("back", 5, 1, 2, 2)]
    got = {r.p: r.attested for r in C.pages_attested(spark.createDataFrame(pages, kind), "p", "a", "b", "n", "t").collect()}
    assert got == {"whole": True, "overlap": False, "short": False, "two": False, "null": False, "back": False}
    m = lambda x: spark.createDataFrame(x, "p string, declared long, whole boolean")
    r = spark.createDataFrame([("a",), ("a",)], "p string")
    proof = lambda x: {y.p: y.proven for y in C.zero_proof(m(x), r, "p", "declared", "whole").collect()}
    assert proof([("a", 2, True), ("b", 0, True), ("c", 0, None)]) == {"b": True, "c": False}
    assert proof([("a", 1, True), ("b", 0, True)]) == {"b": False} and proof([("b", 0, True)]) == {"b": False} and proof([]) == {}


def test_source_scales(spark):
    s = spark.createDataFrame([("1:24,000",), ("24k",), ("24000",), ("1:24k to 1:250k",), ("about 24000",), ("0",), ("",), (None,), ("1:24k–1:62.5k",), ("Map, 1:62,500 ",)], "s string")
    got = [tuple(r) for r in s.select(text.plain_scale(F.col("s")), text.exact_scale(F.col("s")), text.trailing_scale(F.col("s"))).collect()]
    assert got == [(24000, 24000, 24000), (24000, None, None), (24000, None, 24000), (None, None, None), (None, None, 24000), (None, None, 0), (None, None, None), (None, None, None), (None, None, None), (None, 62500, 62500)]


def test_sentence_after_heading(spark):
    t = [("x\nGold District\n\nThe veins\nare narrow. More.", "gold district"), ("Gold District is rich. No.", "Gold District"), ("Gold District\n", "Gold District"), ("GOLD\nNo end", "gold"), (None, "a"), ("a\nb.", None), ("a\nb.", "")]
    got = [r[0] for r in spark.createDataFrame(t, "t string, h string").select(text.sentence_after(F.col("t"), F.col("h"))).collect()]
    assert got == ["The veins are narrow.", None, None, None, None, None, None]
