"""Vector files, polygon assembly, strict documents, blocked matching and page windows."""

import random
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import polygons as P
from lodeframe.functions import text
from lodeframe.operators import matching as M
from lodeframe.sources import registry, vectors


def _shp(records):
    body = b""
    for i, rec in enumerate(records):
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i", 1000, 5) + b"\0" * 64
    return head + body


def test_shapefiles(spark, tmp_path):
    point = struct.pack("<i2d", 1, 1.5, 2.5)
    ring = [(0, 0), (0, 1), (1, 1), (0, 0)]
    poly = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    null = struct.pack("<i", 0)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15
    dbf = b"\x03" + b"\0" * 3 + struct.pack("<IHH", 3, 32 + 32 + 1, 6) + b"\0" * 20 + field + b"\r" + b" Alpha" + b"      " + b" Gam  "
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/lay.shp", _shp([point, poly, null]))
        z.writestr("d/lay.dbf", dbf)
    got = vectors.read_shapefiles(spark, str(tmp_path / "a.zip")).orderBy("fid").collect()
    assert [(r.layer, r.fid, r.kind, r.properties) for r in got] == [("lay", 0, 1, {"NAME": "Alpha"}), ("lay", 1, 5, {}), ("lay", 2, 0, {"NAME": "Gam"})]
    assert (got[0].parts[0][0].x, got[0].parts[0][0].y) == (1.5, 2.5) and [(p.x, p.y) for p in got[1].parts[0]] == ring


def test_geopackages(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('sites', 'geom')")
    db.execute("CREATE TABLE sites (fid INTEGER PRIMARY KEY, geom BLOB, nm TEXT)")
    head = b"GP\0\x01" + struct.pack("<i", 4326)
    multi = struct.pack("<BII", 1, 6, 1) + struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 3) + struct.pack("<6d", 0, 0, 1, 0, 1, 1)
    db.execute("INSERT INTO sites VALUES (7, ?, 'Alpha')", (head + struct.pack("<BI2d", 1, 1, 3.0, 4.0),))
    db.execute("INSERT INTO sites VALUES (8, ?, NULL)", (head + multi,))
    db.execute("INSERT INTO sites VALUES (9, NULL, 'none')")
    db.commit()
    db.close()
    got = vectors.read_geopackages(spark, str(tmp_path / "g.gpkg")).orderBy("fid").collect()
    assert [(r.fid, r.kind, r.properties.get("nm")) for r in got] == [(7, 1, "Alpha"), (8, 5, None), (9, 0, "none")]
    assert len(got[1].parts) == 1 and len(got[1].parts[0]) == 3 and got[2].parts == []


def test_polygon_kernels():
    sq = np.array([(0, 0), (0, 4), (4, 4), (4, 0)], float)  # clockwise: outer
    hole = np.array([(1, 1), (2, 1), (2, 2), (1, 2)], float)
    lone = hole + 50
    polys = P.assemble([sq, hole, lone, np.array([(0, 0), (1, 1), (2, 2)], float)])
    assert [len(p) for p in polys] == [2, 1]
    assert P.covers(sq, hole) and P.covers(sq, sq) and not P.covers(hole, sq) and not P.covers(sq, hole + 3)
    concave = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    assert not P.covers(concave, np.array([(0.2, 3), (3.8, 3), (2, 0.5)], float))
    w = P.unwrap(np.array([(179.5, 0), (-179.5, 0), (-179.5, 1), (179.5, 1)], float))
    assert np.ptp(w[:, 0]) == 1 and len(P.unwrap(np.zeros((0, 2)))) == 0


def test_strict_documents():
    assert registry.merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "e": 3}) == {"a": {"b": 1, "c": [2]}, "d": 2, "e": 3}
    assert registry.strict_json('{"a": [1, null]}') == {"a": [1, None]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[Infinity]", "{"):
        with pytest.raises(ValueError):
            registry.strict_json(bad)


def test_blocked_matches(spark):
    a = spark.createDataFrame([(1, "x", ["s1", "s2"]), (2, "y", None), (3, None, [])], "id int, t string, secs array<string>")
    b = spark.createDataFrame([(10, "x", ["s1"]), (11, "q", ["s2", "s2"]), (12, "x", None), (13, "y", ["s9"])], "rid int, rt string, rsecs array<string>")
    blocks = [(F.col("secs"), F.col("rsecs")), (F.array("t"), F.array("rt"))]
    got = M.blocked_candidates(a, b, "id", "rid", blocks)
    assert sorted((r.id, r.rid, r.by) for r in got.collect()) == [(1, 10, 3), (1, 11, 1), (1, 12, 2), (2, 13, 2)]
    best = M.scored_matches(a, b, "id", "rid", blocks, lambda by: by * 1.0, 2.0, k=1)
    assert sorted((r.id, r.rid) for r in best.collect()) == [(1, 10), (2, 13)]
    assert M.scored_matches(a.limit(0), b, "id", "rid", blocks, lambda by: by * 1.0, 0.0).count() == 0


def test_page_window(spark):
    q = spark.createDataFrame([("a", "s", 10, "gold vein here"), ("b", "s", 99, "x")], "id string, src string, cited int, quote string")
    p = spark.createDataFrame([("s", 9, "gold vein here"), ("s", 11, "the gold vein here"), ("s", 10, "nothing"), ("s", 13, "gold vein here")], "src string, pdf_page int, text string")
    got = M.page_window_match(q, p, "src", "cited", 2, lambda: F.when(F.contains("text", "quote"), 1.0).otherwise(0.0)).collect()
    assert [(r.id, r.pdf_page, r.score) for r in got] == [("a", 9, 1.0)]


def test_page_window_every_quote(spark):
    q = spark.createDataFrame([("a", "s", 10, "gold vein here"), ("b", "s", 99, "x"), ("c", "s", None, "x"), ("d", "s", 11, "y")], "id string, src string, cited int, quote string")
    p = spark.createDataFrame([("s", 9, "gold vein here"), ("s", 10, "nothing")], "src string, pdf_page int, text string")
    got = M.page_window_match(q, p, "src", "cited", 2, lambda: F.when(F.contains("text", "quote"), 1.0).otherwise(0.0), every=True).collect()
    assert sorted((r.id, r.pdf_page, r.score) for r in got) == [("a", 9, 1.0), ("b", 99, 0.0), ("c", None, 0.0), ("d", 11, 0.0)]


def test_printed_to_pdf(spark):
    known = [("s", i, i + 7) for i in range(1, 5)] + [("s", i, i + 3) for i in range(6, 9)] + [("t", 4, 9), ("t", 5, 10)]
    rows = [*known, ("s", 2, None), ("s", 90, None), ("s", None, None), ("t", 4, None), ("t", 50, None), ("u", 8, None)]
    got = M.printed_to_pdf(spark.createDataFrame(rows, "src string, page int, pdf_page int"), "src", "page", "pdf_page").collect()
    assert sorted((r.src, r.page, r.cited) for r in got if r.pdf_page is None and r.page is not None) == [("s", 2, 9), ("s", 90, 11), ("t", 4, 4), ("t", 50, 10), ("u", 8, 8)]
    assert all(r.cited == r.pdf_page for r in got if r.pdf_page is not None) and len(got) == len(rows)


def _slide(quote, page):
    """The reference's score with every window counted anew."""
    a, b = text.quote_words(quote), text.quote_words(page)
    if not a or not b:
        return 0.0
    if f" {' '.join(a)} " in f" {' '.join(b)} ":
        return 1.0
    size = max(len(a) + 1, int(1.3 * len(a)))
    return round(max(sum(w in b[i : i + size] for w in a) / len(a) for i in range(len(b))), 6)


def test_quote_score_against_full_window(spark):
    page = "Notes. The main vein, sampled for thirty feet, gave two ounces of gold; later work on the lower le-\nvel failed."
    quotes = ["Tke moin vcin sampled for thirty feet gave two ounces of gold", "seen before. thirty feet gave two ounces of gold", "work on the lower level failed", None, "", "..."]
    rnd = random.Random(5)
    some = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, n))) for n in (4, 9, 30) for _ in range(60)]
    pairs = [(q, page) for q in quotes] + [(rnd.choice(some), rnd.choice(some)) for _ in range(400)]
    t = spark.createDataFrame(pairs, "q string, p string")
    got = [r[0] for r in t.select(text.quote_score(F.col("q"), F.col("p"))).collect()]
    assert got == [_slide(q, p) for q, p in pairs]
    assert got[:6] == [0.75, round(7 / 9, 6), 1.0, 0.0, 0.0, 0.0]


def test_quotes_in_texts(spark):
    item = "rank its second stage depot cross course and bank failure by age although rivers rose"
    items = [(1, item), (2, "gold bar"), (3, None), (4, "")]
    docs = [
        (1, "seen: stage depot, cross course and\nbank fail-\nure by age although"),  # from the middle, over lines
        (2, "Rnak its secnd stage depot cross course and bank failure by age"),  # slips in the opening
        (3, "its second stage depot cross course and bank failure"),  # a word lost
        (4, "a gold bar. rank its second"),
        (5, "nothing of it"),
        (6, None),
        (7, ""),
    ]
    rnd = random.Random(6)
    items += [(10 + i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12)))) for i in range(12)]
    docs += [(10 + i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 25)))) for i in range(40)]

    def shared(q, t):
        a, b = text.quote_words(q), text.quote_words(t)
        k = min(4, len(a))
        return k and {tuple(a[i : i + k]) for i in range(len(a) - k + 1)} & {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}

    got = M.quotes_in_texts(spark.createDataFrame(items, "i int, q string"), "i", "q", spark.createDataFrame(docs, "d int, t string"), "d", "t").collect()
    want = {(i, d): _slide(q, t) for i, q in items for d, t in docs if shared(q, t)}
    assert len(got) == len(want) and {(r.i, r.d): r.score for r in got} == want
    assert {(1, 1), (1, 2), (1, 3), (2, 4)} <= want.keys() and (1, 4) not in want


def test_collapsed_lines(spark):
    t = spark.createDataFrame([([(0.0, 0.0), (1e-9, 0.0)],), ([(0.0, 0.0), (5.0, 0.0)],)], "l array<struct<x:double,y:double>>")
    assert [r[0] for r in t.select(P.collapsed(F.col("l"), 0.1)).collect()] == [True, False]
    assert [r[0] for r in t.select(P.collapsed(P.repair_collapsed(F.col("l"), 0.1), 0.1)).collect()] == [False, False]
