"""Relational, text, source, sink and streaming operators on small tables and edge cases."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import dates, text
from lodeframe.operators import relational as R
from lodeframe.sources import files, paged, sinks, snapshot, tiles


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_and_last_per_key(spark):
    t = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (None, 5, "c"), (None, 4, None), (2, 1, "d")], "k int, o int, v string")
    assert rows(R.first_per_key(t, ["k"], F.col("o"))) == rows(spark.createDataFrame([(1, 1, "b"), (None, 4, None), (2, 1, "d")], "k int, o int, v string"))
    assert {r.v for r in R.last_per_key(t, ["k"], F.col("o")).collect()} == {"a", "c", "d"}
    assert R.first_per_key(t.limit(0), ["k"], F.col("o")).count() == 0


def test_capped_list_order(spark):
    t = spark.createDataFrame([(1, x) for x in (5, 3, 9, 1)] + [(2, 7)], "k int, v int")
    assert {r.k: r.s for r in R.capped_list(t, ["k"], F.col("v"), F.col("v"), 2, "s").collect()} == {1: [1, 3], 2: [7]}


def test_dense_rank_where_is_contiguous(spark):
    rnd = random.Random(1)
    t = spark.createDataFrame([(i, rnd.randint(0, 50)) for i in range(500)], "id int, v int")
    out = R.dense_rank_where(t, F.col("v") > 10, F.col("v").desc(), F.col("id")).collect()
    good = sorted((r for r in out if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in good] == list(range(1, len(good) + 1))
    assert [(r.v, r.id) for r in good] == sorted(((r.v, r.id) for r in good), key=lambda x: (-x[0], x[1]))
    assert all(r.v <= 10 for r in out if r.rank is None) and len(out) == 500


def test_nearest_key_ties_and_gaps(spark):
    p = spark.createDataFrame([(1900, 1.0), (1904, 2.0), (1910, 3.0)], "y int, v double")
    a = spark.createDataFrame([(1902,), (1903,), (1800,), (2000,), (None,), (1904,)], "k int")
    got = {r.k: r.v for r in R.nearest_key(a, "k", p, "y", ["v"]).collect()}
    assert got == {1902: 1.0, 1903: 2.0, 1800: 1.0, 2000: 3.0, None: None, 1904: 2.0}
    assert {r.k: r.v for r in R.nearest_key(a, "k", p, "y", ["v"], later_first=True).collect()}[1902] == 2.0


def test_missing_and_extra_with_nulls(spark):
    a = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert rows(R.missing_and_extra(a, b, "k")) == sorted([(1, "missing"), (None, "missing"), (3, "extra")], key=repr)


def test_inventory_digest_ignores_order(spark):
    t = spark.range(1000).withColumn("k", F.col("id"))
    a, b = R.id_inventory(t, "k").first(), R.id_inventory(t.orderBy(F.col("k").desc()).repartition(9), "k").first()
    c = R.id_inventory(t.where("k <> 7"), "k").first()
    assert a == b and a.digest != c.digest and (c.n, c.n_distinct) == (999, 999)
    assert R.id_inventory(t.limit(0), "k").first().n == 0


def test_id_gaps(spark):
    t = spark.createDataFrame([(x,) for x in (1, 2, 5, 6, 10, 10, None)], "k int")
    assert sorted(map(tuple, R.id_gaps(t, "k").collect())) == [(3, 4), (7, 9)]


def test_unknown_is_not_zero(spark):
    t = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 5, None)], "k string, v int, c boolean")
    assert rows(t.groupBy("k").agg(R.sum_if_complete(F.col("v"), F.col("c")).alias("s"))) == [("a", 3), ("b", None)]


def test_splice_twice(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, owner string")
    f = spark.createDataFrame([(9,)], "k int")
    once = R.splice(t, "owner", "b", f)
    assert rows(once) == rows(R.splice(once, "owner", "b", f)) == [(1, "a"), (9, "b")]


def test_salted_join_keeps_rows(spark):
    big = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (None, 1)], "k int, i int")
    small = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert R.salted_join(big, small, ["k"]).count() == 300
    assert R.salted_join(big, small, ["k"], "left").count() == 302


def test_text_functions(spark):
    t = spark.createDataFrame([("T12S R22E Sec 14",), ("township 3 N., range 40 W",), ("T1N R2E Sec. 99",), (None,), ("",)], "s string")
    got = [r[0] for r in t.select(text.section_key(text.section_parts(F.col("s")))).collect()]
    assert got == ["012S022E14", None, None, None, None]
    n = spark.createDataFrame([("lots in Sec 14, 15 and 16; lode",), ("none",), (None,)], "s string")
    assert [r[0] for r in n.select(text.listed_sections(F.col("s"))).collect()][:2] == [[14, 15, 16], []]
    d = spark.createDataFrame([("Map at 1:24,000 scale", 24000), ("1:62500", 62500), ("no", None)], "s string, w int")
    assert all(r[0] == r[1] for r in d.select(text.scale_denominator(F.col("s")), "w").collect())


def test_similarity_against_difflib(spark):
    from difflib import SequenceMatcher

    pairs = [("Golden Shovel No. 2", "golden shovel no 2"), ("abc", "abd"), ("", "x"), (None, "x"), ("a b 1", "a b 2")]
    t = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in t.select(text.sequence_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, a, b, autojunk=False).ratio() if a is not None else 0.0 for a, b in pairs]
    s = [r[0] for r in t.select(text.name_similarity(F.col("a"), F.col("b"))).collect()]
    def blend(x, y, off):
        shared = len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
        return min(1.0, 0.6 * SequenceMatcher(None, x, y, autojunk=False).ratio() + 0.4 * shared + off)

    want = [blend("golden shovel", "golden shovel", 0.15), blend("abc", "abd", 0), 0.0, 0.0, blend("a b", "a b", -0.25)]
    assert s == pytest.approx(want)
    more = [("PMG 370", "PMG 371"), ("The Lucky Peach Mine (east drift)", "Lucky Peech claim"), ("Mine No. 2", "Shaft"), ("Blue Bird #07", "bluebird 7")]
    want = [blend("pmg", "pmg", -0.25), blend("lucky peach", "lucky peech", 0), 0.0, blend("blue bird", "bluebird", 0.15)]
    m = spark.createDataFrame(more, "a string, b string")
    assert [r[0] for r in m.select(text.name_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx(want)


def test_quote_score(spark):
    page = "Report. The main vein, sampled for 30 feet, gave two ounces of gold; later work failed."
    t = spark.createDataFrame([("the main vein sampled for 30 feet",), ("the main vein sampled for forty feet",), ("unrelated words here",), ("",), (None,)], "q string")
    got = [r[0] for r in t.select(text.quote_score(F.col("q"), F.lit(page))).collect()]
    assert got[0] == 1.0 and 0.6 < got[1] < 1 and got[2] < 0.4 and got[3:] == [0.0, 0.0]


def test_safe_id(spark):
    import hashlib

    t = spark.createDataFrame([("a",), (None,)], "s string")
    want = int.from_bytes(hashlib.blake2b(b"a", digest_size=8, person=b"lodeframe").digest(), "big") & ((1 << 53) - 1)
    assert [r[0] for r in t.select(text.safe_id(F.col("s"))).collect()] == [want, None]


def test_dates(spark):
    t = spark.createDataFrame([("2001-02-03",), ("2/3/2001",), ("3 Feb 2001",), ("filed 2001-02-03 book 2",), ("31/31/2001",), ("",), (None,)], "s string")
    assert [str(r[0]) for r in t.select(dates.parse_date(F.col("s"))).collect()] == ["2001-02-03"] * 4 + ["None"] * 3
    y = spark.createDataFrame([("1893-1900", 1900), ("c. 1912", 1912), ("12345", None), (None, None)], "s string, w int")
    assert all(r[0] == r[1] for r in y.select(dates.last_year(F.col("s")), "w").collect())


# --- sources and sinks ----------------------------------------------------------------------------


def test_snapshot_strict(spark, tmp_path):
    head, cols = T.StructType.fromDDL("state string, n int"), T.StructType.fromDDL("id bigint, nm string")
    (tmp_path / "a.json").write_text(json.dumps({"state": "ID", "n": 2, "id": [1, 2], "nm": ["a", None]}))
    assert rows(snapshot.read_snapshots(spark, str(tmp_path), head, cols)) == sorted([("ID", 2, 0, 1, "a"), ("ID", 2, 1, 2, None)], key=repr)
    (tmp_path / "b.json").write_text(json.dumps({"state": "NV", "n": 3, "id": [1, 2], "nm": ["a", "b"]}))
    with pytest.raises(Exception, match="ragged or its count"):
        snapshot.read_snapshots(spark, str(tmp_path), head, cols).collect()
    (tmp_path / "b.json").write_text("{broken")
    with pytest.raises(Exception):
        snapshot.read_snapshots(spark, str(tmp_path), head, cols).collect()


def test_delimited_and_zipped(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Instrument No,Document Type,Notes\n1,"Deed, quitclaim","two\nlines"\n2,,\n')
    t = files.read_delimited(spark, str(tmp_path / "x.csv"), {"instrument": ["instrument no"], "doc_type": ["document type"], "book": ["book"]})
    assert rows(t) == [("1", "Deed, quitclaim", None), ("2", None, None)]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("mrds.csv", "dep_id,latitude,site_name\n7,44.5,Alpha\nx,,\n")
        z.writestr("readme.txt", "no")
    assert rows(files.read_zipped_csv(spark, str(tmp_path / "m.zip"), "dep_id bigint, latitude double, site_name string, gone int")) == [(7, 44.5, "Alpha", None), (None, None, None, None)]


def test_geojson(spark, tmp_path):
    f = {"type": "Feature", "id": "1", "properties": {"nm": "a"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}
    (tmp_path / "s.jsonl").write_text("\x1e" + json.dumps(f) + "\n\n" + json.dumps(f) + "\n")
    assert files.read_geojson_seq(spark, str(tmp_path / "s.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text(json.dumps(f) + "\n{broken\n")
    assert files.read_geojson_seq(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception, match="not a feature"):
        files.read_geojson_seq(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [f, f]}))
    assert files.read_geojson(spark, str(tmp_path / "c.geojson")).count() == 2
    lines = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',)], "v string")
    assert [r.extra for r in files.unexpected_keys(lines, "v", ["a"]).collect()] == [["b"]]


def test_markup_and_workbook(spark, tmp_path):
    (tmp_path / "g.gpx").write_text('<gpx><wpt lat="44.1" lon="-114.2"><name>A</name></wpt><wpt lat="1" lon="2"/></gpx>')
    assert rows(files.gpx_points(spark, str(tmp_path / "g.gpx"))) == sorted([("A", -114.2, 44.1), (None, 2.0, 1.0)], key=repr)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Year</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>3.5</v></c></row></sheetData></worksheet>')
    assert [(r.sheet, r.row, r.col, r.value) for r in files.read_workbook(spark, str(tmp_path / "w.xlsx")).collect()] == [(1, 1, 1, "Year"), (1, 1, 28, "3.5")]


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def _field(no, wire, data):
    return _varint(no << 3 | wire) + (_varint(len(data)) + data if wire == 2 else data)


def test_vector_tiles(spark, tmp_path):
    import gzip
    import struct

    zz = lambda v: (v << 1) ^ (v >> 31)
    geom = b"".join(map(_varint, [9, zz(2048), zz(2048)]))
    feature = _field(1, 0, _varint(77)) + _field(2, 2, _varint(0) + _varint(0)) + _field(3, 0, _varint(1)) + _field(4, 2, geom)
    layer = _field(1, 2, b"sites") + _field(2, 2, feature) + _field(3, 2, b"nm") + _field(4, 2, _field(1, 2, b"Alpha")) + _field(5, 0, _varint(4096)) + _field(15, 0, _varint(2))
    tile = gzip.compress(_field(3, 2, layer))
    # tile ids 1 to 4 are zoom 1; one run of two tiles that share data
    directory = gzip.compress(b"".join(map(_varint, [1, 1, 2, len(tile), 1])))
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(directory), 0, 0, 0, 0, 127 + len(directory), len(tile))
    head += b"\x00" * (97 - len(head)) + b"\x02" + b"\x00" * 29
    (tmp_path / "a.pmtiles").write_bytes(head + directory + tile)
    t = tiles.read_tiles(spark, str(tmp_path / "a.pmtiles"))
    assert rows(t.select("z", "x", "y")) == [(1, 0, 0), (1, 0, 1)]
    f = tiles.feature_lon_lat(tiles.tile_features(t)).orderBy("y").first()
    assert (f.layer, f.fid, f.kind, f.properties) == ("sites", 77, 1, {"nm": "Alpha"}) and f.lon == -90.0 and f.lat > 60


def test_paged_source(spark, tmp_path):
    p = f"file://{tmp_path}/p"
    paged.write_pages([(i, {"v": i}) for i in range(1, 11)], spark, p, 3)
    ids = lambda *a: [r.objectid for r in paged.read_pages(spark, p, *a).orderBy("objectid").collect()]
    assert ids(4) == list(range(5, 11)) and ids(4, 6) == [5, 6] and ids(10) == [] and ids() == list(range(1, 11))
    assert len(paged.list_pages(spark, p, 6)) == 2 and len(paged.list_pages(spark, p, 3, 6)) == 1
    assert paged.read_pages(spark, f"file://{tmp_path}/none").count() == 0


def test_resumable_scan(spark, tmp_path, monkeypatch):
    a, b, f = (f"file://{tmp_path}/{x}" for x in "abf")
    paged.write_pages([(i, {}) for i in range(7)], spark, a, 2)
    paged.write_pages([(i, {}) for i in range(5, 9)], spark, b, 2)
    scan = lambda: paged.ResumableScan(spark, f, [a, b])
    assert scan().records().count() == 0 and scan().step(3)
    assert scan().checkpoint()["cursor"] == 5 and sorted(r.objectid for r in scan().records().collect()) == list(range(6))
    # a step that fails after its records are written is taken again
    monkeypatch.setattr(paged, "move_pointer", lambda *x: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        scan().step(3)
    assert scan().records().count() == 6
    monkeypatch.undo()
    while scan().step(3):
        pass
    got = rows(scan().records().select("objectid", "part"))
    assert got == [(i, 0) for i in range(7)] + [(7, 1), (8, 1)] and not scan().step(1)
    with pytest.raises(ValueError, match="malformed"):
        paged.ResumableScan(spark, f, [a]).checkpoint()
    sinks.move_pointer(spark, f"{f}/checkpoint", "scan", {"schema": paged.SCHEMA, "partition": True, "cursor": 1, "rows": 0, "step": 1, "parts": 2})
    with pytest.raises(ValueError, match="malformed"):
        scan().step(1)
    sinks.move_pointer(spark, f"{f}/checkpoint", "scan", {"schema": 0})
    assert scan().checkpoint() is None  # of another schema: begun again



def test_tile_planning():
    pts = [(random.Random(i).random(), random.Random(i + 999).random()) for i in range(400)]
    count = lambda b: sum(b[0] <= x < b[2] and b[1] <= y < b[3] for x, y in pts)
    plan = paged.plan_tiles(count, (0, 0, 1, 1), 60)
    assert sum(count(b) for b, _ in plan) == 400 and all(count(b) < 60 for b, part in plan if not part)
    assert paged.plan_tiles(lambda b: 100, (0, 0, 1, 1), 60, depth=0) == [((0, 0, 1, 1), True)]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(2, None), (1, "a|b")], "k int, v string")
    p = f"file://{tmp_path}/t"
    sinks.replace_table(t, p)
    sinks.replace_table(t.where("k = 1"), p)
    old = sinks.read_table(spark, p)
    assert old.count() == 1
    sinks.replace_table(t, p)
    assert sinks.read_table(spark, p).count() == 2 and old.count() == 1  # a reader that has begun keeps its version
    for _ in range(3):
        sinks.replace_table(t, p)
    assert len(list((tmp_path / "t").glob("data-*"))) <= 3
    a = sinks.install(t, f"file://{tmp_path}/store")
    assert a == sinks.install(t.orderBy("k"), f"file://{tmp_path}/store")
    assert sinks.digest(t) != sinks.digest(t.union(t.limit(1)))
    assert sinks.digest(t.limit(0)) == sinks.digest(t.where("k > 9"))
    sinks.move_pointer(spark, f"file://{tmp_path}/p.json", "x", {"n": 1})
    assert sinks.move_pointer(spark, f"file://{tmp_path}/p.json", "y", {"n": 2}) == {"x": {"n": 1}, "y": {"n": 2}}
    assert sinks.read_pointer(spark, f"file://{tmp_path}/none") == {} and sinks.read_pointer(spark, f"file://{tmp_path}/p.json") == {"x": {"n": 1}, "y": {"n": 2}}
    # a version that another writer has taken isn't overwritten: the move merges again
    taken = f"{tmp_path}/p.json/v000000003.json"
    known = sinks._versions
    calls = []

    def racing(s, path):
        out = known(s, path)
        if not calls:
            open(taken, "w").write('{"z": {"n": 9}}')
        calls.append(1)
        return out

    sinks._versions = racing
    try:
        assert sinks.move_pointer(spark, f"file://{tmp_path}/p.json", "y", {"n": 3}) == {"z": {"n": 9}, "y": {"n": 3}} and len(calls) == 2
    finally:
        sinks._versions = known
    (tmp_path / "p.json" / "v000000009.json").write_text("{broken")
    with pytest.raises(Exception):
        sinks.read_pointer(spark, f"file://{tmp_path}/p.json")
    assert "a\\|b" in sinks.report(t, "T", 1, F.col("k"))


# --- streaming ------------------------------------------------------------------------------------


def test_late_rows_are_dropped(spark, tmp_path):
    from lodeframe.streaming import snapshots as Z
    from lodeframe.streaming import windows as W

    schema = T.StructType.fromDDL("ts timestamp, v int")
    for i, ts in enumerate(["2024-01-01 00:10:00", "2024-01-01 05:00:00", "2024-01-01 00:20:00", "2024-01-01 09:00:00"]):
        spark.createDataFrame([(ts, 1)], "ts string, v int").select(F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    w = W.windowed(W.read_stream(spark, f"{tmp_path}/in", schema), "ts", "1 hour", "1 hour", n=F.count(F.lit(1)))
    Z.drain(w, str(tmp_path), "append")
    got = {str(r.start): r.n for r in W.flat(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got.get("2024-01-01 00:00:00") in (1, 2) and "2024-01-01 09:00:00" not in got


WATCHED = "part string, run int, u int, n int, v int"


def _snap(spark, path, part, run, users, declared=None, files=1):
    rows = [(part, run, u, len(users) if declared is None else declared, v) for u, v in users]
    spark.createDataFrame(rows, WATCHED).repartition(files).write.mode("append").parquet(path)


def _watch(spark, tmp_path, files_per_trigger=1):
    from lodeframe.streaming import snapshots as Z
    from lodeframe.streaming import windows as W

    src = f"{tmp_path}/in"
    watch = Z.SnapshotWatch(f"file://{tmp_path}/w", "part", "run", "n", ["u"], ["v"])
    return src, watch, lambda: watch.start(W.read_stream(spark, src, T.StructType.fromDDL(WATCHED), files_per_trigger), f"{tmp_path}/c").awaitTermination()


def test_snapshot_watch(spark, tmp_path):
    src, watch, run = _watch(spark, tmp_path)
    for part, no, users, declared in [
        ("ID", 1, [(1, 1), (2, 1)], None),  # seeds, no alert
        ("ID", 2, [(1, 1), (3, 1)], None),  # 2 gone, 3 new
        ("ID", 3, [(1, 1)], 2),  # incomplete: unknown
        ("NV", 3, [(9, 1)], None),  # seeds its own part
        ("ID", 4, [(1, 2), (3, 1)], None),  # 1 changed
    ]:
        _snap(spark, src, part, no, users, declared)
        run()
    got = rows(watch.alerts(spark).select("part", "run", "u", "change"))
    assert got == [("ID", 2, 2, "removed"), ("ID", 2, 3, "added"), ("ID", 4, 1, "changed")]
    before = rows(watch.baseline(spark))
    watch.batch(spark.read.schema(T.StructType.fromDDL(WATCHED)).parquet(src).where("run = 4"), 4)  # the same batch again changes nothing
    assert rows(watch.alerts(spark).select("part", "run", "u", "change")) == got and rows(watch.baseline(spark)) == before


@pytest.mark.parametrize("files, per_trigger", [(1, 1), (4, 1), (4, 3), (4, 100)])
def test_snapshot_watch_whatever_the_batches(spark, tmp_path, files, per_trigger):
    src, watch, run = _watch(spark, tmp_path, per_trigger)
    users = [(i, 1) for i in range(8)]
    _snap(spark, src, "ID", 1, users, files=files)
    _snap(spark, src, "ID", 2, users, files=files)  # unchanged
    _snap(spark, src, "ID", 3, users[2:], files=files)
    _snap(spark, src, "ID", 4, users[:5], declared=8, files=files)  # never whole
    run()
    assert rows(watch.alerts(spark).select("run", "u", "change")) == [(3, 0, "removed"), (3, 1, "removed")]
    assert {r.run for r in watch.baseline(spark).collect()} == {3}
    _snap(spark, src, "ID", 4, users[5:], declared=8)  # the rest of run 4 after all, with a repeated record
    _snap(spark, src, "ID", 4, users[7:], declared=8)
    run()
    assert rows(watch.alerts(spark).where("run = 4").select("u", "change")) == [(0, "added"), (1, "added")]


def test_snapshot_watch_stopped_before_the_pointer(spark, tmp_path):
    """A batch that failed after its alerts is run again and gives the same."""
    from lodeframe.streaming import snapshots as Z

    _, watch, _ = _watch(spark, tmp_path)
    one, two = (spark.createDataFrame([("ID", k, u, 2, 1) for u in us], WATCHED) for k, us in ((1, (1, 2)), (2, (2, 3))))
    watch.batch(one, 0)
    move, Z.move_pointer = Z.move_pointer, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped"))
    try:
        with pytest.raises(RuntimeError):
            watch.batch(two, 1)
    finally:
        Z.move_pointer = move
    watch.batch(two, 1)
    assert rows(watch.alerts(spark).select("run", "u", "change")) == [(2, 1, "removed"), (2, 3, "added")]


def test_merged_total(spark):
    from lodeframe.streaming.snapshots import merged_total

    t = spark.createDataFrame([("a", 1, True), ("b", 2, True)], "p string, v int, c boolean")
    assert merged_total(t, "v", "c", ["a", "b"], "p").first().total == 3
    assert merged_total(t, "v", "c", ["a", "b", "z"], "p").first().total is None
    assert merged_total(t.withColumn("c", F.col("p") == "a"), "v", "c", ["a", "b"], "p").first().total is None


# --- the entry ------------------------------------------------------------------------------------


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {"p2_found", "p5_found"} <= set(q)
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).columns == ["row_id", "district_id"]


def test_range_operators_over_several_partitions(spark, monkeypatch):
    """Ranks, gaps and nearest keys carried over the bounds of range partitions."""
    monkeypatch.setattr(R, "RANGE_ROWS", 7)
    rnd = random.Random(2)
    ids = sorted(rnd.sample(range(300), 60))
    t = spark.createDataFrame([(i, float(i % 9)) for i in ids], "k long, v double")
    assert sorted(map(tuple, R.id_gaps(t, "k").collect())) == [(a + 1, b - 1) for a, b in zip(ids, ids[1:]) if b > a + 1]
    ranked = {r.k: r.rank for r in R.dense_rank_where(t, F.col("v") > 2, F.col("k").desc()).collect()}
    good = [i for i in reversed(ids) if i % 9 > 2]
    assert ranked == {i: good.index(i) + 1 if i in good else None for i in ids}
    prices = {k: k * 10 for k in (5, 50, 51, 200)}
    table = spark.createDataFrame(list(prices.items()), "year long, price long")
    got = {r.k: r.price for r in R.nearest_key(t, "k", table, "year", ["price"]).collect()}
    assert got == {i: prices[min(prices, key=lambda y: (abs(y - i), y))] for i in ids}
