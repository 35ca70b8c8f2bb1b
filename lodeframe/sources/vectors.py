"""Vector files: zipped shapefiles and GeoPackages as rows (public formats, read in plain Python, one file a task)."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SHAPES = "file string, layer string, fid bigint, kind int, parts array<array<struct<x:double,y:double>>>, properties map<string,string>"
_COLS = ["file", "layer", "fid", "kind", "parts", "properties"]


def shapes(shp: bytes) -> Iterator[tuple[int, list]]:
    """Records of a .shp: (shape type, parts); measures and heights are passed over."""
    at = 100
    while at + 8 <= len(shp):
        words = struct.unpack(">i", shp[at + 4 : at + 8])[0]
        rec = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", rec[:4])[0] % 10
        if kind == 1:
            x, y = struct.unpack("<2d", rec[4:20])
            yield kind, [[{"x": x, "y": y}]]
        elif kind in (3, 5, 8):
            if kind == 8:
                n = struct.unpack("<i", rec[36:40])[0]
                starts, off = [0], 40
            else:
                m, n = struct.unpack("<2i", rec[36:44])
                starts, off = list(struct.unpack(f"<{m}i", rec[44 : 44 + 4 * m])), 44 + 4 * m
            xy = struct.unpack(f"<{2 * n}d", rec[off : off + 16 * n])
            pts = [{"x": a, "y": b} for a, b in zip(xy[::2], xy[1::2])]
            yield kind, [pts[a:b] for a, b in zip(starts, [*starts[1:], n])]
        else:
            yield 0, []


def dbf_rows(dbf: bytes, encoding: str = "latin-1") -> Iterator[dict]:
    """Records of a .dbf as text values; blank ones are left out, deleted records too."""
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    cols, at = [], 32
    while dbf[at] != 0x0D:
        cols.append((dbf[at : at + 11].split(b"\0")[0].decode(encoding), dbf[at + 16]))
        at += 32
    for i in range(n):
        rec, off, row = dbf[head + i * size : head + (i + 1) * size], 1, {}
        for name, w in cols:
            v = rec[off : off + w].decode(encoding).strip()
            if v:
                row[name] = v
            off += w
        if rec[:1] != b"*":
            yield row


def wkb_parts(b: bytes, at: int = 0) -> tuple[int, list, int]:
    """Type, parts and end of a well-known binary shape; multi shapes are flattened to their parts."""
    o = "<" if b[at] else ">"
    kind = struct.unpack(o + "I", b[at + 1 : at + 5])[0]
    dims = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    base, at = kind % 1000, at + 5

    def points(n: int, at: int):
        v = struct.unpack(f"{o}{dims * n}d", b[at : at + 8 * dims * n])
        return [{"x": v[i], "y": v[i + 1]} for i in range(0, len(v), dims)], at + 8 * dims * n

    if base == 1:
        p, at = points(1, at)
        return 1, [p], at
    n = struct.unpack(o + "I", b[at : at + 4])[0]
    at += 4
    if base == 2:
        p, at = points(n, at)
        return 3, [p], at
    out, sub = [], 0
    for _ in range(n):
        if base == 3:
            m = struct.unpack(o + "I", b[at : at + 4])[0]
            p, at = points(m, at + 4)
            out.append(p)
            sub = 5
        else:
            sub, p, at = wkb_parts(b, at)
            out += p
    return sub, out, at


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """Features of zipped shapefiles; each .shp in an archive is a layer."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for pdf in parts:
            for name, blob in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for m in sorted(x for x in z.namelist() if x.lower().endswith(".shp")):
                        dbf = next((x for x in z.namelist() if x.lower() == m[:-4].lower() + ".dbf"), None)
                        props = list(dbf_rows(z.read(dbf))) if dbf else []
                        rows = [(name, m.rsplit("/", 1)[-1][:-4], i, k, p, props[i] if i < len(props) else {}) for i, (k, p) in enumerate(shapes(z.read(m)))]
                        yield pd.DataFrame(rows, columns=_COLS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SHAPES)


def read_geopackages(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoPackage files, all feature layers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for pdf in parts:
            for name, blob in zip(pdf["path"], pdf["content"]):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(blob))
                for layer, geom in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1").fetchall():
                    cur = db.execute(f'SELECT rowid, * FROM "{layer}"')
                    cols, rows = [c[0] for c in cur.description], []
                    for r in cur:
                        row = dict(zip(cols[1:], r[1:]))
                        g = row.pop(geom)
                        kind, shape = 0, []
                        if g is not None and not g[3] & 0x10:
                            skip = 8 + (0, 32, 48, 48, 64)[g[3] >> 1 & 7]
                            kind, shape, _ = wkb_parts(g, skip)
                        rows.append((name, layer, r[0], kind, shape, {k: str(v) for k, v in row.items() if v is not None}))
                    yield pd.DataFrame(rows, columns=_COLS)
                db.close()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SHAPES)
