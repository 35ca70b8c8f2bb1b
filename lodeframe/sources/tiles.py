"""Vector tile archives: directories, tiles and features as rows.

Follows the public PMTiles version 3 and Mapbox Vector Tile version 2
specifications. An archive is read by one task; tiles are decoded in parallel.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def varints(data: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """Unsigned varints of a buffer: (value, position behind it)."""
    value = shift = 0
    for i in range(at, len(data)):
        b = data[i]
        value |= (b & 0x7F) << shift
        if b < 0x80:
            yield value, i + 1
            value = shift = 0
        else:
            shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol buffer message: (number, wire type, value)."""
    at = 0
    while at < len(data):
        key, at = next(varints(data, at))
        no, wire = key >> 3, key & 7
        if wire == 0:
            v, at = next(varints(data, at))
        elif wire == 1:
            v, at = data[at : at + 8], at + 8
        elif wire == 2:
            n, at = next(varints(data, at))
            v, at = data[at : at + n], at + n
        elif wire == 5:
            v, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield no, wire, v


def _zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _value(data: bytes):
    for no, _, v in fields(data):
        if no == 1:
            return v.decode()
        if no == 2:
            return repr(struct.unpack("<f", v)[0])
        if no == 3:
            return repr(struct.unpack("<d", v)[0])
        if no in (4, 5):
            return str(v if v < 1 << 63 else v - (1 << 64))
        if no == 6:
            return str(_zigzag(v))
        if no == 7:
            return "true" if v else "false"
    return None


def decode_tile(data: bytes) -> list[tuple[str, int | None, int, dict, list]]:
    """Features of a tile: (layer, id, kind 1 point / 2 line / 3 polygon, properties, parts in tile units)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out = []
    for no, _, layer in fields(data):
        if no != 3:
            continue
        name, keys, values, feats = "", [], [], []
        for k, _, v in fields(layer):
            if k == 1:
                name = v.decode()
            elif k == 2:
                feats.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(_value(v))
        for f in feats:
            fid, kind, tags, geom = None, 0, [], []
            for k, _, v in fields(f):
                if k == 1:
                    fid = v
                elif k == 2:
                    tags = [x for x, _ in varints(v)]
                elif k == 3:
                    kind = v
                elif k == 4:
                    geom = [x for x, _ in varints(v)]
            parts, x, y, i = [], 0, 0, 0
            while i < len(geom):
                op, n = geom[i] & 7, geom[i] >> 3
                i += 1
                for _ in range(n):
                    if op == 7:
                        continue
                    x, y = x + _zigzag(geom[i]), y + _zigzag(geom[i + 1])
                    i += 2
                    if op == 1 and (kind != 1 or not parts):
                        parts.append([])
                    parts[-1].append((x, y))
            out.append((name, fid, kind, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}, parts))
    return out


def tile_zxy(tile_id: int) -> tuple[int, int, int]:
    """Zoom, column and row of a tile id along the Hilbert curve."""
    z, first = 0, 0
    while first + (1 << 2 * z) <= tile_id:
        first += 1 << 2 * z
        z += 1
    t, x, y, s = tile_id - first, 0, 0, 1
    while s < 1 << z:
        rx, ry = 1 & (t // 2), 0
        ry = 1 & (t ^ rx)
        if ry == 0:
            if rx == 1:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, t, s = x + s * rx, y + s * ry, t // 4, s * 2
    return z, x, y


def directory(data: bytes, compressed: bool = True) -> list[tuple[int, int, int, int]]:
    """Entries of a directory: (tile id, offset, length, run length; run length 0 is a leaf)."""
    if compressed:
        data = gzip.decompress(data)
    stream = varints(data)
    take = lambda: next(stream)[0]
    n = take()
    ids, last = [], 0
    for _ in range(n):
        last += take()
        ids.append(last)
    runs = [take() for _ in range(n)]
    sizes = [take() for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        v = take()
        offsets.append(offsets[i - 1] + sizes[i - 1] if v == 0 and i else v - 1)
    return list(zip(ids, offsets, sizes, runs))


def archive_tiles(blob: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Tiles of an archive: (z, x, y, data), root and leaf directories followed."""
    if blob[:7] != b"PMTiles" or blob[7] != 3:
        raise ValueError("no version 3 archive")
    root_at, root_n, _, _, leaf_at, _, data_at, _ = struct.unpack("<8Q", blob[8:72])
    packed = blob[97] == 2
    todo = [(root_at, root_n)]
    while todo:
        at, n = todo.pop()
        for tid, off, size, run in directory(blob[at : at + n], packed):
            if run == 0:
                todo.append((leaf_at + off, size))
                continue
            for k in range(run):
                yield *tile_zxy(tid + k), blob[data_at + off : data_at + off + size]


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of archives: file, z, x, y, data."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, blob in zip(pdf["path"], pdf["content"]):
                rows = []
                for t in archive_tiles(blob):
                    rows.append((name, *t))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["file", "z", "x", "y", "data"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "z", "x", "y", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, z int, x int, y int, data binary")


def tile_features(tiles: DataFrame) -> DataFrame:
    """Features of tiles: z, x, y, layer, fid, kind, properties, parts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [
                (t.z, t.x, t.y, layer, fid, kind, props, [[{"x": a, "y": b} for a, b in p] for p in geom])
                for t in pdf.itertuples(index=False)
                for layer, fid, kind, props, geom in decode_tile(t.data)
            ]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "fid", "kind", "properties", "parts"])

    schema = "z int, x int, y int, layer string, fid bigint, kind int, properties map<string,string>, parts array<array<struct<x:int,y:int>>>"
    return tiles.select("z", "x", "y", "data").mapInPandas(run, schema)


def feature_lon_lat(features: DataFrame, extent: int = 4096) -> DataFrame:
    """Adds lon and lat of the first point of each feature."""
    from ..functions.shapes import from_mercator

    p = F.col("parts")[0][0]
    n = F.pow(F.lit(2.0), F.col("z"))
    ll = from_mercator((F.col("x") + p["x"] / extent) / n, (F.col("y") + p["y"] / extent) / n)
    return features.withColumn("_ll", ll).select("*", F.col("_ll.lon").alias("lon"), F.col("_ll.lat").alias("lat")).drop("_ll")
