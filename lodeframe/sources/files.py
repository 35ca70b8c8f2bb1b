"""Readers of record files: delimited exports, zipped CSV, GeoJSON, KML/GPX/GML, workbooks and page texts.

All are plain DataFrames with an explicit schema; Python appears only where a
container format (zip, xlsx) has to be opened, one file a row.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_key(name: str) -> str:
    """A header in plain form: lower case, words joined by one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def resolve_headers(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Columns by canonical name: the first alias in order that a header equals in plain form."""
    plain = {header_key(c): c for c in reversed(columns)}
    return {name: plain[key] for name, al in aliases.items() if (key := next((header_key(a) for a in [name, *al] if header_key(a) in plain), None))}


def read_delimited(spark: SparkSession, path: str, aliases: dict[str, list[str]], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited export with sniffed headers: the canonical columns as text, those absent as null."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    have = resolve_headers(raw.columns, aliases)
    return raw.select(*[F.col(f"`{have[n]}`").alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in aliases])


def read_zipped_csv(spark: SparkSession, path: str, schema: str, member: str = r"\.csv$", encoding: str = "utf-8") -> DataFrame:
    """Rows of CSV members of zip archives, a header each; one archive is one task."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import zipfile

        for pdf in parts:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for m in z.namelist():
                        if re.search(member, m):
                            rows, cols = [], None
                            for r in csv.reader(io.TextIOWrapper(z.open(m), encoding=encoding, newline="")):
                                if cols is None:
                                    cols = {header_key(h): i for i, h in enumerate(r)}
                                    continue
                                rows.append([r[cols[n]] if n in cols and cols[n] < len(r) and r[cols[n]] != "" else None for n in names])
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=names)
                                    rows = []
                            yield pd.DataFrame(rows, columns=names)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{n} string" for n in names))
    return raw.select(*[F.expr(f"try_cast({f.name} as {f.dataType.simpleString()})").alias(f.name) for f in T.StructType.fromDDL(schema).fields])


POINT = "type string, geometry struct<type:string, coordinates:array<double>>, id string, properties map<string,string>"


def read_geojson_seq(spark: SparkSession, path: str, schema: str = POINT, strict: bool = True) -> DataFrame:
    """Features of line-delimited GeoJSON, with or without record separators.

    Strict: a line that is no JSON of a Feature fails the query; else it is dropped.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x1e", "").alias("v")).where(F.trim("v") != "")
    f = F.from_json("v", schema)
    ok = F.coalesce(f["type"] == "Feature", F.lit(False))
    if strict:
        f = F.when(ok, f).otherwise(F.raise_error(F.concat(F.lit("not a feature: "), F.substring("v", 1, 80))).cast(T.StructType.fromDDL(schema)))
        return lines.select(f.alias("f")).select("f.*")
    return lines.select(f.alias("f"), ok.alias("ok")).where("ok").select("f.*")


def read_geojson(spark: SparkSession, path: str, schema: str = POINT) -> DataFrame:
    """Features of FeatureCollection files."""
    return spark.read.schema(f"type string, features array<struct<{_colons(schema)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("features"))


def _colons(ddl: str) -> str:
    s = T.StructType.fromDDL(ddl).simpleString()
    return s[len("struct<") : -1]


def unexpected_keys(lines: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """JSON objects with keys beyond the allowed ones: (line, extra)."""
    extra = F.array_except(F.json_object_keys(column), F.array(*[F.lit(a) for a in allowed]))
    return lines.select(F.col(column).alias("line"), extra.alias("extra")).where(F.size("extra") > 0)


def read_markup(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of XML documents (KML placemarks, GPX way points, GML members) as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)


def kml_points(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with a point: name, lon, lat."""
    t = read_markup(spark, path, "Placemark", "name string, Point struct<coordinates:string>")
    xy = F.split(F.trim("Point.coordinates"), ",")
    return t.select("name", F.try_element_at(xy, F.lit(1)).cast("double").alias("lon"), F.try_element_at(xy, F.lit(2)).cast("double").alias("lat"))


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """Way points: name, lon, lat."""
    t = read_markup(spark, path, "wpt", "_lat double, _lon double, name string")
    return t.select("name", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Cells of workbook files: file, sheet, row and column from 1, value as text. One workbook is one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile
        from xml.etree import ElementTree as E

        n = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for pdf in parts:
            for name, blob in zip(pdf["path"], pdf["content"]):
                out = []
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(n + "t")) for si in E.fromstring(z.read("xl/sharedStrings.xml")).iter(n + "si")]
                    for sheet in sorted(m for m in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", m)):
                        no = int(re.search(r"(\d+)\.xml", sheet).group(1))
                        for c in E.fromstring(z.read(sheet)).iter(n + "c"):
                            letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                            col = 0
                            for ch in letters:
                                col = col * 26 + ord(ch) - 64
                            v = c.find(n + "v")
                            text = v.text if v is not None else "".join(t.text or "" for t in c.iter(n + "t"))
                            if c.get("t") == "s" and text:
                                text = shared[int(text)]
                            if text not in (None, ""):
                                out.append((name, no, int(digits), col, text))
                yield pd.DataFrame(out, columns=["file", "sheet", "row", "col", "value"])

    blobs = spark.read.format("binaryFile").load(path).select("path", "content")
    return blobs.mapInPandas(run, "file string, sheet int, row int, col int, value string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page-indexed texts as rows (src_key, pdf_page, text), pages from 1 plus the offset.

    A line is {key, offset, first, pages[]}; a long document comes in several, ``first`` (0 where absent) being the pages before.
    """
    t = spark.read.schema("key string, offset int, first int, pages array<string>").json(path)
    at = F.coalesce("offset", F.lit(0)) + F.coalesce("first", F.lit(0))
    return t.select(F.col("key").alias("src_key"), at.alias("_o"), F.posexplode("pages").alias("_i", "text")).select("src_key", (F.col("_i") + 1 + F.col("_o")).alias("pdf_page"), "text")
