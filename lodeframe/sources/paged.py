"""Scans of paged record services from landed pages.

A page is a file of JSON lines, one record each, named by its range of ids:
"page-<from>-<to>.json". Files are listed and written through Hadoop's file system and
read by Spark's own reader, so that any storage will do; a cursor or a range of ids
skips pages by their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sinks import _fs, _write_text, move_pointer, read_pointer

PAGE = "objectid bigint, attributes string"
_NAME = re.compile(r"^page-(\d+)-(\d+)\.json$")


def write_pages(records: list[tuple[int, dict]], spark: SparkSession, folder: str, size: int) -> None:
    """Lands the records of one answer of a service, in the order of their ids, as pages."""
    for k in range(0, len(records), size):
        page = records[k : k + size]
        lines = [json.dumps({"objectid": i, "attributes": json.dumps(a, sort_keys=True)}) + "\n" for i, a in page]
        _write_text(spark, f"{folder}/page-{page[0][0]:012d}-{page[-1][0]:012d}.json", "".join(lines))


def list_pages(spark: SparkSession, folder: str, after: int = -1, up_to: int | None = None) -> list[tuple[int, int, str]]:
    """(from, to, path) of the pages that may hold ids above ``after`` and up to ``up_to``, in order."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    pages = [(int(m[1]), int(m[2]), f.getPath().toString()) for f in fs.listStatus(p) if (m := _NAME.match(f.getPath().getName()))]
    return sorted(x for x in pages if x[1] > after and (up_to is None or x[0] <= up_to))


def read_pages(spark: SparkSession, folder: str, after: int = -1, up_to: int | None = None) -> DataFrame:
    """Records of landed pages with ids above a cursor and up to a last one: (objectid, attributes)."""
    paths = [x[2] for x in list_pages(spark, folder, after, up_to)]
    if not paths:
        return spark.createDataFrame([], PAGE)
    return _above(spark.read.schema(PAGE).json(paths), after, up_to)


def _above(df: DataFrame, after: int, up_to: int | None) -> DataFrame:
    df = df.where(F.col("objectid") > after)
    return df if up_to is None else df.where(F.col("objectid") <= up_to)


def read_box(pages: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Records of a scan whose point, two attributes, lies in a box (x0, y0, x1, y1), edges included."""
    at = lambda k: F.get_json_object("attributes", f"$.{k}").try_cast("double")
    return pages.where(at(x).between(box[0], box[2]) & at(y).between(box[1], box[3]))


SCHEMA = 1


class ResumableScan:
    """A scan of several partitions, one after the other, that goes on where it stopped.

    ``parts`` names the folders of landed pages in their order. A step takes so many pages, appends their
    records to ``folder`` under a number of its own and then moves the checkpoint, so a step that failed is
    taken again and replaces what it left. A checkpoint of another schema is discarded; a broken one is an error.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: list[str]):
        self.spark, self.folder, self.parts = spark, folder, parts

    def checkpoint(self) -> dict | None:
        """Where the scan stands, or None before its first step."""
        at = read_pointer(self.spark, f"{self.folder}/checkpoint").get("scan")
        if at is None or at.get("schema") != SCHEMA:
            return None
        whole = lambda k, least: isinstance(at.get(k), int) and not isinstance(at[k], bool) and at[k] >= least
        if not (whole("partition", 0) and at["partition"] <= len(self.parts) and whole("cursor", -1) and whole("rows", 0) and whole("step", 1) and at.get("parts") == len(self.parts)):
            raise ValueError(f"malformed checkpoint in {self.folder}: {at}")
        return at

    def step(self, pages: int) -> bool:
        """Takes up to ``pages`` pages of the current partition; False where nothing is left."""
        at = self.checkpoint() or {"partition": 0, "cursor": -1, "rows": 0, "step": 0}
        if at["partition"] == len(self.parts):
            return False
        part = self.parts[at["partition"]]
        found = list_pages(self.spark, part, at["cursor"])
        now, n = found[:pages], at["step"] + 1
        new = {"schema": SCHEMA, "parts": len(self.parts), "partition": at["partition"], "cursor": at["cursor"], "rows": at["rows"], "step": n}
        if now:
            path = f"{self.folder}/records/step={n}"
            records = _above(self.spark.read.schema(PAGE).json([x[2] for x in now]), at["cursor"], None)
            records.withColumn("part", F.lit(at["partition"])).write.mode("overwrite").parquet(path)
            new |= {"cursor": now[-1][1], "rows": at["rows"] + self.spark.read.parquet(path).count()}
        if len(found) <= len(now):
            new |= {"partition": at["partition"] + 1, "cursor": -1}
        move_pointer(self.spark, f"{self.folder}/checkpoint", "scan", new)
        return True

    def records(self) -> DataFrame:
        """What the steps behind the checkpoint took; a record that several partitions have comes once."""
        at = self.checkpoint()
        if not at or not at["rows"]:
            return self.spark.createDataFrame([], f"{PAGE}, part int")
        fs, p = _fs(self.spark, f"{self.folder}/records")
        steps = [f.getPath().toString() for f in fs.listStatus(p) if int(f.getPath().getName().split("=")[1]) <= at["step"]]
        return self.spark.read.parquet(*steps).groupBy("objectid").agg(F.min_by("attributes", "part").alias("attributes"), F.min("part").alias("part"))


def reconciled_chunks(ids: DataFrame, records: DataFrame, key: str, size: int) -> DataFrame:
    """The pinned ids of a service against the records that its chunks brought: (chunk, expected, missing, extra, repeated).

    A chunk is a range of ``size`` id values. Only chunks that differ have a row: none at all means the scan is exact.
    """
    a = ids.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    j = a.join(b, key, "full").withColumn("chunk", F.floor(F.col(key) / size))
    n = lambda c: F.count_if(c)
    out = j.groupBy("chunk").agg(n(F.col("_a").isNotNull()).alias("expected"), n(F.col("_b").isNull()).alias("missing"), n(F.col("_a").isNull()).alias("extra"), n((F.coalesce("_a", F.lit(1)) > 1) | (F.coalesce("_b", F.lit(1)) > 1)).alias("repeated"))
    return out.where("missing > 0 or extra > 0 or repeated > 0")


def plan_tiles(count: Callable[[tuple[float, float, float, float]], int], box: tuple[float, float, float, float], cap: int, depth: int = 3) -> list[tuple[tuple[float, float, float, float], bool]]:
    """Boxes to scan so that none exceeds the service's cap: a box that hits it is quartered, ``depth`` times at most.

    The flag tells boxes that still hit the cap (their scan is partial).
    """
    n = count(box)
    if n < cap or depth == 0:
        return [(box, n >= cap)]
    x0, y0, x1, y1 = box
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    return [t for b in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)) for t in plan_tiles(count, b, cap, depth - 1)]


def scan_changes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Records that two passes over one service disagree on: (key, change). Empty if the service didn't change between them."""
    fp = lambda t: t.groupBy(key).agg(F.max(F.xxhash64(*[F.to_json(F.struct(*[c for c in t.columns if c != key]))])).alias("h"))
    a, b = fp(first).withColumnRenamed("h", "_a"), fp(second).withColumnRenamed("h", "_b")
    j = a.join(b, key, "full")
    return j.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").alias("change")).where("change is not null")


def out_of_order(pages: DataFrame, page: str, pos: str, oid: str) -> DataFrame:
    """Records whose id doesn't exceed the one before in their page."""
    w = Window.partitionBy(page).orderBy(pos)
    return pages.withColumn("_p", F.lag(oid).over(w)).where(F.col("_p") >= F.col(oid)).drop("_p")


def newest_capped(df: DataFrame, oid: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """The newest ``cap`` records, and one row with ``truncated``."""
    return df.orderBy(F.col(oid).desc()).limit(cap), df.agg((F.count(F.lit(1)) > cap).alias("truncated"))
