"""Sinks: canonical JSON, feature lines, atomic and content-addressed tables, pointers, reports.

File operations go through Hadoop's file system, so that any storage that Spark
reaches will do. Data is written by the executors; only names move on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import hash_tree
from ..session import materialize


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def canonical_json(columns: list[str]) -> Column:
    """One JSON text a row with keys in order and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def feature_line(fid: Column, x: Column, y: Column, properties: list[str]) -> Column:
    """A GeoJSON point feature as a line; null properties are dropped."""
    geom = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), fid.alias("id"), F.struct(*properties).alias("properties"), geom.alias("geometry")))


def write_feature_lines(df: DataFrame, path: str, fid: str, x: str, y: str, properties: list[str]) -> None:
    """Writes features as line-delimited GeoJSON, one file a partition."""
    df.select(feature_line(F.col(fid), F.col(x), F.col(y), properties)).write.mode("overwrite").text(path)


def digest(df: DataFrame) -> str:
    """Order-free digest of a table's rows, repeats counted.

    Hashes are dealt to buckets by their first bits, as many as the number of distinct rows
    asks for, and buckets to buckets above them: no list holds more than a few thousand hashes, whatever the size.
    """
    r = df.select(F.sha2(canonical_json(df.columns), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return hash_tree(materialize(r.select("h", F.concat_ws(":", "h", "n").alias("e")), "digest"))


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file or folder to a name not in use, in one step; False where another one took the name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, path = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(path(target).toUri(), conf).rename(path(source), path(target), none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception) and not _fs(spark, target)[0].exists(path(target)):
            raise
        _fs(spark, source)[0].delete(path(source), True)
        return False


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces the table kept in a folder; ``read_table`` sees the old or the new one whole, at any time.

    A version is written beside the others, then a pointer is moved to it. The version
    before stays for readers that have begun; older ones are removed.
    """
    spark, name = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    doc = move_pointer(spark, f"{path}/current", "table", lambda old: {"now": name, "before": (old or {}).get("now")})["table"]
    fs, p = _fs(spark, path)
    for f in fs.listStatus(p):
        n = f.getPath().getName()
        if n.startswith("data-") and n not in (doc["now"], doc["before"]) and f.getModificationTime() < fs.getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")).getModificationTime():
            fs.delete(f.getPath(), True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replace_table`` put last."""
    return spark.read.parquet(f"{path}/{read_pointer(spark, f'{path}/current')['table']['now']}")


def install(df: DataFrame, folder: str) -> str:
    """Writes a table under the digest of its content and returns that path; equal content is installed once."""
    spark, name = df.sparkSession, f"{folder}/sha256={digest(df)}"
    fs, target = _fs(spark, name)
    if not fs.exists(target):
        fresh = f"{folder}/_new-{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        _move(spark, fresh, name)
    if digest(spark.read.parquet(name)) != name.rpartition("=")[2]:
        raise ValueError(f"content of {name} differs from its name")
    return name


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(n[1:-5]) for f in fs.listStatus(p) if (n := f.getPath().getName()).startswith("v") and n.endswith(".json"))


def _document(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/v{version:09d}.json", wholetext=True).collect()))  # one small file


def read_pointer(spark: SparkSession, path: str) -> dict:
    """The document a pointer holds, empty before its first move. A broken one is an error, never an empty one."""
    known = _versions(spark, path)
    return _document(spark, path, known[-1]) if known else {}


def move_pointer(spark: SparkSession, path: str, key: str, value: dict | Callable[[dict | None], dict], keep: int = 20) -> dict:
    """Merges an entry into a pointer document and returns the document.

    Each version is a file of its own in the folder ``path``, put there whole by one
    rename to a name not in use: a reader finds the last whole version at any time, and of two writers
    the second one merges again. The last ``keep`` versions stay.
    """
    while True:
        known = _versions(spark, path)
        doc = _document(spark, path, known[-1]) if known else {}
        doc = doc | {key: value(doc.get(key)) if callable(value) else value}
        tmp = f"{path}/_tmp-{uuid.uuid4().hex}"
        _write_text(spark, tmp, json.dumps(doc, sort_keys=True))
        if _move(spark, tmp, f"{path}/v{(known[-1] if known else 0) + 1:09d}.json"):
            fs, p = _fs(spark, path)
            for old in known[: 1 - keep] if keep > 1 else []:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old:09d}.json"), False)
            return doc


def report(df: DataFrame, title: str, top: int, *order: Column) -> str:
    """A Markdown table of the first ``top`` rows (a report of bounded length)."""
    rows = df.orderBy(*order).limit(top).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(cell(v) for v in r)} |\n" for r in rows)
