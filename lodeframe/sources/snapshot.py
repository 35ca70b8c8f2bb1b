"""Columnar snapshots: records whose columns are arrays of one length, and their strict reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_columns(df: DataFrame, groups: Sequence[Column], columns: Sequence[str], order: Column) -> DataFrame:
    """One record for each group with an array for each column, in an explicit order, and ``n``.

    Groups are meant to be pages or parts of bounded size.
    """
    g = df.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(order.alias("_o"), *columns))).alias("_a"))
    keys = [c for c in g.columns if c != "_a"]
    return g.select(*keys, F.size("_a").alias("n"), *[F.col("_a").getField(c).alias(c) for c in columns])


def unpack_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of columnar records with their position; a ragged record (arrays of unlike length) gives no row here, see ``ragged``."""
    keep = [c for c in df.columns if c not in columns]
    even = df.where(~ragged(columns))
    return even.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("_pos", "_r")).select(*keep, F.col("_pos").alias("pos"), "_r.*")


def ragged(columns: Sequence[str]) -> Column:
    """Whether the arrays of a record differ in length or one is null."""
    sizes = [F.size(c) for c in columns]
    bad = F.lit(False)
    for c, s in zip(columns, sizes):
        bad = bad | F.col(c).isNull() | (s != sizes[0])
    return bad


def read_snapshots(spark: SparkSession, path: str, header: T.StructType, columns: T.StructType, count: str = "n") -> DataFrame:
    """Rows of JSON snapshot files in columnar form.

    Strict: malformed JSON fails the read, and a record that is ragged or whose
    declared count differs raises. Columns that a file lacks are null arrays only if
    all of them are absent. The result holds the header fields, ``pos`` and the columns.
    """
    fields = [*header.fields, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in columns.fields]]
    raw = spark.read.schema(T.StructType(fields)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    names = [f.name for f in columns.fields]
    wrong = ragged(names) | (F.size(names[0]) != F.col(count))
    raw = raw.withColumn(count, F.when(~wrong, F.col(count)).otherwise(F.raise_error(F.lit("snapshot is ragged or its count differs")).cast(header[count].dataType)))
    return raw.select(*[f.name for f in header.fields], F.posexplode(F.arrays_zip(*names)).alias("pos", "_r")).select(*[f.name for f in header.fields], "pos", "_r.*")


def decode_dictionary(df: DataFrame, index: str, dictionary: Column, name: str) -> DataFrame:
    """Adds the value that an index from 0 has in a dictionary array; null beyond its ends."""
    return df.withColumn(name, F.when(F.col(index) >= 0, F.try_element_at(dictionary, (F.col(index) + 1).cast("int"))))
