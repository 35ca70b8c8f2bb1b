"""Problem 9: garbled text from a wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import encoding


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Damaged documents with spans, pair and the restored text."""
    return encoding.repair(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with such damage anywhere."""
    return p9_repaired(spark, d).select("doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_repaired": p9_repaired}
ORACLE: dict[str, str] = {}
