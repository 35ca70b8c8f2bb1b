"""Problem 8: passages of eval_items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import leakage


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they repeat and the longest stretch."""
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
ORACLE: dict[str, str] = {}
