"""Problem 6: the best row of each group of rows that transcribe one passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import entities, survivors
from .q_names import rows_part

FIELDS = ["tonnage", "years", "basis", "anchor_hint", "pdf_page", "commodities"]


def passage_key(quote: Column) -> Column:
    """What stays of a passage under scan noise and layout: its numbers in order.

    Digits within words are noise. A passage without numbers is told by its letters.
    """
    numbers = F.regexp_extract_all(quote, F.lit(r"(?=[\d¼½¾])(?<![\p{L}\d.])(\d+(?:,\d{3})*(?:\.\d+)?[¼½¾]?|[¼½¾])(?![\p{L}\d])"), F.lit(1))
    return F.when(F.size(numbers) > 0, F.array_join(numbers, " ")).otherwise(F.lower(F.regexp_replace(quote, r"[^\p{L}]+", "")))


def p6_records(spark: SparkSession, d: str, singles: bool = True) -> DataFrame:
    """Groups of rows with one passage about one mine: best row and voted fields."""
    rows = spark.read.parquet(f"{d}/rows_igs_b11.parquet")
    part = rows_part(spark, d, passage_key(F.col("quote")).alias("_passage"))
    rec = entities.resolve_records([part], ["_passage"]).select(F.col("id").cast("bigint").alias("row_id"), "state", "main", "place", "_passage")
    # one number alone may recur in other passages of the name: the county decides too
    rec = rec.withColumn("_where", F.when(F.col("_passage").contains(" "), F.lit("")).otherwise(F.coalesce("place", F.lit("?"))))
    sources = spark.read.parquet(f"{d}/source_list.parquet").groupBy(survivors.source_key(F.col("src_key")).alias("_src")).agg(F.min("trust_rank").alias("_rank"))
    with_rank = lambda df: df.withColumn("_src", survivors.source_key(F.col("src_key"))).join(F.broadcast(sources), "_src", "left")  # noqa: E731 - tens of sources
    return survivors.best_representatives(
        rows.select("row_id", "extracted_at", "src_key", *FIELDS), ["state", "main", "_where", "_passage"], "row_id", FIELDS,
        1.0 / F.col("_rank"), F.col("_rank"), F.col("extracted_at"), singles=singles, groups=rec, prepare=with_rank,
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each group of two or more rows."""
    return p6_records(spark, d, singles=False).select(F.col("best").alias("row_id"))


QUERIES = {"p6_found": p6_found, "p6_records": p6_records}
ORACLE: dict[str, str] = {}
