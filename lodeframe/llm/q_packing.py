"""Problem 7: texts of documents packed into containers of each capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text, in tokens, with its container for each profile."""
    caps = [(r.profile_id, r.capacity_tokens) for r in spark.read.parquet(f"{d}/pack_profiles.parquet").collect()]  # a handful of profiles
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return packing.pack_items(packing.token_counts(docs, "doc_id", "text"), "doc_id", "n_tokens", caps)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and share of room used for each profile, beside the least number of containers that could do.

    No fewer can do than the tokens fill, nor than there are texts of more than half a container.
    """
    caps = spark.read.parquet(f"{d}/pack_profiles.parquet")
    packed = p7_packed(spark, d).join(F.broadcast(caps), "profile_id")  # a handful of profiles
    boxes = packed.groupBy("profile_id", "capacity_tokens", "container_id").agg(F.sum("size").alias("used"), F.count_if(F.col("size") * 2 > F.col("capacity_tokens")).alias("big"))
    total = boxes.groupBy("profile_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("big").alias("_big"))
    least = F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.col("_big"))
    return total.withColumn("least", least).withColumn("share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).drop("_big")


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
