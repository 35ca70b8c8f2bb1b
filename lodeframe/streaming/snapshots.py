"""Differences of arriving snapshots, kept exactly once.

A snapshot is a run of a partition (a state, a system) and may arrive in any number
of micro-batches and files, mixed with others: every row carries the number of records
that its run declares, and a run is whole once so many distinct records have come. What isn't
whole waits; it is unknown, not empty. Whole runs are compared in their order, each
with the one before it. The first one of a partition seeds the baseline and raises
no alert. Alerts, baseline and waiting rows are written under the batch id before
the pointer moves, so a batch that runs again writes the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import snapshot_diff
from ..session import broadcast_if_small, materialize
from ..sources.sinks import _fs, move_pointer, read_pointer


class SnapshotWatch:
    """Alerts and baselines in a folder on shared storage.

    ``part`` names the partition column, ``run`` the snapshot's id (a greater one is
    later), ``declared`` the number of records of the run, ``key`` and ``payload`` the
    record. A run without a declared number, or with two, is never whole; one that is whole only
    after a later one of its partition comes too late and is left out. Rows with a null
    partition or run are left out; a record that comes twice counts once.
    """

    def __init__(self, folder: str, part: str, run: str, declared: str, key: list[str], payload: list[str]):
        self.folder, self.part, self.run, self.declared, self.key, self.payload = folder, part, run, declared, key, payload

    def batch(self, df: DataFrame, batch_id: int) -> None:
        """foreachBatch function; safe to run again with the same batch."""
        spark, of = df.sparkSession, [self.part, self.run]
        state = read_pointer(spark, f"{self.folder}/pointer").get("current")
        if state and state["batch"] >= batch_id:
            return
        rows = df.where(F.col(self.part).isNotNull() & F.col(self.run).isNotNull()).select(*of, self.declared, *self.key, *self.payload)
        if state:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(state["waiting"]))
        rows = materialize(rows.dropDuplicates([*of, *self.key]), "arrived")
        prior = spark.read.schema(rows.schema).parquet(state["baseline"]) if state else rows.limit(0)
        # runs that are whole and later than the baseline of their partition: one row a run, so a small table whatever the records
        size = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"), F.min(self.declared).alias("_lo"), F.max(self.declared).alias("_hi"))
        base = prior.groupBy(self.part).agg(F.max(self.run).alias("_base"))
        runs = size.join(base, self.part, "left").where(F.col("_base").isNull() | (F.col(self.run) > F.col("_base")))
        runs = materialize(runs.withColumn("_whole", F.coalesce((F.col("_n") == F.col("_lo")) & (F.col("_n") == F.col("_hi")), F.lit(False))), "runs")
        order = Window.partitionBy(self.part).orderBy(self.run)  # the runs of one batch and those waiting
        whole = runs.where("_whole").withColumn("_next", F.lead(self.run).over(order)).withColumn("_first", F.coalesce(F.lag(self.run).over(order), F.col("_base")).isNull())
        whole = materialize(whole.select(*of, "_next", "_first"), "whole")
        current = rows.join(broadcast_if_small(whole, limit=1 << 20), of)
        first = whole.groupBy(self.part).agg(F.min(self.run).alias("_to"), F.max(self.run).alias("_last"))
        before = prior.join(broadcast_if_small(first, limit=1 << 20), self.part).select(self.part, F.col("_to").alias("_run"), *self.key, *self.payload)
        before = before.unionByName(current.where("_next is not null").select(self.part, F.col("_next").alias("_run"), *self.key, *self.payload))
        after = current.where("not _first").select(self.part, F.col(self.run).alias("_run"), *self.key, *self.payload)
        alerts = snapshot_diff(before, after, [self.part, "_run", *self.key], self.payload).withColumnRenamed("_run", self.run)
        alerts.write.mode("overwrite").parquet(f"{self.folder}/alerts/batch={batch_id}")
        newest = current.where("_next is null").select(rows.columns)
        keep = prior.join(broadcast_if_small(first, limit=1 << 20), self.part, "left_anti")
        new = {n: f"{self.folder}/{n}/batch={batch_id}" for n in ("baseline", "waiting")}
        keep.unionByName(newest).write.mode("overwrite").parquet(new["baseline"])
        late = runs.join(first, self.part, "left").where("not _whole").where(F.col("_last").isNull() | (F.col(self.run) > F.col("_last"))).select(*of)
        rows.join(broadcast_if_small(materialize(late, "late"), limit=1 << 20), of, "left_semi").write.mode("overwrite").parquet(new["waiting"])
        move_pointer(spark, f"{self.folder}/pointer", "current", {"batch": batch_id, **new})

    def start(self, stream: DataFrame, checkpoint: str):
        """Runs the stream over what is there (availableNow)."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def alerts(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/alerts").parquet(f"{self.folder}/alerts")

    def baseline(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(read_pointer(spark, f"{self.folder}/pointer")["current"]["baseline"])


def merged_total(parts: DataFrame, value: str, complete: str, expected: list[str], part: str) -> DataFrame:
    """A total over partitions that is null unless every expected one is there and complete."""
    t = parts.where(F.col(part).isin(expected))
    ok = F.bool_and(F.coalesce(complete, F.lit(False))) & (F.count_distinct(part) == len(expected))
    return t.agg(F.when(ok, F.sum(value)).alias("total"), F.count_distinct(part).alias("parts"))


CHANGES = "key string, was string, now string, ts timestamp"


def status_changes(events: DataFrame, key: str, status: str, ts: str) -> DataFrame:
    """Changes of a key's status on a stream, by state kept for each key: (key, was, now, ts).

    The first status seeds and gives no change. Rows of a batch are taken in the order
    of their time; a row older than the state's comes too late and changes nothing, so over
    several batches the answer is that of the rows that came in time.
    """

    def step(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was, at = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(pdfs)).sort_values(["ts", "status"])
        for r in rows.itertuples(index=False):
            t = r.ts.value // 1000
            if at is not None and t < at:
                continue
            if was is not None and r.status != was:
                out.append((k[0], was, r.status, r.ts))
            was, at = r.status, t
        state.update((was, at))
        yield pd.DataFrame(out, columns=["key", "was", "now", "ts"])

    src = events.select(F.col(key).cast("string").alias("key"), F.col(status).alias("status"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and status is not null and ts is not null")
    return src.groupBy("key").applyInPandasWithState(step, CHANGES, "status string, at bigint", "append", "NoTimeout")


def drain(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a streaming query over what is there and writes its result as Parquet, whole in mode complete."""
    path = f"{folder}/out"

    def put(b: DataFrame, i: int) -> None:
        b.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={i}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema
