"""Joins, aggregations, rankings and set operations with the ordering rules of record inventories.

"First wins" and "last wins" are decided by an explicit order, never by the order
of arrival; unknown (null) stays apart from zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import hash_tree
from ..session import materialize


# --- first and last wins ---------------------------------------------------------------------


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order. Null keys form one group. One shuffle, partial aggregates."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.min_by(row, F.struct(*order)) if order else F.first(row)
    return df.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key in an explicit order."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def top_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark prunes groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def capped_list(df: DataFrame, keys: Sequence[str], value: Column, order: Column, k: int, name: str) -> DataFrame:
    """The first k values of each key as an array, in order; no list of more than k values is built."""
    t = df.select(*keys, value.alias("_v"), order.alias("_o"))
    t = top_per_group(t, keys, k, F.col("_o"), F.col("_v"), rank="_r")
    return t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias(name))


#: Rows in a range partition of a table that is put in order; tests set it lower.
RANGE_ROWS = 1 << 20


def dense_rank_where(df: DataFrame, eligible: Column, *order: Column, name: str = "rank") -> DataFrame:
    """A rank 1..n over the eligible rows of the whole table, null for the others.

    Ranks come from a range partitioning, in as many parts as the counted rows ask for, and the
    sizes of the partitions before, so that no single task sorts the table.
    """
    df = df.withColumn("_good", F.coalesce(eligible, F.lit(False)))
    good = materialize(df.where("_good"), "eligible")
    parts = max(1, -(-good.count() // RANGE_ROWS))
    good = good.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    good = good.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    good = good.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    good = materialize(good, "ranked")  # sizes and rows must come from one and the same partitioning
    sizes = good.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))  # one row a partition
    ranked = good.join(F.broadcast(start), "_p").withColumn(name, F.col("_s") + F.col("_i") + 1).drop("_p", "_i", "_s", "_good")
    rest = df.where("not _good").drop("_good").withColumn(name, F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


# --- joins ------------------------------------------------------------------------------------


def fallback_lookup(df: DataFrame, stages: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """Looks a value up in several tables by turns: the first stage with a hit wins; ``stage`` tells which.

    Each stage is (table, keys) and must hold a key once.
    """
    out = df
    for i, (t, keys) in enumerate(stages):
        out = out.join(t.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
    vals = [F.col(f"_v{i}") for i in range(len(stages))]
    which = F.coalesce(*[F.when(v.isNotNull(), F.lit(i + 1)) for i, v in enumerate(vals)])
    return out.withColumn(value, F.coalesce(*vals)).withColumn("stage", which).drop(*[f"_v{i}" for i in range(len(stages))])


def nearest_key(df: DataFrame, key: str, table: DataFrame, table_key: str, values: Sequence[str], later_first: bool = False) -> DataFrame:
    """As-of lookup of the nearest key by absolute difference; ties go to the earlier (or later) key.

    Both neighbours of each distinct key are found by one pass over the union in key
    order, so that no pair is formed but the two that count. The union lies in range partitions; what the
    partitions before and after end and begin with is carried over, one row a partition.
    """
    t = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("_k")).agg(*[F.max(v).alias(v) for v in values])
    known = t.select("_k", F.struct("_k", *values).alias("_row"))
    asked = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct().withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType))
    both = in_ranges(known.unionByName(asked), "_k", name="keys")
    w = Window.partitionBy("_b").orderBy("_k")
    ends = both.groupBy("_b").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_k"))).alias("_last"), F.min_by("_row", F.when(F.col("_row").isNotNull(), F.col("_k"))).alias("_first"))
    parts = Window.orderBy("_b")  # one row a partition
    carried = ends.select("_b", F.last("_last", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    both = both.withColumn("_lo", F.last("_row", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.first("_row", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    both = both.join(F.broadcast(carried), "_b").withColumns({"_lo": F.coalesce("_lo", "_before"), "_hi": F.coalesce("_hi", "_after")})
    lo, hi = F.col("_k") - F.col("_lo._k"), F.col("_hi._k") - F.col("_k")
    near_hi = (hi < lo) | ((hi == lo) & F.lit(later_first))
    pick = F.when(F.col("_lo").isNull(), F.col("_hi")).when(F.col("_hi").isNull(), F.col("_lo")).when(near_hi, F.col("_hi")).otherwise(F.col("_lo"))
    near = both.where("_row is null").select(F.col("_k").alias(key), pick.alias("_n")).select(key, F.col("_n._k").alias(f"near_{table_key}"), *[F.col(f"_n.{v}").alias(v) for v in values])
    return df.join(near, key, "left")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt: int = 16) -> DataFrame:
    """Equi-join that deals the rows of each key of ``big`` to ``salt`` buckets and repeats ``small`` in each.

    For keys that hold a large share of the rows where AQE can't split them.
    """
    a = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salt)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


# --- sets ---------------------------------------------------------------------------------------


def missing_and_extra(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with ``side`` 'missing' or 'extra'; empty exactly if the sets are equal. Nulls are keys too."""
    e = expected.select(F.col(key).alias("k")).distinct().withColumn("_e", F.lit(1))
    o = observed.select(F.col(key).alias("k")).distinct().withColumn("_o", F.lit(1))
    j = e.join(o, e["k"].eqNullSafe(o["k"]), "full").select(F.coalesce(e["k"], o["k"]).alias(key), "_e", "_o")
    return j.where("_e is null or _o is null").select(key, F.when(F.col("_o").isNull(), "missing").otherwise("extra").alias("side"))


def splice(df: DataFrame, owner: str, name: str, fresh: DataFrame) -> DataFrame:
    """Replaces the rows that an owner put in earlier by fresh ones; running it again changes nothing."""
    return df.where(~F.col(owner).eqNullSafe(F.lit(name))).unionByName(fresh.withColumn(owner, F.lit(name)), allowMissingColumns=True)


def snapshot_diff(prior: DataFrame, current: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Full-outer difference of two snapshots: (key, change) with change in added, removed, changed."""
    p = prior.select(*key, F.struct(*payload).alias("_p"))
    c = current.select(*key, F.struct(*payload).alias("_c"))
    j = p.join(c, key, "full")
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(~F.col("_p").eqNullSafe(F.col("_c")), "changed")
    return j.select(*key, change.alias("change")).where("change is not null")


# --- inventories ----------------------------------------------------------------------------------


def id_inventory(df: DataFrame, key: str) -> DataFrame:
    """Count, distinct count and an order-free digest of the ids of a table.

    Any two tables with the same set of ids agree. Ids are hashed bucket by bucket, in as many buckets as
    their number asks for, so that no task sees more than a few thousand of them at once.
    """
    d = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    d = materialize(d.withColumn("h", F.sha2("e", 256)), "ids")
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_distinct")).withColumn("digest", F.lit(hash_tree(d.select("h", "e"))))


def in_ranges(df: DataFrame, *order: Column | str, name: str = "ranges") -> DataFrame:
    """A written table in range partitions numbered in ``_b``, as many as the counted rows ask for."""
    df = materialize(df, name)
    parts = max(1, -(-df.count() // RANGE_ROWS))
    return materialize(df.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()), name)


def id_gaps(df: DataFrame, key: str) -> DataFrame:
    """Ranges of whole numbers missing between the least and greatest id: (gap_from, gap_to)."""
    d = in_ranges(df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k")).distinct(), "k", name="ids")
    w = Window.partitionBy("_b").orderBy("k")
    inner = d.select(F.lag("k").over(w).alias("p"), "k")
    ends = d.groupBy("_b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))  # one row a partition
    outer = ends.select(F.lag("hi").over(Window.orderBy("_b")).alias("p"), F.col("lo").alias("k"))
    return inner.unionByName(outer).where("p is not null and k > p + 1").select((F.col("p") + 1).alias("gap_from"), (F.col("k") - 1).alias("gap_to"))


def sum_if_complete(value: Column, complete: Column) -> Column:
    """A sum that is null unless every contributor is complete: unknown is not zero."""
    return F.when(F.bool_and(F.coalesce(complete, F.lit(False))), F.sum(value))


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Sum over items of the lesser count on both sides, for each key."""
    a = left.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, [*keys, item]).groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("overlap"))


def conflicting_ids(df: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Ids that occur with differing payloads; equal repeats are no conflict."""
    fp = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fp).alias("versions")).where("versions > 1")
