"""The best representative of each group of duplicate records, field by field.

Fields are unpivoted to long rows; each row votes for its normalised value with
its source's trust times a decay by age; the winner of each field is taken by
max_by and pivoted back. Along with it comes the best single record of the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

# Entries that fill nothing.
PLACEHOLDERS = ["n/a", "na", "n.a.", "not given", "not stated", "not reported", "not recorded", "unknown", "none", "nil", "null", "no data", "illegible", "tbd"]
_TIGHT = [p.replace(" ", "") for p in PLACEHOLDERS]


def filled(c: Column) -> Column:
    """True where a value says something: not null, blank, a placeholder or a lone mark."""
    s = F.translate(F.lower(c.cast("string")), " \t\n\r\u00a0", "")
    return F.coalesce(s.rlike(r"[\p{L}\p{N}]") & ~s.isin(*_TIGHT), F.lit(False))


def plain(c: Column) -> Column:
    """A value as it is compared: lower case, single spaces, no marks at the edges."""
    s = F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")))
    return F.regexp_replace(s, r"^[\s.,;:?*]+|[\s.,;:?*]+$", "")


def source_key(c: Column) -> Column:
    """A source key however typed: lower case, runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def best_representatives(
    records: DataFrame,
    group: list[str],
    key: str,
    fields: list[str],
    trust: Column,
    rank: Column,
    when: Column,
    half_life_days: float = 730.0,
    singles: bool = True,
    groups: DataFrame | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """One row for each group: ``n`` records, ``best`` (the key of the best record) and the winning value of each field.

    The best record has the most of ``fields`` filled, then the least ``rank``, then
    the latest ``when``, then the least key; nulls of rank and when come last. Values
    of a field win by the sum of trust times decay, ties by the best record that has
    them. Records with a null in ``group`` belong to no group. Without ``singles``
    only groups of two or more come out. A group may be of any size: everything is
    aggregated partially, no list of members is built. Empty tables give none.

    The ``group`` columns are those of ``records``, or of the narrow table ``groups``
    (key and group columns), where keys must be unique on both sides; then
    only the records of groups of two or more are read in full, and ``prepare`` may
    add to those what ``trust``, ``rank`` and ``when`` need.
    """
    narrow = groups if groups is not None else records
    # a group travels as two hashes, 96 bits: two groups in a billion times a billion would meet
    texts = [F.col(c).cast("string") for c in group]
    both, G = {"_g": F.xxhash64(*texts), "_h": F.hash(*texts)}, ["_g", "_h"]
    known = F.lit(True)
    for c in group:
        known = known & F.col(c).isNotNull()
    ids = materialize(narrow.where(known).select(F.col(key), *[c.alias(n) for n, c in both.items()]), "ids")
    sizes = materialize(ids.groupBy(*G).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "sizes")
    age = F.unix_micros(when.cast("timestamp")) / F.lit(86_400e6)
    weight = F.coalesce(trust, F.lit(0.01)) * F.pow(F.lit(2.0), F.coalesce(age - 18_262, F.lit(-7000.0)) / half_life_days)
    values = [F.when(filled(F.col(f)), F.col(f).cast("string")).alias(f"_v{i}") for i, f in enumerate(fields)]
    count = [F.col(f"_v{i}").isNotNull().cast("int") for i in range(len(fields))]
    order = F.struct(sum(count[1:], count[0]).alias("filled"), F.col("_rank").alias("rank"), F.col("_at").alias("at"), (-F.col(key)).alias("key"))
    if groups is not None:
        members = materialize(ids.join(broadcast_if_small(sizes, limit=1 << 20), G), "members")
        src = records.join(broadcast_if_small(members, limit=1 << 20), key)
    else:
        src = records.where(known).withColumns(both).join(broadcast_if_small(sizes, limit=1 << 20), G)
    src = prepare(src).select(*G, "_n", key, weight.alias("_w"), F.coalesce(-rank.cast("double"), F.lit(-1e18)).alias("_rank"), F.coalesce(age, F.lit(-1e9)).alias("_at"), *values)
    many = src.select(*G, "_n", "_w", order.alias("_o"), *[f"_v{i}" for i in range(len(fields))])

    # one long row for each filled field, and one for the record itself
    entries = [F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.lit(i).alias("field"), plain(F.col(f"_v{i}")).alias("norm"), F.col(f"_v{i}").alias("value"))) for i in range(len(fields))]
    record = F.struct(F.lit(-1).alias("field"), F.lit("").alias("norm"), F.lit(None).cast("string").alias("value"))
    long = many.select(*G, "_n", "_w", "_o", F.inline(F.array_compact(F.array(record, *entries))))
    votes = long.groupBy(*G, "field", "norm").agg(F.sum("_w").alias("v"), F.max("_o").alias("o"), F.max_by("value", "_o").alias("value"), F.max("_n").alias("_n"))
    wins = [F.max_by("value", F.when(F.col("field") == i, F.struct("v", "o"))).alias(f) for i, f in enumerate(fields)]
    out = votes.groupBy(*G).agg(F.max("_n").alias("n"), (-F.max("o")["key"]).alias("best"), *wins)
    if singles:
        alone = ids.join(broadcast_if_small(sizes.select(*G), limit=1 << 20), G, "left_anti")
        alone = alone.join(records.select(key, *fields), key) if groups is not None else records.where(known).withColumns(both).join(broadcast_if_small(sizes.select(*G), limit=1 << 20), G, "left_anti")
        alone = alone.select(*G, F.lit(1).cast("bigint").alias("n"), F.col(key).alias("best"), *[F.when(filled(F.col(f)), F.col(f).cast("string")).alias(f) for f in fields])
        out = out.unionByName(alone)
    return out.withColumnRenamed("_g", "group_key").drop("_h")
