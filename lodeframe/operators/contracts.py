"""Requests as bounded sets of conditions, layer projections from a specification, and checks of inventories."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, valid_point


@dataclass(frozen=True)
class Contract:
    """What a request may ask of a table; conditions are combined by AND, absent ones don't restrict.

    ``one_of`` and ``equal`` map a request's key to a column, ``contains`` to a column searched without
    regard to case, ``at_least`` to a number, ``flag`` to a condition in SQL that holds if the
    key is true. ``point`` names longitude and latitude for near_lon, near_lat and radius_km.
    Rows come in ``order``, ``limit`` of them, never more than ``most``.
    """

    one_of: dict[str, str] = field(default_factory=dict)
    equal: dict[str, str] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    at_least: dict[str, str] = field(default_factory=dict)
    flag: dict[str, str] = field(default_factory=dict)
    point: tuple[str, str] | None = None
    order: tuple[str, ...] = ()
    default_limit: int = 8
    most: int = 20
    default_radius_km: float = 25.0

    def condition(self, request: dict[str, Any]) -> Column:
        """The conditions of a request; a key that the contract doesn't know, or half a point, is an error."""
        known = {*self.one_of, *self.equal, *self.contains, *self.at_least, *self.flag, "limit", *(("near_lat", "near_lon", "radius_km") if self.point else ())}
        if unknown := set(request) - known:
            raise ValueError(f"unknown conditions: {sorted(unknown)}")
        ask = {k: v for k, v in request.items() if v is not None}
        conditions = [F.col(c).isin(list(ask[k])) for k, c in self.one_of.items() if k in ask]
        conditions += [F.col(c) == F.lit(ask[k]) for k, c in self.equal.items() if k in ask]
        conditions += [F.lower(c).contains(str(ask[k]).lower()) for k, c in self.contains.items() if k in ask]
        conditions += [F.col(c) >= F.lit(ask[k]) for k, c in self.at_least.items() if k in ask]
        conditions += [F.expr(e) for k, e in self.flag.items() if ask.get(k)]
        if ("near_lat" in ask) != ("near_lon" in ask):
            raise ValueError("near_lat and near_lon go together")
        if "near_lat" in ask:
            x, y = (F.col(c).cast("double") for c in self.point)
            lat, lon, km = float(ask["near_lat"]), float(ask["near_lon"]), float(ask.get("radius_km", self.default_radius_km))
            reach = km / 110.5  # the band of latitudes prunes files before distances are taken
            conditions += [y.between(lat - reach, lat + reach), valid_point(y, x), haversine_m(F.lit(lat), F.lit(lon), y, x) <= km * 1000]
        return reduce(lambda a, b: a & b, conditions, F.lit(True))

    def count(self, df: DataFrame, request: dict[str, Any]) -> DataFrame:
        return df.where(self.condition(request)).agg(F.count(F.lit(1)).alias("n"))

    def rows(self, df: DataFrame, request: dict[str, Any]) -> DataFrame:
        """The first rows of an answer (a report of bounded length)."""
        n = max(0, min(int(request.get("limit") or self.default_limit), self.most))
        return df.where(self.condition(request)).orderBy(*[F.expr(o[1:]).desc() if o.startswith("-") else F.expr(o).asc() for o in self.order]).limit(n)


# --- projections ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """A column of a layer: an expression in SQL, its type and what makes a value invalid.

    A text is trimmed, blank is null, and longer than ``limit`` is invalid; a number must be finite and
    lie between ``low`` and ``high``. ``required`` values must not be null.
    """

    expr: str
    kind: str = "string"
    required: bool = False
    limit: int | None = None
    low: float | None = None
    high: float | None = None

    def value(self) -> Column:
        c = F.expr(self.expr)
        return F.nullif(F.trim(c.cast("string")), F.lit("")) if self.kind == "string" else c.cast(self.kind)

    def fault(self) -> Column:
        v = self.value()
        wrong = v.isNull() if self.required else F.lit(False)
        if self.kind == "string" and self.limit is not None:
            wrong = wrong | F.coalesce(F.length(v) > self.limit, F.lit(False))
        if self.kind in ("double", "float"):
            wrong = wrong | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
        for bound, outside in ((self.low, lambda: v < self.low), (self.high, lambda: v > self.high)):
            if bound is not None:
                wrong = wrong | F.coalesce(outside(), F.lit(False))
        return wrong


@dataclass(frozen=True)
class Layer:
    """A layer of features: its columns by name, the rows it takes, and constants that tell where they come from."""

    fields: dict[str, Field]
    where: str = "true"
    constants: dict[str, str] = field(default_factory=dict)

    def _judged(self, df: DataFrame) -> DataFrame:
        taken = df.where(F.expr(self.where))
        faults = F.array_compact(F.array(*[F.when(f.fault(), F.lit(n)) for n, f in self.fields.items()]))
        return taken.select(*[f.value().alias(n) for n, f in self.fields.items()], *[F.lit(v).alias(n) for n, v in self.constants.items()], faults.alias("faults"))

    def project(self, df: DataFrame) -> DataFrame:
        """Rows without a fault."""
        return self._judged(df).where(F.size("faults") == 0).drop("faults")

    def rejected(self, df: DataFrame) -> DataFrame:
        """Rows with faults, named in ``faults``: nothing is lost silently."""
        return self._judged(df).where(F.size("faults") > 0)


def union_layers(parts: list[tuple[DataFrame, Layer]]) -> DataFrame:
    """Several projected layers in one table; columns a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [layer.project(df) for df, layer in parts])


# --- inventories ------------------------------------------------------------------------------------


def partial_reasons(flags: list[str], declared: Column, emitted: Column, attested: Column) -> Column:
    """Why a snapshot can't be taken for whole, as an array: flags that are set, more declared than emitted, no attestation.

    A null flag is unset, a null declared number declares nothing, and a null attestation attests nothing.
    """
    found = [F.when(~F.coalesce(attested, F.lit(False)), F.lit("attestation absent or incomplete"))]
    found += [F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags]
    found += [F.when(F.coalesce(declared > emitted, F.lit(False)), F.lit("declared exceeds emitted rows"))]
    return F.array_compact(F.array(*found))


def pages_attested(pages: DataFrame, part: str, first: str, last: str, n: str, total: str) -> DataFrame:
    """Whether the pages of each partition attest a whole scan: (part, attested).

    Pages say their first and last id, their number of rows and the service's total. They must follow one another
    without overlap, agree on one total, and their rows must come to it. No page at all attests nothing and has no row.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(part).orderBy(first, last)  # the pages of one scan, not its rows
    p = pages.withColumn("_before", F.lag(last).over(w))
    sound = F.coalesce((F.col(first) <= F.col(last)) & (F.col("_before").isNull() | (F.col("_before") < F.col(first))), F.lit(False))
    agreed = (F.count_distinct(total) == 1) & (F.sum(n) == F.max(total)) & (F.count(F.lit(1)) == F.count(total))
    return p.groupBy(part).agg((F.bool_and(sound) & F.coalesce(agreed, F.lit(False))).alias("attested"))


def zero_proof(manifest: DataFrame, rows: DataFrame, part: str, declared: str, complete: str) -> DataFrame:
    """Partitions that are proven empty: (part, proven).

    A zero counts only if the manifest declares it, the partition is complete, no row of it is there, and every partition's declared number is the observed one.
    """
    seen = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    both = manifest.select(part, declared, complete).join(seen, part, "full").withColumn("_n", F.coalesce("_n", F.lit(0)))
    bound = both.agg(F.coalesce(F.bool_and(F.coalesce(F.col(declared) == F.col("_n"), F.lit(False))), F.lit(False)).alias("_bound"))
    zero = both.where(F.col(declared) == 0)
    ok = F.coalesce(F.col(complete), F.lit(False)) & (F.col("_n") == 0)
    return zero.join(F.broadcast(bound)).select(part, (ok & F.col("_bound")).alias("proven"))  # one row
