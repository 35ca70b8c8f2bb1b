"""Quantities of different sources in common units (grams per metric tonne)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import conversion_rows, extract_quantities, unit_id

#: Relative difference below which two printed numbers count as the same.
SAME = 1e-9


def factors(df: DataFrame) -> DataFrame:
    """The conversion table (unit, g_per_t), about twenty rows, broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(conversion_rows(), "unit string, g_per_t double"))


def _stated(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c >= 0)


def _same(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= SAME * F.greatest(F.abs(a), F.abs(b))


def _entry(element: Column | str, value: Column, unit: Column, origin: str) -> Column:
    el = F.lit(element) if isinstance(element, str) else element
    return F.struct(el.alias("commodity"), value.alias("value"), unit.alias("unit"), F.lit(origin).alias("origin"))


def row_quantities(
    rows: DataFrame, prices: DataFrame, key: str, fields: dict[str, tuple[str, str]], quote: str, usd: str, main: str, year: str, gold: str = "Au"
) -> DataFrame:
    """Every quantity of flat records, one row each, in grams per metric tonne.

    ``fields`` maps a numeric field to (commodity, unit id). Where the quote states
    the same number for the commodity with a unit, that unit holds (and of a range
    the lower end), else that of the field. Quantities of the quote that no field
    repeats count by themselves where no field states that commodity. Dollars
    (field ``usd`` or the quote) count as gold only where ``main`` is gold, no gold
    quantity is given, and ``prices`` (commodity, price_year, price_usd an ounce)
    has the year. Null, NaN and negative numbers state nothing; null and empty
    quotes state nothing; repeated rows keep their quantities. Columns: key,
    commodity, value, unit, origin (field, quote, dollars), g_per_t.
    """
    base = rows.select(
        F.col(key).alias("_key"),
        *[F.col(f).cast("double").alias(f"_f_{f}") for f in fields],
        F.col(usd).cast("double").alias("_usd"),
        F.col(main).alias("_main"),
        F.col(year).cast("int").alias("_year"),
        extract_quantities(F.col(quote)).alias("_q"),
    )
    masses = F.filter("_q", lambda q: ~q["unit"].startswith("usd") & q["element"].isNotNull())
    dollars = F.filter("_q", lambda q: q["unit"].startswith("usd") & F.coalesce(q["element"] == gold, F.lit(True)))
    base = base.select("*", masses.alias("_m"), dollars.alias("_d")).drop("_q")

    def of_field(f: str, element: str, unit: str) -> Column:
        v = F.col(f"_f_{f}")
        hit = F.filter("_m", lambda q: (q["element"] == element) & (_same(q["low"], v) | _same(q["high"], v)))
        first = F.try_element_at(hit, F.lit(1))
        return F.when(_stated(v), _entry(element, F.coalesce(first["low"], v), F.coalesce(first["unit"], F.lit(unit)), "field"))

    of_fields = F.array_compact(F.array(*[of_field(f, e, u) for f, (e, u) in fields.items()]))
    base = base.withColumn("_s", of_fields)
    of_quote = F.transform(
        F.filter("_m", lambda q: ~F.exists("_s", lambda s: s["commodity"] == q["element"])),
        lambda q: _entry(q["element"], q["low"], q["unit"], "quote"),
    )
    base = base.withColumn("_s", F.concat("_s", of_quote))
    v = F.col("_usd")
    as_quoted = F.try_element_at(F.filter("_d", lambda q: _same(q["low"], v) | _same(q["high"], v)), F.lit(1))
    money = F.when(
        _stated(v), F.array(_entry(gold, F.coalesce(as_quoted["low"], v), F.coalesce(as_quoted["unit"], F.lit("usd/short")), "dollars"))
    ).otherwise(F.transform("_d", lambda q: _entry(gold, q["low"], q["unit"], "dollars")))
    no_gold = ~F.exists("_s", lambda s: s["commodity"] == gold)
    base = base.withColumn("_s", F.when((F.col("_main") == gold) & no_gold, F.concat("_s", money)).otherwise(F.col("_s")))

    flat = base.select("_key", "_year", F.inline("_s"))
    price = prices.where(F.col("commodity") == gold).groupBy(F.col("price_year").alias("_year")).agg(F.max("price_usd").alias("_price"))
    flat = flat.join(F.broadcast(price), "_year", "left")  # one row a year
    paid = F.col("origin") == "dollars"
    flat = flat.select(
        "_key",
        "commodity",
        F.when(paid, F.col("value") / F.when(F.col("_price") > 0, F.col("_price"))).otherwise(F.col("value")).alias("value"),
        F.when(paid, F.concat(F.lit("oz/"), F.substring("unit", 5, 9))).otherwise(F.col("unit")).alias("unit"),
        "origin",
    )
    out = flat.join(factors(rows), "unit").withColumn("g_per_t", F.col("value") * F.col("g_per_t"))
    return out.where(F.col("g_per_t").isNotNull()).select(F.col("_key").alias(key), "commodity", "value", "unit", "origin", "g_per_t")


def evidence_quantities(reviewed: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Every quantity of nested evidence records in grams per metric tonne.

    A measurement takes the unit that the quote states with the same number for its
    commodity, else its own; one without a value takes the quote's quantity. What
    the quote states of commodities without a measurement counts too. Null or empty
    lists, values below zero and fields that name no unit state nothing. Columns:
    evidence_id, commodity, value, unit, origin, g_per_t.
    """
    ev = reviewed.select(F.explode(evidence).alias("_e"))
    ev = ev.select(F.col("_e.evidence_id").alias("evidence_id"), F.coalesce("_e.measurements", F.array()).alias("_ms"), extract_quantities(F.col("_e.verbatim_quote")).alias("_q"))
    ev = ev.withColumn("_q", F.filter("_q", lambda q: ~q["unit"].startswith("usd") & q["element"].isNotNull()))
    only = F.transform(
        F.filter("_q", lambda q: ~F.exists("_ms", lambda m: m["commodity"] == q["element"])),
        lambda q: F.struct(q["element"].alias("commodity"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit")),
    )
    flat = ev.select("evidence_id", "_q", F.explode(F.concat("_ms", only)).alias("_m")).where("_m is not null")
    v = F.col("_m.value")
    here = F.filter("_q", lambda q: q["element"] == F.col("_m.commodity"))
    same = F.try_element_at(F.filter(here, lambda q: _same(q["low"], v) | _same(q["high"], v)), F.lit(1))
    first = F.try_element_at(here, F.lit(1))
    absent = v.isNull() | F.isnan(v)
    flat = flat.select(
        "evidence_id",
        F.col("_m.commodity").alias("commodity"),
        F.when(absent, first["low"]).otherwise(F.coalesce(same["low"], v)).alias("value"),
        F.when(absent, first["unit"]).otherwise(same["unit"]).alias("_stated"),
        F.col("_m.unit").alias("_field"),
        F.when(absent, F.lit("quote")).otherwise(F.lit("field")).alias("origin"),
    ).where(F.col("value") >= 0)
    flat = flat.withColumn("unit", F.coalesce("_stated", unit_id(F.col("_field"))))
    out = flat.join(factors(reviewed), "unit").withColumn("g_per_t", F.col("value") * F.col("g_per_t"))
    return out.select("evidence_id", "commodity", "value", "unit", "origin", "g_per_t")
