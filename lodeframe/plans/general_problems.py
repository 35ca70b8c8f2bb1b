"""Queries of the general data problems: units (p2) and regions (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regions, units

# Least contents that p2_found reports, in grams per metric tonne.
RICH = {"Au": 15.0, "Ag": 300.0, "Cu": 20_000.0, "Pb": 50_000.0, "Zn": 50_000.0}
GOLD_FIELDS = {"au_opt": ("Au", "oz/short"), "au_gpt": ("Au", "g/metric")}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity of both sources in grams per metric tonne."""
    rows = units.row_quantities(
        _read(spark, d, "rows_igs_b11"), _read(spark, d, "metal_prices"), "row_id", GOLD_FIELDS, "quote", "usd_per_ton", "metal", "price_year"
    )
    ev = units.evidence_quantities(_read(spark, d, "reviewed_grade_evidence"))
    cols = ["record_id", "commodity", "origin", "unit", F.round("g_per_t", 6).alias("g_per_t")]
    return (
        rows.withColumn("record_id", F.col("row_id").cast("string")).select(*cols)
        .unionByName(ev.withColumnRenamed("evidence_id", "record_id").select(*cols))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rich quantities; of rows_igs_b11 only the gold content."""
    q = p2_quantities(spark, d)
    from_row = F.col("record_id").rlike("^[0-9]+$")
    least = F.element_at(F.create_map(*[F.lit(x) for kv in RICH.items() for x in kv]), F.col("commodity"))
    return q.where((~from_row | (F.col("commodity") == "Au")) & (F.col("g_per_t") >= least)).select("record_id", "commodity").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the districts whose circle contains their point."""
    return regions.points_in_circles(
        _read(spark, d, "rows_igs_b11"), "row_id", "lat", "lon", _read(spark, d, "districts"), "district_id", "lat", "lon", F.col("radius_km") * 1000
    )


def p5_near_locations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct locations of rows_igs_b11 within 250 m of each other."""
    return regions.locations_within(_read(spark, d, "rows_igs_b11"), "lat", "lon", 250.0).select("lat", "lon", "n", "lat2", "lon2", "n2")


QUERIES = {"p2_found": p2_found, "p2_quantities": p2_quantities, "p5_found": p5_found, "p5_near_locations": p5_near_locations}

_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"

ORACLE = {
    "p5_found": f"""
        SELECT r.row_id, d.district_id FROM rows_igs_b11 r JOIN districts d
          ON {_HAV.format(a='r.', b='d.')} <= d.radius_km * 1000
        WHERE r.lat IS NOT NULL AND r.lon IS NOT NULL AND NOT isnan(r.lat) AND NOT isnan(r.lon)
          AND abs(r.lat) <= 90 AND abs(r.lon) <= 180 AND d.lat IS NOT NULL AND d.lon IS NOT NULL""",
    "p5_near_locations": f"""
        WITH s AS (SELECT lat, lon, count(*) AS n FROM rows_igs_b11
                   WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)
                     AND abs(lat) <= 90 AND abs(lon) <= 180 GROUP BY 1, 2)
        SELECT a.lat, a.lon, a.n, b.lat AS lat2, b.lon AS lon2, b.n AS n2 FROM s a JOIN s b
          ON (a.lat < b.lat OR (a.lat = b.lat AND a.lon < b.lon)) AND abs(a.lat - b.lat) < 0.01
        WHERE {_HAV.format(a='a.', b='b.')} <= 250.0""",
}
