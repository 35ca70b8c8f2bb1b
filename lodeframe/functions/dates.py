"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of typed dates, tried in order.
FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "yyyyMMdd"]


def parse_date(c: Column) -> Column:
    """Date of a text in the first format that fits, else of an ISO date within it; null if none."""
    tries = [F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in FORMATS]
    inner = F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(*tries, inner)


def epoch_date(c: Column) -> Column:
    """UTC date of milliseconds since 1970; null outside years 1 to 9999."""
    ok = c.between(-62_135_596_800_000, 253_402_300_799_999)
    return F.when(ok, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86_400_000).cast("int")))


def last_year(c: Column) -> Column:
    """The last year (1500 to 2099) that a text names."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?<!\d)((?:1[5-9]|20)\d{2})(?!\d)"), F.lit(1)), F.lit(-1)).cast("int")


def within_days(c: Column, today: Column, before: int, after: int) -> Column:
    """Whether a date lies from ``before`` days ago to ``after`` days ahead."""
    return F.coalesce(F.datediff(c, today).between(-before, after), F.lit(False))
