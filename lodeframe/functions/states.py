"""Names and codes of states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Postal codes of the states by full name.
STATES = dict(
    x.split(":")
    for x in (
        "alabama:AL alaska:AK arizona:AZ arkansas:AR california:CA colorado:CO connecticut:CT delaware:DE florida:FL georgia:GA hawaii:HI idaho:ID "
        "illinois:IL indiana:IN iowa:IA kansas:KS kentucky:KY louisiana:LA maine:ME maryland:MD massachusetts:MA michigan:MI minnesota:MN mississippi:MS "
        "missouri:MO montana:MT nebraska:NE nevada:NV new_hampshire:NH new_jersey:NJ new_mexico:NM new_york:NY north_carolina:NC north_dakota:ND ohio:OH "
        "oklahoma:OK oregon:OR pennsylvania:PA rhode_island:RI south_carolina:SC south_dakota:SD tennessee:TN texas:TX utah:UT vermont:VT virginia:VA "
        "washington:WA west_virginia:WV wisconsin:WI wyoming:WY"
    ).split()
)


def state_code(c: Column) -> Column:
    """Postal code of a state given by its full name; null if it is none."""
    codes = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.element_at(codes, F.regexp_replace(F.lower(F.trim(c)), " ", "_"))
