"""Placing and matching by name, request contracts, layer projections, sources' scales and proofs of inventories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.states import STATES, state_code
from ..operators import contracts as C
from ..operators import linking as L
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_OK = "({y} IS NOT NULL AND {x} IS NOT NULL AND NOT isnan({y}) AND NOT isnan({x}) AND abs({y}) <= 90 AND abs({x}) <= 180)"
_CODES = "(VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in STATES.items()) + ") code(full_name, code)"
_CANON = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s*\([^)]*\)', '', 'g'), '\b(" + "|".join(L.STOP) + r"|no\.?\s*\d+|#\s*\d+|\d+)\b', ' ', 'g'), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')), '')"
_PLACE = "nullif(lower(trim({c})), '')"


def _canon(c: str) -> str:
    return _CANON.format(c=c)


def _place(c: str) -> str:
    return _PLACE.format(c=c)


def _sites(spark, d):
    return table(spark, d, "mrds_sites").select("dep_id", state_code(F.col("state")).alias("state"), "county", F.col("site_name").alias("name"), "longitude", "latitude")


_SITES = f"(SELECT dep_id, code AS state, {_place('county')} AS county, {_canon('site_name')} AS k, longitude AS sx, latitude AS sy FROM mrds_sites LEFT JOIN {_CODES} ON full_name = replace(lower(trim(state)), ' ', '_'))"


@query(
    "j16_located_by_name",
    rf"""WITH s AS (SELECT * FROM {_SITES} WHERE k IS NOT NULL AND {_OK.format(x='sx', y='sy')}),
             r AS (SELECT row_id AS row, state, {_place('county')} AS county, {_canon('name')} AS k, {_canon(r"regexp_replace(district, '\(.*$', '')")} AS dk, keys, list_filter(coalesce(excl, []), lambda e: e <> '') AS bars,
                          CASE WHEN {_OK.format(x='lon', y='lat')} THEN lon END AS x, CASE WHEN {_OK.format(x='lon', y='lat')} THEN lat END AS y FROM rows_igs_b11),
             o AS (SELECT * FROM r WHERE x IS NULL),
             c1 AS (SELECT o.row, arg_min(sx, dep_id) AS x, arg_min(sy, dep_id) AS y, min(dep_id) AS dep FROM o JOIN s ON s.state = o.state AND s.k = o.k AND (o.county IS NULL OR s.county IS NULL OR s.county = o.county)
                    GROUP BY 1 HAVING max(sx) - min(sx) < 0.05 AND max(sy) - min(sy) < 0.05),
             f AS (SELECT row, state, county, bars, pos, {_canon('keys[pos]')} AS key FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS pos FROM o)),
             c2 AS (SELECT f.row, f.pos, arg_min(sx, dep_id) AS x, arg_min(sy, dep_id) AS y, min(dep_id) AS dep FROM f JOIN s ON s.state = f.state AND contains(' ' || s.k || ' ', ' ' || f.key || ' ') AND (f.county IS NULL OR s.county IS NULL OR s.county = f.county)
                     WHERE NOT list_bool_or(list_transform(f.bars, lambda e: contains(s.k, lower(e)))) IS TRUE GROUP BY 1, 2 HAVING max(sx) - min(sx) < 0.05 AND max(sy) - min(sy) < 0.05),
             t2 AS (SELECT row, arg_min(x, pos) AS x, arg_min(y, pos) AS y, arg_min(dep, pos) AS dep FROM c2 GROUP BY 1),
             a AS (SELECT state, {_place('county')} AS county, {_canon(r"regexp_replace(name, '\(.*$', '')")} AS dk, lon AS ax, lat AS ay FROM districts WHERE {_OK.format(x='lon', y='lat')}),
             h AS (SELECT o.row, ax, ay, row_number() OVER (PARTITION BY o.row ORDER BY ax) AS ix, row_number() OVER (PARTITION BY o.row ORDER BY ay) AS iy, count(*) OVER (PARTITION BY o.row) AS n
                   FROM o JOIN a ON a.state = o.state AND a.dk = o.dk AND (o.county IS NULL OR a.county IS NULL OR a.county = o.county)),
             t3 AS (SELECT row, max(ax) FILTER (ix = n // 2 + 1) AS x, max(ay) FILTER (iy = n // 2 + 1) AS y FROM h WHERE n >= 2 GROUP BY 1)
        SELECT r.row, coalesce(r.x, c1.x, t2.x, t3.x) AS x, coalesce(r.y, c1.y, t2.y, t3.y) AS y, CASE WHEN r.x IS NULL THEN CASE WHEN c1.row IS NOT NULL THEN c1.dep ELSE t2.dep END END AS dep,
               CASE WHEN r.x IS NOT NULL THEN 0 WHEN c1.row IS NOT NULL THEN 1 WHEN t2.row IS NOT NULL THEN 2 WHEN t3.row IS NOT NULL THEN 3 END AS stage
        FROM r LEFT JOIN c1 USING (row) LEFT JOIN t2 USING (row) LEFT JOIN t3 USING (row)""",
)
def j16_located(spark, d):
    """Rows without a point placed by site names, further names and districts."""
    from ..functions.geo import valid_point

    ok = valid_point(F.col("lat"), F.col("lon"))
    rows = table(spark, d, "rows_igs_b11").select(F.col("row_id").alias("row"), "state", "county", "district", "name", F.col("keys").alias("further"), "excl", F.when(ok, F.col("lon")).alias("x"), F.when(ok, F.col("lat")).alias("y"))
    sites = _sites(spark, d).select(F.col("dep_id").alias("dep"), "state", "county", "name", F.col("longitude").alias("sx"), F.col("latitude").alias("sy"))
    anchors = table(spark, d, "districts").select("state", "county", F.col("name").alias("district"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    return L.locate_by_name(rows, sites, anchors)


@query(
    "j18_existing_or_alias",
    rf"""WITH e AS (SELECT * FROM {_SITES} WHERE k IS NOT NULL), n AS (SELECT row_id AS id, state, {_place('county')} AS c, {_canon('name')} AS k, keys, lon AS x, lat AS y FROM rows_igs_b11),
             m AS (SELECT id, min(dep_id) AS m FROM n JOIN e ON e.state = n.state AND e.k = n.k AND (c IS NULL OR county IS NULL OR c = county)
                   AND ((c IS NOT NULL AND county IS NOT NULL) OR coalesce(sqrt(pow((sx - x) * 111.32 * cos(radians(y)), 2) + pow((sy - y) * 111.32, 2)) <= 15, true)) GROUP BY 1),
             t AS (SELECT id, state, c, k AS own, pos, {_canon('keys[pos]')} AS key FROM (SELECT n.*, unnest(range(1, len(keys) + 1)) AS pos FROM n ANTI JOIN m USING (id))),
             a AS (SELECT id, arg_min(x, pos) AS a FROM (SELECT id, pos, min(dep_id) AS x FROM t JOIN e ON e.state = t.state AND e.k = t.key AND (c IS NULL OR county IS NULL OR c = county) WHERE key IS DISTINCT FROM own GROUP BY 1, 2) GROUP BY 1)
        SELECT id, coalesce(m, a) AS match, CASE WHEN m IS NOT NULL THEN 'name' WHEN a IS NOT NULL THEN 'alias' END AS by FROM n LEFT JOIN m USING (id) LEFT JOIN a USING (id)""",
)
def j18_existing(spark, d):
    """The site on record for each row, by name within the county or 15 km, else by a further name."""
    rows = table(spark, d, "rows_igs_b11").select(F.col("row_id").alias("id"), "state", "county", "name", F.col("keys").alias("further"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    sites = _sites(spark, d).select(F.col("dep_id").alias("eid"), "state", "county", "name", F.col("longitude").alias("ex"), F.col("latitude").alias("ey"))
    return L.match_existing(rows, sites)


@query("a08_district_merge")
def a08_merge(spark, d):
    """Districts counted from rows, near-duplicates merged by falling count (tested against a plain loop)."""
    t = table(spark, d, "rows_igs_b11").where("district is not null and trim(district) <> '' and abs(lat) <= 90 and abs(lon) <= 180")
    return L.merge_districts(t.groupBy("state", F.trim("district").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lon"), 4).alias("lon"), F.round(F.avg("lat"), 4).alias("lat")))


# --- contracts ------------------------------------------------------------------------------------

SITES = C.Contract(one_of={"states": "state"}, equal={"status": "dev_stat"}, contains={"commodity_term": "commod1", "name_contains": "site_name"}, point=("longitude", "latitude"), order=("dep_id",))
CLAIMS = C.Contract(one_of={"states": "state"}, equal={"system": "lang"}, contains={"name_contains": "text"}, flag={"filed_only": "doc_type = 'card'"}, order=("doc_id",), default_limit=10)
GRADES = C.Contract(one_of={"states": "state"}, equal={"metal": "metal"}, at_least={"min_opt": "au_opt"}, flag={"placed_only": "lat is not null"}, point=("lon", "lat"), order=("-au_opt", "row_id"), default_limit=20)
SECTIONS = C.Contract(equal={"status": "status"}, at_least={"min_features": "radius_km"}, flag={"split_only": "era is not null"}, point=("lon", "lat"), order=("district_id",), default_limit=20)
_NEAR = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({y} - {la}) / 2), 2) + cos(radians({la})) * cos(radians({y})) * pow(sin(radians({x} - ({lo})) / 2), 2)))) <= {km} * 1000"


@query("f18_site_filter_contract", f"SELECT dep_id, site_name FROM mrds_sites WHERE state IN ('Idaho', 'Nevada') AND contains(lower(site_name), 'mine') AND {_OK.format(x='longitude', y='latitude')} AND {_NEAR.format(x='longitude', y='latitude', la=43.5, lo=-115.5, km=400)} ORDER BY dep_id LIMIT 12")
def f18(spark, d):
    """Sites of two states by a part of their name within a radius."""
    ask = {"states": ["Idaho", "Nevada"], "name_contains": "Mine", "near_lat": 43.5, "near_lon": -115.5, "radius_km": 400, "limit": 12, "status": None}
    return SITES.rows(table(spark, d, "mrds_sites"), ask).select("dep_id", "site_name")


@query("f19_claim_filter_contract", "SELECT doc_id FROM documents WHERE state IN ('ID', 'NV') AND doc_type = 'card' AND contains(lower(text), 'lode') ORDER BY doc_id LIMIT 10")
def f19(spark, d):
    return CLAIMS.rows(table(spark, d, "documents"), {"states": ["ID", "NV"], "filed_only": True, "name_contains": "LODE"}).select("doc_id")


@query("f20_grade_filter_contract", "SELECT row_id, au_opt FROM rows_igs_b11 WHERE metal = 'Au' AND au_opt >= 0.1 AND state = 'ID' AND lat IS NOT NULL ORDER BY au_opt DESC, row_id LIMIT 20")
def f20(spark, d):
    """The richest rows of a state first; no more than the contract's limit, whatever is asked."""
    return GRADES.rows(table(spark, d, "rows_igs_b11"), {"states": ["ID"], "metal": "Au", "min_opt": 0.1, "placed_only": True, "limit": 5000}).select("row_id", "au_opt")


@query("f21_section_filter_contract", "SELECT count(*) AS n FROM districts WHERE status = 'active' AND radius_km >= 5 AND era IS NOT NULL")
def f21(spark, d):
    return SECTIONS.count(table(spark, d, "districts"), {"status": "active", "min_features": 5, "split_only": True})


# --- layers ---------------------------------------------------------------------------------------

_X = {"lon": C.Field("{x}", "double", True, low=-180, high=180), "lat": C.Field("{y}", "double", True, low=-90, high=90)}


def _point(x: str, y: str) -> dict[str, C.Field]:
    return {k: C.Field(f.expr.format(x=x, y=y), f.kind, f.required, low=f.low, high=f.high) for k, f in _X.items()}


LAYERS = {
    "sites": C.Layer({"fid": C.Field("dep_id", "string", True), "st": C.Field("state", required=True, limit=20), "nm": C.Field("site_name", limit=160), **_point("longitude", "latitude")}, "state <> 'Hawaii'", {"source": "sites", "catalog": "present"}),
    "rows": C.Layer({"fid": C.Field("row_id", "string", True), "st": C.Field("state", required=True, limit=2), "nm": C.Field("name", limit=160), **_point("lon", "lat"), "grade": C.Field("au_opt", "double", low=0)}, "true", {"source": "rows", "catalog": "absent"}),
    "districts": C.Layer({"fid": C.Field("district_id", "string", True), "st": C.Field("state", required=True, limit=2), "nm": C.Field("name", required=True, limit=160), **_point("lon", "lat")}, "status is not null", {"source": "districts", "catalog": "present"}),
}


def _layer_sql(source: str, fid: str, st: str, nm: str, x: str, y: str, most: int, where: str, catalog: str, grade: str = "CAST(NULL AS DOUBLE)", more: str = "true") -> str:
    return (
        f"SELECT CAST({fid} AS VARCHAR) AS fid, nullif(trim({st}), '') AS st, nullif(trim({nm}), '') AS nm, {x} AS lon, {y} AS lat, {grade} AS grade, '{source.split('_')[0]}' AS source, '{catalog}' AS catalog FROM {source.split('@')[1]} "
        f"WHERE {where} AND nullif(trim({st}), '') IS NOT NULL AND length(trim({st})) <= {most} AND coalesce(length(trim({nm})), 0) <= 160 AND {_OK.format(x=x, y=y)} AND {more}"
    ).replace(f"'{source.split('_')[0]}' AS source", f"'{source.split('@')[0]}' AS source")


_LAYER_SQL = " UNION ALL ".join(
    [
        _layer_sql("sites@mrds_sites", "dep_id", "state", "site_name", "longitude", "latitude", 20, "state <> 'Hawaii'", "present"),
        _layer_sql("rows@rows_igs_b11", "row_id", "state", "name", "lon", "lat", 2, "true", "absent", "au_opt", "coalesce(au_opt >= 0 AND NOT isnan(au_opt) AND NOT isinf(au_opt), true)"),
        _layer_sql("districts@districts", "district_id", "state", "name", "lon", "lat", 2, "status IS NOT NULL", "present", more="nullif(trim(name), '') IS NOT NULL"),
    ]
)


def _parts(spark, d):
    return [(table(spark, d, n), LAYERS[k]) for k, n in (("sites", "mrds_sites"), ("rows", "rows_igs_b11"), ("districts", "districts"))]


@query("f26_layers_with_provenance", _LAYER_SQL)
def f26(spark, d):
    """Three layers in one form, each row with its source; a grade only where the layer has one."""
    return C.union_layers(_parts(spark, d)).select("fid", "st", "nm", "lon", "lat", "grade", "source", "catalog")


@query("f27_status_rule", "SELECT o_orderkey AS serial, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE coalesce(nullif(trim(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END), ''), 'ACTIVE') END AS status FROM orders")
def f27(spark, d):
    """Closed ones are closed, others go by their disposition, else they are active."""
    layer = C.Layer({"serial": C.Field("o_orderkey", "bigint", True), "status": C.Field("CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE coalesce(nullif(trim(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END), ''), 'ACTIVE') END", required=True, limit=40)})
    return layer.project(table(spark, d, "orders"))


@query("f28_survey_rows", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS nm, p_size AS g, p_type AS typ FROM part WHERE p_size BETWEEN 0 AND 25 AND length(trim(p_type)) <= 20")
def f28(spark, d):
    """Survey rows whose group and type keep their bounds."""
    layer = C.Layer({"id": C.Field("p_partkey", required=True), "nm": C.Field("p_name", required=True), "g": C.Field("p_size", "int", True, low=0, high=25), "typ": C.Field("p_type", limit=20)})
    return layer.project(table(spark, d, "part"))


@query(
    "f33_rejected_rows",
    f"""SELECT CAST(row_id AS VARCHAR) AS fid, list_filter(['lon', 'lat', 'grade'], lambda f: CASE f WHEN 'lon' THEN lon IS NULL OR isnan(lon) OR abs(lon) > 180 WHEN 'lat' THEN lat IS NULL OR isnan(lat) OR abs(lat) > 90 ELSE coalesce(au_opt < 0, false) END) AS faults
        FROM rows_igs_b11 WHERE NOT {_OK.format(x='lon', y='lat')} OR coalesce(au_opt < 0, false)""",
)
def f33(spark, d):
    """What a layer refuses, with the fields at fault."""
    return LAYERS["rows"].rejected(table(spark, d, "rows_igs_b11")).select("fid", "faults")


# --- scales and texts -----------------------------------------------------------------------------

_KIND = "CASE p_size % 5 WHEN 0 THEN 'Raster scan' WHEN 1 THEN 'GIS vector' WHEN 2 THEN 'scanned, vector polygons' WHEN 3 THEN p_type ELSE 'GeoPDF ' || p_brand END"


@query("f07_raster_only", rf"SELECT p_partkey, regexp_matches(lower({_KIND}), '\braster\b|\bscan(?:ned)?\b|geotiff|geopdf|\bcog\b|xyz') AND NOT regexp_matches(lower({_KIND}), '\bvector\b|\bgis\b|geodatabase|\bgdb\b|\bgpkg\b|\bgems\b|polygon') AS raster FROM part")
def f07(spark, d):
    return table(spark, d, "part").select("p_partkey", T.raster_only(F.expr(_KIND)).alias("raster"))


@query(
    "f08_native_scale",
    r"""WITH s AS (SELECT p_partkey, p_size % 3 = 0 AS raster, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS scoring, CASE WHEN p_size % 7 = 0 THEN p_size * 1000 END AS native, CASE WHEN p_size % 5 = 0 THEN p_size * 1000 END AS stated,
                          CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000 END AS noted, p_partkey % 6 = 0 AS ranged FROM part)
        SELECT p_partkey, NOT raster AND coalesce(scoring, true) AND CASE WHEN coalesce(scoring, false) AND native IS NOT NULL THEN native <= 24000 ELSE coalesce(coalesce(stated, native, CASE WHEN NOT ranged THEN noted END) <= 24000, false) END AS native FROM s""",
)
def f08(spark, d):
    """Native scales of sources stated as numbers, as texts with thousands marks, in notes and as ranges."""
    size, key = F.col("p_size"), F.col("p_partkey")
    scoring = F.when(size % 4 == 0, True).when(size % 4 == 1, False)
    native = F.when(size % 7 == 0, F.concat(size.cast("string"), F.lit("k")))
    stated = F.when(size % 5 == 0, F.concat(F.lit("1:"), F.format_number(size * 1000, 0)))
    note = F.when(key % 2 == 0, F.concat(F.lit("drawn at 1 : "), F.format_number(size * 1000, 0), F.when(key % 6 == 0, F.lit(" to 1:250,000")).otherwise(F.lit(" in the field"))))
    return table(spark, d, "part").select("p_partkey", T.native_scale(F.when(size % 3 == 0, F.lit("raster")).otherwise(F.lit("vector")), scoring, native, stated, F.lit("scale unknown"), note).alias("native"))


@query("t20_trailing_scale", r"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey AS BIGINT) * 137 END AS scale FROM customer")
def t20(spark, d):
    key = F.col("c_custkey")
    s = F.when(key % 3 == 0, F.concat(F.lit("1:24,000 by "), "c_name", F.lit("."))).otherwise(F.concat(F.lit("Map of 1908, 1:"), F.format_number(key.cast("bigint") * 137, 0), F.lit("  ")))
    return table(spark, d, "customer").select("c_custkey", T.trailing_scale(s).alias("scale"))


@query("t26_sentence_after_heading", r"SELECT doc_id, nullif(regexp_replace(trim(regexp_extract(substr(text, length(h) + 1), '^\s*([^.?!]*[.?!])', 1)), '\s+', ' ', 'g'), '') AS s FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS h FROM documents WHERE contains(text, chr(10)) AND length(trim(split_part(text, chr(10), 1))) > 0 AND lang = 'en')")
def t26(spark, d):
    """The first sentence below the first line."""
    h = F.split_part("text", F.lit("\n"), F.lit(1))
    t = table(spark, d, "documents").where(F.col("text").contains("\n") & (F.length(F.trim(h)) > 0) & (F.col("lang") == "en"))
    return t.select("doc_id", T.sentence_after(F.col("text"), h).alias("s"))


# --- proofs ---------------------------------------------------------------------------------------


@query(
    "v06_attested_pages",
    """WITH p AS (SELECT o_custkey AS part, min(o_orderkey) AS a, max(o_orderkey) AS b, count(*) AS n, o_orderpriority AS pr FROM orders GROUP BY o_custkey, o_orderpriority), t AS (SELECT *, (SELECT count(*) FROM orders o WHERE o.o_custkey = p.part) + (p.part % 50 = 0)::INT AS total FROM p),
            w AS (SELECT *, lag(b) OVER (PARTITION BY part ORDER BY a, b) AS before FROM t)
       SELECT part, bool_and(before IS NULL OR before < a) AND sum(n) = max(total) AS attested FROM w GROUP BY 1""",
)
def v06(spark, d):
    """Pages of each customer's orders: whole where they follow one another and come to the total."""
    o = table(spark, d, "orders")
    p = o.groupBy(F.col("o_custkey").alias("part"), "o_orderpriority").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count(F.lit(1)).alias("n"))
    total = o.groupBy(F.col("o_custkey").alias("part")).agg(F.count(F.lit(1)).alias("total"))
    p = p.join(total, "part").withColumn("total", F.col("total") + (F.col("part") % 50 == 0).cast("int"))
    return C.pages_attested(p, "part", "a", "b", "n", "total")


@query(
    "v14_zero_inventory_proof",
    "SELECT n_nationkey AS part, n_nationkey % 4 <> 1 AS proven FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)",
)
def v14(spark, d):
    """Nations declared without rich customers, proven so where their own declaration is complete."""
    c = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("part"))
    n = c.groupBy("part").agg(F.count(F.lit(1)).alias("declared"))
    m = table(spark, d, "nation").select(F.col("n_nationkey").alias("part")).join(n, "part", "left").withColumns({"declared": F.coalesce("declared", F.lit(0)), "whole": F.col("part") % 4 != 1})
    return C.zero_proof(m, c, "part", "declared", "whole")


@query(
    "v21_partial_reasons",
    """SELECT o_orderkey, list_filter([CASE WHEN o_custkey % 3 = 0 THEN 'attestation absent or incomplete' END, CASE WHEN o_orderstatus = 'P' THEN 'truncated' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'partial' END, CASE WHEN o_totalprice > 300000 THEN 'declared exceeds emitted rows' END], lambda x: x IS NOT NULL) AS reasons FROM orders""",
)
def v21(spark, d):
    o = table(spark, d, "orders").withColumns({"truncated": F.when(F.col("o_orderstatus") == "P", True), "partial": F.col("o_orderpriority").startswith("5")})
    return o.select("o_orderkey", C.partial_reasons(["truncated", "partial"], F.col("o_totalprice"), F.lit(300_000), F.when(F.col("o_custkey") % 3 != 0, True)).alias("reasons"))
