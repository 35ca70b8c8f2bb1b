"""Record linking, page matching, polygon assembly and reconciliation jobs, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from ..functions import polygons as P
from ..functions import shapes as S
from ..functions import text as T
from ..functions.units import conversion_rows, extract_quantities
from ..operators import matching as M
from ..operators import regions
from ..operators import relational as R
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_D = "districts WHERE lat IS NOT NULL AND lon IS NOT NULL"


@query(
    "j15_blocked_scored_match",
    """WITH a AS (SELECT mine_id, state, county, lower(split_part(name, ' ', 1)) AS w, district FROM reviewed_grade_evidence), b AS (SELECT row_id, state AS rs, county AS rc, lower(split_part(name, ' ', 1)) AS rw, district AS rd FROM rows_igs_b11),
            p AS (SELECT mine_id, row_id, (state = rs AND w = rw AND coalesce(county = rc, false)) AS same_county, coalesce(district = rd, false) AS same_district,
                         (coalesce(state || '|' || county || '|' || w = rs || '|' || rc || '|' || rw, false))::INT + 2 * (coalesce(state || '|' || district || '|' || w = rs || '|' || rd || '|' || rw, false))::INT AS msk FROM a JOIN b ON state = rs AND w = rw),
            s AS (SELECT mine_id, row_id, round(CAST((msk % 2) * 0.6 + (msk // 2) * 0.5 AS DOUBLE), 3) AS score FROM p WHERE msk > 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY mine_id ORDER BY score DESC, row_id) AS rank FROM s WHERE score >= 0.5)
       SELECT mine_id, row_id, score, rank FROM r WHERE rank <= 3""",
)
def j15(spark, d):
    """Candidates by county or district and first word, scored, the best three."""
    w = F.lower(F.substring_index("name", " ", 1))
    a = table(spark, d, "reviewed_grade_evidence").select("mine_id", F.concat_ws("|", "state", "county", w).alias("k1"), F.concat("state", F.lit("|"), "district", F.lit("|"), w).alias("k2"))
    b = table(spark, d, "rows_igs_b11").select("row_id", F.concat("state", F.lit("|"), "county", F.lit("|"), w).alias("r1"), F.concat("state", F.lit("|"), "district", F.lit("|"), w).alias("r2"))
    blocks = [(F.array("k1"), F.array("r1")), (F.array("k2"), F.array("r2"))]
    return M.scored_matches(a, b, "mine_id", "row_id", blocks, lambda by: F.round(by.bitwiseAND(1) * 0.6 + F.shiftright(by, 1) * 0.5, 3), 0.5)


@query(
    "j17_scored_near_anchor",
    f"""WITH p AS (SELECT x.district_id, s.dep_id, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(s.latitude - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - x.lon) / 2), 2)))) / 1000
                    - CASE WHEN lower(s.commod1) = 'gold' THEN 5 ELSE 0 END AS cost, s.latitude AS sl FROM (SELECT * FROM {_D}) x JOIN mrds_sites s ON abs(s.latitude - x.lat) < 0.3 AND abs(s.latitude) <= 90 AND abs(s.longitude) <= 180),
             q AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY cost, dep_id) AS r FROM p WHERE cost + CASE WHEN dep_id IN (SELECT dep_id FROM mrds_sites WHERE lower(commod1) = 'gold') THEN 5 ELSE 0 END <= 20)
        SELECT district_id, dep_id FROM q WHERE r = 1""",
)
def j17(spark, d):
    """The cheapest site in reach of an anchor, distance less a bonus."""
    from ..operators.spatial import within_distance

    x, s = table(spark, d, "districts").select("district_id", "lat", "lon"), table(spark, d, "mrds_sites").select("dep_id", "longitude", "latitude", "commod1")
    near = within_distance(x, s, ("lon", "lat"), ("longitude", "latitude"), 20_000.0)
    cost = F.col("metres") / 1000 - F.when(F.lower("commod1") == "gold", 5).otherwise(0)
    return near.groupBy("district_id").agg(F.min_by("dep_id", F.struct(cost, F.col("dep_id"))).alias("dep_id"))


@query(
    "j27_foreign_key_containment",
    f"""WITH p AS (SELECT state, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM {_D} AND era IS NOT NULL GROUP BY 1)
        SELECT district_id, p.state IS NOT NULL AS known, coalesce(lon - radius_km / 200 >= x0 AND lon + radius_km / 200 <= x1 AND lat - radius_km / 200 >= y0 AND lat + radius_km / 200 <= y1, false) AS held FROM (SELECT * FROM {_D}) d LEFT JOIN p USING (state)""",
)
def j27(spark, d):
    """Each district with its state's polygon by key, and the proof that the polygon holds the district's own."""
    t = table(spark, d, "districts").where("lat is not null and lon is not null")
    box = t.where("era is not null").groupBy("state").agg(*[f(c).alias(n) for f, c, n in ((F.min, "lon", "x0"), (F.min, "lat", "y0"), (F.max, "lon", "x1"), (F.max, "lat", "y1"))])
    parents = box.select("state", S.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("outer"))
    r = F.col("radius_km") / 200
    child = S.box(F.col("lon") - r, F.col("lat") - r, F.col("lon") + r, F.col("lat") + r)
    j = t.select("district_id", "state", child.alias("inner")).join(parents, "state", "left")
    return j.select("district_id", F.col("outer").isNotNull().alias("known"), F.coalesce(P.ring_covers(F.col("outer"), F.col("inner"), 0.0), F.lit(False)).alias("held"))


@query("j31_mandatory_lookups", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def j31(spark, d):
    """Several lookups that every row must have."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    return li.join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("w02_second_rank", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC, row_number) AS second FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS row_number FROM nation)")
def w02(spark, d):
    """A second ranking whose ties follow the first."""
    w = Window.partitionBy("n_regionkey")
    t = table(spark, d, "nation").withColumn("first", F.row_number().over(w.orderBy("n_name")))
    return t.select("n_nationkey", F.row_number().over(w.orderBy(F.length("n_name").desc(), "first")).alias("second"))


@query("w08_score_rank_with_ties", "SELECT state, row_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY least(au_opt, 5) DESC, row_id) AS r FROM rows_igs_b11 WHERE au_opt IS NOT NULL) WHERE r <= 5")
def w08(spark, d):
    t = table(spark, d, "rows_igs_b11").where("au_opt is not null").select("state", "row_id", F.least("au_opt", F.lit(5.0)).alias("s"))
    return R.top_per_group(t, ["state"], 5, F.col("s").desc(), F.col("row_id")).drop("s")


@query("w10_rank_then_rerank", "SELECT src_key, trust_rank, row_number() OVER (ORDER BY pub_year DESC, trust_rank) AS rank FROM source_list WHERE pub_year > 1880")
def w10(spark, d):
    t = table(spark, d, "source_list")
    return R.dense_rank_where(t, F.col("pub_year") > 1880, F.col("pub_year").desc(), F.col("trust_rank")).where("rank is not null").select("src_key", "trust_rank", "rank")


@query("w13_page_window_match")
def w13(spark, d):
    """The page within two of the cited one where a passage stands best; the queries are every twentieth row, against all pages.

    A row without a pdf_page is sought around its printed page and the source's offset.
    """
    r = table(spark, d, "rows_igs_b11")
    at = M.printed_to_pdf(r.select("row_id", "src_key", "page", "pdf_page", "quote"), "src_key", "page", "pdf_page")
    quotes = at.where("row_id % 20 = 0").select(F.col("row_id").alias("id"), "src_key", "cited", "quote")
    pages = r.where("pdf_page is not null").groupBy("src_key", "pdf_page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row_id", "quote"))).getField("quote"), "\n").alias("text"))
    return M.page_window_match(quotes, pages, "src_key", "cited", 2, lambda: F.when(F.contains("text", "quote"), 1.0).otherwise(T.quote_score(F.col("quote"), F.col("text"))), every=True)


@query(
    "w14_sorted_neighbours",
    f"""WITH p AS (SELECT a.district_id AS g, b.district_id AS o, round(b.radius_km, 1) AS w, round(abs(a.lat - b.lat) + abs(a.lon - b.lon), 4) AS off FROM (SELECT * FROM {_D}) a JOIN (SELECT * FROM {_D}) b ON a.state = b.state AND a.district_id <> b.district_id AND abs(a.lat - b.lat) + abs(a.lon - b.lon) <= 0.5),
            r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, off, o) AS r FROM p) SELECT g, string_agg(o, ',' ORDER BY r) AS near FROM r WHERE r <= 5 GROUP BY 1""",
)
def w14(spark, d):
    """The five weightiest neighbours of each district, by weight and then by distance."""
    t = table(spark, d, "districts").where("lat is not null and lon is not null").select("district_id", "state", "lat", "lon", "radius_km")
    other = t.select(F.col("district_id").alias("o"), "state", F.col("lat").alias("y"), F.col("lon").alias("x"), F.round("radius_km", 1).alias("w"))
    off = F.abs(F.col("lat") - F.col("y")) + F.abs(F.col("lon") - F.col("x"))
    near = t.select(F.col("district_id").alias("g"), "state", "lat", "lon").join(other, "state").where((F.col("g") != F.col("o")) & (off <= 0.5)).withColumn("off", F.round(off, 4))
    best = R.top_per_group(near, ["g"], 5, F.col("w").desc(), F.col("off"), F.col("o"))
    return best.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "o"))), lambda x: x["o"].cast("string")), ",").alias("near"))


@query("t21_quantity_rows")
def t21(spark, d):
    """Every quantity that a quotation states, one row each (tested against fixed passages)."""
    t = table(spark, d, "rows_igs_b11").select("row_id", F.posexplode(extract_quantities(F.col("quote"))).alias("pos", "q"))
    return t.select("row_id", "pos", "q.element", "q.low", "q.high", "q.unit")


@query("t33_factor_table", "SELECT unit, CAST(g AS DOUBLE) AS g_per_t FROM (VALUES ('oz/short', 34.2857), ('oz/long', 30.6122), ('g/metric', 1.0), ('pct', 10000.0), ('ppb', 0.001)) v(unit, g)")
def t33(spark, d):
    t = spark.createDataFrame(conversion_rows(), "unit string, g_per_t double")
    return t.where(F.col("unit").isin("oz/short", "oz/long", "g/metric", "pct", "ppb")).select("unit", F.round("g_per_t", 4).alias("g_per_t"))


def _square(k):
    x, y = F.col("lon"), F.col("lat")
    return S.ring((x - k, y - k), (x - k, y + k), (x + k, y + k), (x + k, y - k))


@query(
    "g08_representative_point",
    f"""WITH u AS (SELECT district_id, lon, lat, (district_id % 9) * 0.5 AS g FROM {_D}), c AS (SELECT *, lon + 2.5 AS cx, lat + (62.5 - 3 * g * (5 - g / 2)) / (25 - 3 * g) AS cy FROM u)
        SELECT district_id, CASE WHEN cy < lat + 5 - g THEN 'centroid' ELSE 'scan' END AS by, CASE WHEN cy < lat + 5 - g THEN round(cx, 6) END AS x, CASE WHEN cy < lat + 5 - g THEN round(cy, 6) END AS y, true AS held FROM c""",
)
def g08(spark, d):
    """The centroid where it lies inside, else a point on a scan line: U shapes whose gap is deeper from one to the next."""
    x, y, g = F.col("lon"), F.col("lat"), F.col("g")
    u = S.ring((x, y), (x + 5, y), (x + 5, y + 5), (x + 4, y + 5), (x + 4, y + 5 - g), (x + 1, y + 5 - g), (x + 1, y + 5), (x, y + 5))
    t = table(spark, d, "districts").where("lat is not null and lon is not null").withColumn("g", F.col("district_id") % 9 * 0.5).withColumn("u", u)
    t = t.withColumn("c", S.centroid(F.col("u"))).withColumn("p", S.interior_point(F.col("u")))
    central = G.ring_contains(F.col("c.x"), F.col("c.y"), F.col("u"))
    t = t.withColumn("by", F.when(central, "centroid").otherwise("scan")).withColumn("r", F.when(central, F.col("c")).otherwise(F.col("p")))
    own = lambda c: F.when(F.col("by") == "centroid", F.round(F.col(c), 6))
    return t.select("district_id", "by", own("c.x").alias("x"), own("c.y").alias("y"), G.ring_contains(F.col("r.x"), F.col("r.y"), F.col("u")).alias("held"))


@query("g10_rings_to_multipolygon", f"SELECT district_id, 1 + (district_id % 3 = 2)::INT AS n_polygons, 1 + (district_id % 3 = 2)::INT + (district_id % 2)::INT AS n_rings, 1 + (district_id % 2)::INT AS n_first FROM {_D}")
def g10(spark, d):
    """An outer ring, every second one with a hole, every third one with an outer ring beside it, told apart by orientation."""
    far = F.transform(_square(0.5), lambda p: F.struct((p["x"] + 10).alias("x"), p["y"].alias("y")))
    k, none = F.col("district_id"), F.lit(None).cast(S.RING)
    rings = F.array_compact(F.array(F.when(k % 3 == 2, far).otherwise(none), _square(1), F.when(k % 2 == 1, F.reverse(_square(0.2))).otherwise(none)))
    t = table(spark, d, "districts").where("lat is not null and lon is not null").withColumn("m", P.to_multipolygon(rings))
    middle = F.filter("m", lambda p: F.abs(p[0][0]["x"] - F.col("lon")) < 2)[0]
    return t.select("district_id", F.size("m").alias("n_polygons"), F.aggregate("m", F.lit(0), lambda a, p: a + F.size(p)).alias("n_rings"), F.size(middle).alias("n_first"))


@query("g11_dateline_unwrap", f"SELECT district_id, CAST(round((district_id % 40 + 1) * 0.1, 6) AS DOUBLE) AS width FROM {_D}")
def g11(spark, d):
    """Rings of growing width that begin before, at and beyond 180 degrees."""
    wrap = lambda v: F.pmod(v + 180, F.lit(360.0)) - 180
    x0, w = 179.9 + F.col("district_id") % 3 * 0.1, (F.col("district_id") % 40 + 1) * 0.1
    ring = S.ring(*[(wrap(x0 + dx), F.col("lat") + dy) for dx, dy in ((F.lit(0.0), 0), (w, 0), (w, 0.1), (F.lit(0.0), 0.1))])
    t = table(spark, d, "districts").where("lat is not null and lon is not null").withColumn("b", S.bbox(P.unwrap_ring(ring)))
    return t.select("district_id", F.round(F.col("b.x1") - F.col("b.x0"), 6).alias("width"))


@query("g12_polygon_in_polygon", f"SELECT district_id, (district_id % 4) * 0.3 + (district_id % 10 + 1) * 0.15 < 1 AS held FROM {_D}")
def g12(spark, d):
    """Squares of several sizes and places against a square about the anchor."""
    t = table(spark, d, "districts").where("lat is not null and lon is not null")
    x, y, k, off = F.col("lon"), F.col("lat"), (F.col("district_id") % 10 + 1) * 0.15, F.col("district_id") % 4 * 0.3
    moved = S.ring((x + off - k, y - k), (x + off - k, y + k), (x + off + k, y + k), (x + off + k, y - k))
    return t.select("district_id", P.ring_covers(_square(1), moved).alias("held"))


_SHORT = "CAST((district_id % 30) * 0.001 + 0.0003 AS DOUBLE)"


@query("g18_collapsed_lines", f"SELECT district_id, round(round(lon, 2) / 0.01) = round((round(lon, 2) + {_SHORT}) / 0.01) AS was_collapsed, false AS is_collapsed, round(CASE WHEN round(round(lon, 2) / 0.01) = round((round(lon, 2) + {_SHORT}) / 0.01) THEN 0.01 ELSE {_SHORT} END, 6) AS width FROM {_D}")
def g18(spark, d):
    """Lines of a third of a thousandth of a degree to three hundredths, on a grid of one hundredth: the collapsed ones are stretched to a cell."""
    t = table(spark, d, "districts").where("lat is not null and lon is not null").withColumn("l", S.ring((F.round("lon", 2), F.round("lat", 2)), (F.round("lon", 2) + F.expr(_SHORT), F.round("lat", 2))))
    t = t.withColumn("m", P.repair_collapsed(F.col("l"), 0.01)).withColumn("b", S.bbox(F.col("m")))
    return t.select("district_id", P.collapsed(F.col("l"), 0.01).alias("was_collapsed"), P.collapsed(F.col("m"), 0.01).alias("is_collapsed"), F.round(F.col("b.x1") - F.col("b.x0"), 6).alias("width"))


@query("g32_derivation_audit", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice / nullif(l_quantity, 0) - round(l_extendedprice / nullif(l_quantity, 0), 2)) > 0.004")
def g32(spark, d):
    """Stated values that differ from their derivation by more than a tolerance."""
    unit = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0))
    return table(spark, d, "lineitem").where(F.abs(unit - F.round(unit, 2)) > 0.004).select("l_orderkey", "l_linenumber")


@query("a14_typed_counts", "SELECT metal, count(*) FILTER (au_opt > 0) AS measured, count(*) FILTER (au_opt = 0) AS zero, count(*) FILTER (au_opt IS NULL) AS unknown FROM rows_igs_b11 GROUP BY 1")
def a14(spark, d):
    v = F.col("au_opt")
    return table(spark, d, "rows_igs_b11").groupBy("metal").agg(F.count_if(v > 0).alias("measured"), F.count_if(v == 0).alias("zero"), F.count_if(v.isNull()).alias("unknown"))


@query("a23_grouped_set_union", "SELECT state, county, string_agg(DISTINCT district, '/' ORDER BY district) AS districts, count(DISTINCT name) AS names FROM reviewed_grade_evidence GROUP BY 1, 2")
def a23(spark, d):
    return table(spark, d, "reviewed_grade_evidence").groupBy("state", "county").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("district")), "/"), F.lit("")).alias("districts"), F.count_distinct("name").alias("names"))


@query("v05_inputs_unchanged", "SELECT * FROM (VALUES ('as it was', true), ('in another order', true), ('a row less', false), ('a row twice', false), ('a cent more', false)) v(input, same)")
def v05(spark, d):
    """An input hashed before a job, and after changes that do and don't matter."""
    from ..sources.sinks import digest

    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    one = F.col("c_custkey") == t.agg(F.min("c_custkey")).first()[0]
    after = {"as it was": t, "in another order": t.orderBy(F.col("c_name").desc()).repartition(5), "a row less": t.where(~one), "a row twice": t.unionAll(t.where(one)), "a cent more": t.withColumn("c_acctbal", F.when(one, F.col("c_acctbal") + 0.01).otherwise(F.col("c_acctbal")))}
    before = digest(t)
    return spark.createDataFrame([(n, digest(x) == before) for n, x in after.items()], "input string, same boolean")


@query("v16_clip_accounting", f"SELECT count(*) AS n, count(*) FILTER (abs(lon + 115) + abs(lat - 44) < 5) AS kept, count(*) FILTER (NOT abs(lon + 115) + abs(lat - 44) < 5) AS removed FROM rows_igs_b11 WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 180")
def v16(spark, d):
    """A clip by polygon with its account of rows removed."""
    t = table(spark, d, "rows_igs_b11").where(G.valid_point(F.col("lat"), F.col("lon"))).select("row_id", "lat", "lon")
    c = F.lit
    diamond = F.array(S.ring((c(-110.0), c(44.0)), (c(-115.0), c(49.0)), (c(-120.0), c(44.0)), (c(-115.0), c(39.0))))
    area = spark.range(1).select(F.lit(1).alias("id"), diamond.alias("rings"))
    kept = regions.points_in_polygons(t, "row_id", "lon", "lat", area, "id", "rings").select("row_id", F.lit(1).alias("hit"))
    j = t.join(kept, "row_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("kept"), F.count_if(F.col("hit").isNull()).alias("removed"))


@query("v22_property_fingerprints", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS fp FROM nation""")
def v22(spark, d):
    from ..sources.sinks import canonical_json

    return table(spark, d, "nation").select("n_nationkey", F.sha2(canonical_json(["n_name", "n_regionkey"]), 256).alias("fp"))


@query(
    "v25_quote_floor",
    r"""WITH e AS (SELECT e.evidence_id, e.verbatim_quote AS q FROM (SELECT unnest(evidence) AS e FROM reviewed_grade_evidence) WHERE regexp_full_match(e.verbatim_quote, '[ -~]+') AND regexp_matches(e.verbatim_quote, '[a-zA-Z0-9]')),
            p AS (SELECT *, array_to_string(string_split(q, ' ')[1 : CAST(ceil(len(string_split(q, ' ')) * (6 + length(evidence_id || q) % 5) / 10.0) AS INTEGER)], ' ') AS head FROM e)
       SELECT evidence_id, round(share, 6) AS score, share >= 0.85 AS stands FROM (SELECT evidence_id, CAST(len(list_filter(w, lambda x: list_contains(h, x))) AS DOUBLE) / len(w) AS share
              FROM (SELECT evidence_id, regexp_extract_all(lower(q), '[a-z0-9]+') AS w, regexp_extract_all(lower(head), '[a-z0-9]+') AS h FROM p))""",
)
def v25(spark, d):
    """Quotations against pages that hold their first six tenths to the whole of them, amid other words."""
    e = table(spark, d, "reviewed_grade_evidence").select(F.explode("evidence").alias("e")).select("e.evidence_id", F.col("e.verbatim_quote").alias("q")).where(r"q rlike '^[ -~]+$' and q rlike '[a-zA-Z0-9]'")
    w = F.split("q", " ")
    n = F.ceil(F.size(w) * (6 + F.length(F.concat("evidence_id", "q")) % 5) / 10).cast("int")
    page = F.concat(F.lit("zzza zzzb "), F.array_join(F.slice(w, F.lit(1), n), " "), F.lit(" zzzc zzzd"))
    e = e.withColumn("score", T.quote_score(F.col("q"), page))
    return e.select("evidence_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.85).alias("stands"))


@query("v27_set_reconciliation", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS live, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS covered, (SELECT count(*) FROM orders) AS total")
def v27(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"))
    return o.join(c, "o_custkey", "left").agg(F.count(F.lit(1)).alias("live"), F.count("hit").alias("covered"), F.sum("n").alias("total"))


@query(
    "v30_inventory_replay",
    """WITH p AS (SELECT 'all' AS part, l_orderkey AS k FROM lineitem UNION ALL SELECT 'returned', l_orderkey FROM lineitem WHERE l_returnflag = 'R')
       SELECT part, count(*) AS instances, count(DISTINCT k) AS records, count(DISTINCT k) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS replays FROM p GROUP BY 1""",
)
def v30(spark, d):
    """Id inventories of a table and of a part of it against that of the shuffled table."""
    t = table(spark, d, "lineitem")
    known = R.id_inventory(t.select("l_orderkey").distinct().orderBy(F.col("l_orderkey").desc()), "l_orderkey").select(F.col("digest").alias("known"))
    parts = [R.id_inventory(x, "l_orderkey").withColumn("part", F.lit(n)) for n, x in (("all", t), ("returned", t.where("l_returnflag = 'R'")))]
    both = parts[0].unionByName(parts[1]).join(F.broadcast(known))  # one row
    return both.select("part", F.col("n").alias("instances"), F.col("n_distinct").alias("records"), (F.col("digest") == F.col("known")).alias("replays"))


@query("v32_lossless_loop", f"SELECT 0 AS missing, count(*) FILTER (round(round(lon, 2) / 0.01) = round((round(lon, 2) + {_SHORT}) / 0.01)) AS repaired, count(*) AS total FROM {_D}")
def v32(spark, d):
    """Diagnose ids lost at a resolution, repair only those, prove that none is lost and no other was touched."""
    t = table(spark, d, "districts").where("lat is not null and lon is not null").select("district_id", S.ring((F.round("lon", 2), F.round("lat", 2)), (F.round("lon", 2) + F.expr(_SHORT), F.round("lat", 2))).alias("l"))
    out = t.withColumn("lost", P.collapsed(F.col("l"), 0.01)).withColumn("m", P.repair_collapsed(F.col("l"), 0.01)).withColumn("still", P.collapsed(F.col("m"), 0.01))
    touched = ~F.col("l").eqNullSafe(F.col("m"))
    return out.agg(F.count_if("still").alias("missing"), F.count_if(touched).alias("repaired"), F.count(F.lit(1)).alias("total"))


@query("n02_document_merge", "SELECT state, CASE WHEN state = 'AK' THEN 3 ELSE 1 END AS a, CASE WHEN state = 'ID' THEN 9 ELSE 2 END AS b FROM (SELECT DISTINCT state FROM districts)")
def n02(spark, d):
    """Defaults merged with a state's own settings: a document in plain Python, then a small table."""
    from ..sources.registry import merge

    base, own = {"x": {"a": 1, "b": 2}}, {"AK": {"x": {"a": 3}}, "ID": {"x": {"b": 9}}}
    states = [r.state for r in table(spark, d, "districts").select("state").distinct().collect()]  # at most the states
    docs = [merge(base, own.get(s, {})) for s in states]
    return spark.createDataFrame([(s, x["x"]["a"], x["x"]["b"]) for s, x in zip(states, docs)], "state string, a int, b int")
