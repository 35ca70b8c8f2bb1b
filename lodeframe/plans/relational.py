"""Joins, aggregations, rankings and sets over the order tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as R
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


# --- joins (J) --------------------------------------------------------------------------------


@query(
    "j01_exploded_key_join",
    """WITH o AS (SELECT o_orderkey, list(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
       e AS (SELECT o_orderkey, unnest(parts) AS p_partkey FROM o)
       SELECT p_brand, count(*) AS n_claims, count(DISTINCT o_orderkey) AS n_orders FROM e JOIN part USING (p_partkey) GROUP BY 1""",
)
def j01(spark, d):
    """Records that carry an array of keys, joined by each key to a dimension."""
    arr = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    e = arr.select(F.col("l_orderkey").alias("o_orderkey"), F.explode("parts").alias("p_partkey"))
    return e.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_distinct("o_orderkey").alias("n_orders")
    )


@query(
    "j14_id_equi_join",
    "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
)
def j14(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "j16_fallback_lookup",
    """WITH a AS (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 9000 GROUP BY 1),
            b AS (SELECT n_regionkey AS r, max(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
       SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS stage
       FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN a ON a.k = c_nationkey LEFT JOIN b ON b.r = n_regionkey""",
)
def j16(spark, d):
    """A value from the first of several lookups that has it."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    a = s.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("v"))
    b = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.max("s_acctbal").alias("v"))
    c = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return R.fallback_lookup(c.select("c_custkey", "c_nationkey", "n_regionkey"), [(a, ["c_nationkey"]), (b, ["n_regionkey"])], "v").select("c_custkey", "v", "stage")


@query(
    "j19_unique_group_join",
    """WITH g AS (SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2 HAVING count(*) = 1)
       SELECT p.p_partkey, g.p_partkey AS twin FROM part p LEFT JOIN g ON g.p_brand = p.p_brand AND g.p_size = p.p_size - 1""",
)
def j19(spark, d):
    """Join to keys that stand for exactly one record; others stay unmatched."""
    p = table(spark, d, "part")
    g = p.groupBy("p_brand", (F.col("p_size") + 1).alias("p_size")).agg(F.min("p_partkey").alias("twin"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return p.join(g, ["p_brand", "p_size"], "left").select("p_partkey", "twin")


@query("j20_left_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j20(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "j23_join_with_unmapped",
    """SELECT CASE WHEN p_partkey IS NULL THEN 'unmapped' ELSE 'mapped' END AS side, count(*) AS n, count(DISTINCT l_partkey) AS keys
       FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY 1""",
)
def j23(spark, d):
    """Counts of mapped and of unmapped keys from one pass."""
    p = table(spark, d, "part").where("p_size <= 40").select("p_partkey", F.lit(1).alias("hit"))
    j = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey", "left")
    return j.groupBy(F.when(F.col("hit").isNull(), "unmapped").otherwise("mapped").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("keys"))


@query(
    "j24_missing_on_either_side",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side
       FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k
       WHERE a.k IS NULL OR b.k IS NULL""",
)
def j24(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return R.missing_and_extra(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k")


@query("j26_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j26(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query(
    "j29_multiway_lossless_join",
    """SELECT o_orderkey, a.n AS n_lines, round(b.amount, 2) AS amount, c_mktsegment FROM orders
       JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey
       JOIN (SELECT l_orderkey, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1) b ON b.l_orderkey = o_orderkey
       JOIN customer ON c_custkey = o_custkey""",
)
def j29(spark, d):
    """Terms of several sources by one key; both line terms come from one aggregation."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(li, "o_orderkey").join(c, "o_custkey").select("o_orderkey", "n_lines", "amount", "c_mktsegment")


@query(
    "j30_default_lookup",
    """SELECT p_type, coalesce(t.grade, CASE WHEN p_type LIKE 'PROMO%' THEN 'documented gap' ELSE 'none' END) AS grade, count(*) AS n
       FROM part LEFT JOIN (SELECT * FROM (VALUES ('STANDARD', 'a'), ('SMALL', 'b'), ('MEDIUM', 'c')) v(k, grade)) t ON t.k = split_part(p_type, ' ', 1) GROUP BY 1, 2""",
)
def j30(spark, d):
    """Broadcast lookup with a documented default for a known gap."""
    t = spark.createDataFrame([("STANDARD", "a"), ("SMALL", "b"), ("MEDIUM", "c")], "k string, grade string")
    p = table(spark, d, "part").withColumn("k", F.substring_index("p_type", " ", 1)).join(F.broadcast(t), "k", "left")
    grade = F.coalesce("grade", F.when(F.col("p_type").startswith("PROMO"), "documented gap").otherwise("none"))
    return p.groupBy("p_type", grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j32_normalized_key_join",
    r"""WITH a AS (SELECT DISTINCT state, lower(trim(regexp_replace(county, '\s+(Co\.|COUNTY|County)$', ''))) AS c FROM rows_igs_b11 WHERE trim(county) <> ''),
             b AS (SELECT state, lower(trim(regexp_replace(county, '\s+County$', ''))) AS c, count(*) AS n FROM reviewed_grade_evidence WHERE county IS NOT NULL GROUP BY 1, 2)
        SELECT a.state, a.c AS county, b.n FROM a JOIN b ON a.state = b.state AND a.c = b.c""",
)
def j32(spark, d):
    """Join on state and a normalised county name."""
    plain = lambda c, p: F.lower(F.trim(F.regexp_replace(c, p, "")))
    a = table(spark, d, "rows_igs_b11").where("trim(county) <> ''").select("state", plain("county", r"\s+(Co\.|COUNTY|County)$").alias("county")).distinct()
    b = table(spark, d, "reviewed_grade_evidence").where("county is not null").groupBy("state", plain("county", r"\s+County$").alias("county")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, ["state", "county"])


@query(
    "j33_left_join_collected",
    """SELECT s_suppkey, len(coalesce(v.sizes, [])) AS n_sizes, array_to_string(coalesce(v.sizes, []), ',') AS sizes FROM supplier LEFT JOIN
       (SELECT l_suppkey, list_sort(list_distinct(list(p_size))) AS sizes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) v ON v.l_suppkey = s_suppkey""",
)
def j33(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    v = j.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_sort(F.collect_set("p_size")).alias("v"))
    out = table(spark, d, "supplier").join(v, "s_suppkey", "left")
    return out.select("s_suppkey", F.coalesce(F.size("v"), F.lit(0)).alias("n_sizes"), F.coalesce(F.array_join("v", ","), F.lit("")).alias("sizes"))


@query(
    "j36_nearest_key_asof",
    """WITH k AS (SELECT DISTINCT price_year FROM rows_igs_b11 WHERE price_year IS NOT NULL),
            p AS (SELECT price_year AS y, price_usd FROM metal_prices WHERE commodity = 'Ag'),
            r AS (SELECT k.price_year, p.y, p.price_usd, row_number() OVER (PARTITION BY k.price_year ORDER BY abs(k.price_year - p.y), p.y) AS rn FROM k, p)
       SELECT row_id, x.price_year, r.y AS near_price_year, r.price_usd FROM rows_igs_b11 x LEFT JOIN r ON r.price_year = x.price_year AND rn = 1""",
)
def j36(spark, d):
    """Nearest year of a price table, ties to the earlier year."""
    p = table(spark, d, "metal_prices").where("commodity = 'Ag'").select(F.col("price_year").alias("y"), "price_usd")
    rows = table(spark, d, "rows_igs_b11").select("row_id", "price_year")
    return R.nearest_key(rows, "price_year", p, "y", ["price_usd"]).select("row_id", "price_year", F.col("near_y").alias("near_price_year"), "price_usd")


@query(
    "j38_curated_crosswalk_audit",
    """WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS target FROM supplier)
       SELECT CASE WHEN target IS NULL THEN 'no_match' WHEN n_nationkey IS NULL THEN 'broken' ELSE 'linked' END AS status, count(*) AS n
       FROM c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = target GROUP BY 1""",
)
def j38(spark, d):
    """A curated link table: linked, explicitly without a match, or broken."""
    c = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("target"))
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("target"), F.lit(1).alias("hit"))
    status = F.when(F.col("target").isNull(), "no_match").when(F.col("hit").isNull(), "broken").otherwise("linked")
    return c.join(F.broadcast(n), "target", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("j39_citation_attach", "SELECT row_id, title || ', p. ' || page AS cite FROM rows_igs_b11 r JOIN source_list s ON s.src_key = r.src_key WHERE page IS NOT NULL")
def j39(spark, d):
    s = table(spark, d, "source_list").select("src_key", "title")
    return table(spark, d, "rows_igs_b11").where("page is not null").join(F.broadcast(s), "src_key").select("row_id", F.concat("title", F.lit(", p. "), "page").alias("cite"))


@query(
    "j40_backfill_nulls",
    """WITH b AS (SELECT state, district, min(county) AS c FROM districts WHERE county IS NOT NULL GROUP BY 1, 2),
            x AS (SELECT state, name AS district, min(county) AS c FROM districts WHERE county IS NOT NULL GROUP BY 1, 2)
       SELECT row_id, coalesce(nullif(trim(r.county), ''), x.c) AS county FROM rows_igs_b11 r LEFT JOIN x ON x.state = r.state AND x.district = r.district""".replace(
        "WITH b AS (SELECT state, district, min(county) AS c FROM districts WHERE county IS NOT NULL GROUP BY 1, 2),\n            x", "WITH x"
    ),
)
def j40(spark, d):
    """A county filled in only where it is blank."""
    x = table(spark, d, "districts").where("county is not null").groupBy("state", F.col("name").alias("district")).agg(F.min("county").alias("c"))
    r = table(spark, d, "rows_igs_b11").select("row_id", "state", "district", "county")
    return r.join(F.broadcast(x), ["state", "district"], "left").select("row_id", F.coalesce(F.nullif(F.trim("county"), F.lit("")), "c").alias("county"))


@query(
    "j42_forced_seeds",
    """WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
       SELECT c_nationkey, c_custkey, CASE WHEN rank <= 5 THEN rank END AS rank, rank > 5 AS forced FROM r WHERE rank <= 5 OR c_custkey IN (SELECT s_suppkey FROM supplier)""",
)
def j42(spark, d):
    """The first five of each nation, and the forced seeds that aren't among them, without a rank and displacing none."""
    c = table(spark, d, "customer")
    top = R.top_per_group(c.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 5, F.col("c_acctbal").desc(), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank", F.lit(False).alias("forced"))
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    extra = c.select("c_nationkey", "c_custkey").join(seeds, "c_custkey", "left_semi").join(top.select("c_custkey"), "c_custkey", "left_anti")
    return top.unionByName(extra.select("c_nationkey", "c_custkey", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("forced")))


@query("j43_salted_hot_key_join", "SELECT l_returnflag, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM lineitem JOIN (VALUES ('A', 1), ('N', 2), ('R', 3)) t(f, v) ON f = l_returnflag GROUP BY 1")
def j43(spark, d):
    """A join whose three keys hold all rows, with the hot keys dealt to buckets."""
    t = spark.createDataFrame([("A", 1), ("N", 2), ("R", 3)], "l_returnflag string, v int")
    j = R.salted_join(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), t, ["l_returnflag"])
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


# --- aggregations (A) ---------------------------------------------------------------------------


@query(
    "a01_conditional_counters",
    """SELECT n_name, count(*) FILTER (o_orderstatus = 'O') AS open_n, count(*) FILTER (o_orderstatus = 'F') AS closed_n, count(*) FILTER (o_totalprice > 200000) AS rich,
       max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS best_open FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
)
def a01(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open_n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed_n"),
        F.count_if(F.col("o_totalprice") > 200_000).alias("rich"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("best_open"),
    )


@query("a02_status_histogram", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a02(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a03_capped_sample_lists",
    """SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS first3 FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1""",
)
def a03(spark, d):
    t = R.capped_list(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderkey"), F.col("o_orderkey"), 3, "v")
    return t.select("o_custkey", F.array_join("v", ",").alias("first3"))


@query("a04_newest_per_group", "SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1")
def a04(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))


@query(
    "a05_first_maximum",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
)
def a05(spark, d):
    """First row that has the greatest value, decided by an explicit order."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.first_per_key(li, ["l_suppkey"], -F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))


@query("a06_longest_string", "SELECT src_key, max(length(tonnage)) AS len, arg_min(tonnage, (-length(tonnage), row_id)) AS longest FROM rows_igs_b11 WHERE tonnage IS NOT NULL GROUP BY 1")
def a06(spark, d):
    t = table(spark, d, "rows_igs_b11").where("tonnage is not null")
    return t.groupBy("src_key").agg(F.max(F.length("tonnage")).cast("bigint").alias("len"), F.min_by("tonnage", F.struct(-F.length("tonnage"), F.col("row_id"))).alias("longest"))


@query(
    "a07_group_profile_with_top3",
    """WITH e AS (SELECT state, metal, count(*) AS c FROM rows_igs_b11 GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY c DESC, metal) AS r FROM e)
       SELECT g.state, g.n, tops FROM (SELECT state, count(*) AS n FROM rows_igs_b11 GROUP BY 1 HAVING count(*) >= 5) g
       JOIN (SELECT state, array_to_string(list(metal ORDER BY r), '/') AS tops FROM t WHERE r <= 3 GROUP BY 1) USING (state)""",
)
def a07(spark, d):
    c = table(spark, d, "rows_igs_b11").groupBy("state", "metal").agg(F.count(F.lit(1)).alias("c"))
    top = R.capped_list(c, ["state"], F.col("metal"), F.struct(-F.col("c"), F.col("metal")), 3, "v")
    return c.groupBy("state").agg(F.sum("c").alias("n")).where("n >= 5").join(top, "state").select("state", "n", F.array_join("v", "/").alias("tops"))


@query("a08_weighted_centroid", "SELECT district_id % 20 AS g, round(sum(lat * radius_km) / sum(radius_km), 6) AS lat, round(sum(lon * radius_km) / sum(radius_km), 6) AS lon FROM districts WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1")
def a08(spark, d):
    t = table(spark, d, "districts").where("lat is not null and lon is not null")
    w = F.sum("radius_km")
    return t.groupBy((F.col("district_id") % 20).alias("g")).agg(F.round(F.sum(F.col("lat") * F.col("radius_km")) / w, 6).alias("lat"), F.round(F.sum(F.col("lon") * F.col("radius_km")) / w, 6).alias("lon"))


@query("a09_sum_if_complete", "SELECT c_mktsegment, CASE WHEN bool_and(c_acctbal > -995) THEN round(sum(c_acctbal), 2) END AS total FROM customer GROUP BY 1")
def a09(spark, d):
    """A merged total that is unknown unless every part is complete."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(R.sum_if_complete(F.col("c_acctbal"), F.col("c_acctbal") > -995), 2).alias("total"))


@query(
    "a10_rollup_totals",
    """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def a10(spark, d):
    t = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return t.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "qty")


@query("a11_id_inventory_counts", "SELECT count(o_custkey) AS n, count(DISTINCT o_custkey) AS n_distinct FROM orders")
def a11(spark, d):
    return R.id_inventory(table(spark, d, "orders"), "o_custkey").select("n", "n_distinct")


@query(
    "a11_id_inventory_digest",
    """WITH k AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS e, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders), c AS (SELECT count(*) AS u, CASE WHEN count(*) > 4096 THEN 1 ELSE 0 END AS digits FROM k),
            b AS (SELECT substr(h, 1, digits) AS h, digits, sha256(string_agg(e, chr(10) ORDER BY e)) AS d FROM k, c GROUP BY 1, 2)
       SELECT (SELECT count(*) FROM orders) AS n, u AS n_distinct, (SELECT CASE WHEN max(digits) = 0 THEN max(d) ELSE sha256(string_agg(h || ':' || d, chr(10) ORDER BY h || ':' || d)) END FROM b) AS digest FROM c""",
)
def a11b(spark, d):
    """Order-free digest of an id set (its equality is tested with permuted tables)."""
    return R.id_inventory(table(spark, d, "orders"), "o_orderkey")


@query(
    "a12_id_gaps",
    """SELECT p + 1 AS gap_from, k - 1 AS gap_to FROM (SELECT lag(k) OVER (ORDER BY k) AS p, k FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45)) WHERE k > p + 1""",
)
def a12(spark, d):
    return R.id_gaps(table(spark, d, "lineitem").where("l_quantity > 45"), "l_orderkey")


@query(
    "a13_grouping_sets",
    """SELECT coalesce(state, '*') AS state, coalesce(metal, '*') AS metal, count(*) AS n FROM rows_igs_b11 GROUP BY GROUPING SETS ((state), (metal), (state, metal), ())""",
)
def a13(spark, d):
    t = table(spark, d, "rows_igs_b11").groupingSets([["state"], ["metal"], ["state", "metal"], []], "state", "metal").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.coalesce("state", F.lit("*")).alias("state"), F.coalesce("metal", F.lit("*")).alias("metal"), "n")


@query("a15_distinct_and_sorted_set", "SELECT state, count(DISTINCT name) AS names, array_to_string(list_sort(list_distinct(list(metal))), ',') AS metals FROM rows_igs_b11 GROUP BY 1")
def a15(spark, d):
    return table(spark, d, "rows_igs_b11").groupBy("state").agg(F.count_distinct("name").alias("names"), F.array_join(F.array_sort(F.collect_set("metal")), ",").alias("metals"))


@query("a16_fraction_by_status", "SELECT o_orderpriority AS p, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 6) AS open_share FROM orders GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.round(F.avg((F.col("o_orderstatus") == "O").cast("int")), 6).alias("open_share"))


@query("a17_set_union_by_group", "SELECT n_regionkey AS r, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segs FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def a17(spark, d):
    j = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("r")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segs"))


@query("a18_delta_evidence", "SELECT l_shipmode, n, sum_d, max_d FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, round(sum(abs(l_tax - l_discount)), 4) AS sum_d, round(max(abs(l_tax - l_discount)), 4) AS max_d FROM lineitem GROUP BY 1)")
def a18(spark, d):
    delta = F.abs(F.col("l_tax") - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(delta), 4).alias("sum_d"), F.round(F.max(delta), 4).alias("max_d"))


@query("a19_samples_within_limits", "SELECT event_type, max(value) AS worst, bool_and(value <= 95) AS ok FROM events GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("worst"), F.bool_and(F.col("value") <= 95).alias("ok"))


@query(
    "a20_supported_mode",
    """SELECT g, v, n FROM (SELECT src_key AS g, pdf_page - page AS v, count(*) AS n, row_number() OVER (PARTITION BY src_key ORDER BY count(*) DESC, pdf_page - page) AS r
       FROM rows_igs_b11 WHERE pdf_page IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2) WHERE r = 1 AND n >= 5""",
)
def a20(spark, d):
    """Most common offset of a source, if it has support."""
    t = table(spark, d, "rows_igs_b11").where("pdf_page is not null and page is not null").groupBy(F.col("src_key").alias("g"), (F.col("pdf_page") - F.col("page")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return R.first_per_key(t, ["g"], -F.col("n"), F.col("v")).where("n >= 5")


@query("a21_gate_summary", "SELECT o_orderstatus AS s, bool_and(o_totalprice > 1000) AS all_ok, count(*) AS n, count(*) FILTER (o_totalprice <= 1000) AS bad FROM orders GROUP BY 1")
def a21(spark, d):
    ok = F.col("o_totalprice") > 1000
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.bool_and(ok).alias("all_ok"), F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("bad"))


@query("a22_count_dictionary", "SELECT state, string_agg(metal || '=' || n, ',' ORDER BY metal) AS counts FROM (SELECT state, metal, count(*) AS n FROM rows_igs_b11 GROUP BY 1, 2) GROUP BY 1")
def a22(spark, d):
    t = table(spark, d, "rows_igs_b11").groupBy("state", "metal").agg(F.count(F.lit(1)).alias("n"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metal", "n"))))
    return t.groupBy("state").agg(m.alias("m")).select("state", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"))


@query(
    "a24_multiset_coverage",
    """WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
            b AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
       SELECT s AS l_suppkey, CAST(sum(least(a.n, b.n)) AS BIGINT) AS overlap FROM a JOIN b USING (s, p) GROUP BY 1""",
)
def a24(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return R.multiset_overlap(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), ["l_suppkey"], "l_partkey")


# --- ranking (W) ---------------------------------------------------------------------------------


@query(
    "w01_rank_eligible_only",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN row_number() OVER (PARTITION BY p_size > 25 ORDER BY p_retailprice DESC, p_partkey) END AS rank FROM part""",
)
def w01(spark, d):
    """Rank over the eligible rows, null for the others, without one task for all."""
    p = table(spark, d, "part")
    return R.dense_rank_where(p, F.col("p_size") > 25, F.col("p_retailprice").desc(), F.col("p_partkey")).select("p_partkey", "rank")


@query(
    "w03_evidence_sort_rank",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS rank FROM orders""",
)
def w03(spark, d):
    ev = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(ev, F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rank"))


@query(
    "w05_declared_rank_audit",
    """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS computed FROM lineitem)
       SELECT l_orderkey, count(*) AS off FROM r WHERE computed <> l_linenumber GROUP BY 1""",
)
def w05(spark, d):
    """Declared ranks against 1..n."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("c"))
    return r.where("c <> l_linenumber").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("off"))


@query("w06_top3_per_group", "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def w06(spark, d):
    return R.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, F.col("o_totalprice").desc(), F.col("o_orderkey")).drop("o_totalprice")


@query(
    "w07_two_capped_lists",
    """WITH a AS (SELECT o_custkey, o_orderkey, 'rich' AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_totalprice > 150000),
            b AS (SELECT o_custkey, o_orderkey, 'rest' AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_totalprice <= 150000)
       SELECT o_custkey, o_orderkey, kind FROM a WHERE r <= 2 UNION ALL SELECT o_custkey, o_orderkey, kind FROM b WHERE r <= 4""",
)
def w07(spark, d):
    """The last two of one kind before the first four of another."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    a = R.top_per_group(o.where("o_totalprice > 150000"), ["o_custkey"], 2, F.col("o_orderkey").desc()).withColumn("kind", F.lit("rich"))
    b = R.top_per_group(o.where("o_totalprice <= 150000"), ["o_custkey"], 4, F.col("o_orderkey")).withColumn("kind", F.lit("rest"))
    return a.unionByName(b).select("o_custkey", "o_orderkey", "kind")


@query("w09_top_k_report", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 400")
def w09(spark, d):
    """The 400 best rows of a table (a top-k report)."""
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(400)


@query(
    "w11_occurrence_number",
    """SELECT row_id, row_number() OVER (PARTITION BY src_key, page, quote ORDER BY row_id) AS occurrence, count(*) OVER (PARTITION BY src_key, page, quote) AS occurrences FROM rows_igs_b11""",
)
def w11(spark, d):
    """Occurrence number of identical fingerprints."""
    w = Window.partitionBy("src_key", "page", "quote")
    return table(spark, d, "rows_igs_b11").select("row_id", F.row_number().over(w.orderBy("row_id")).alias("occurrence"), F.count(F.lit(1)).over(w).alias("occurrences"))


@query("w12_ascending_check", "SELECT count(*) AS n_down FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE ts < p")
def w12(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("ts", F.lag("ts").over(w).alias("p")).where("ts < p").agg(F.count(F.lit(1)).alias("n_down"))


@query(
    "w16_top_five_binding",
    """WITH a AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
            b AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal / 200) DESC, c_custkey) AS rank FROM customer)
       SELECT * FROM (SELECT * FROM a WHERE rank <= 5 EXCEPT SELECT * FROM b WHERE rank <= 5)""",
)
def w16(spark, d):
    """Computed first fives against a declared list, drawn up by coarser balances: triples that it doesn't bind."""
    c = table(spark, d, "customer")
    five = lambda order: R.top_per_group(c, ["c_nationkey"], 5, order.desc(), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")
    return five(F.col("c_acctbal")).join(five(F.round(F.col("c_acctbal") / 200)), ["c_nationkey", "c_custkey", "rank"], "left_anti")


# --- sets (U) and checks (V) ----------------------------------------------------------------------


@query("u01_flagged_union", "SELECT o_orderkey, true AS active FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderstatus = 'F'")
def u01(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit(True).alias("active"))
    return a.unionByName(o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(False).alias("active")))


@query(
    "u02_union_by_name",
    "SELECT 'rows' AS src, CAST(row_id AS VARCHAR) AS id, name, state FROM rows_igs_b11 UNION ALL SELECT 'reviewed', mine_id, name, state FROM reviewed_grade_evidence UNION ALL SELECT 'sites', CAST(dep_id AS VARCHAR), site_name, NULL FROM mrds_sites",
)
def u02(spark, d):
    """Union of sources with differing columns; what a source lacks is null."""
    a = table(spark, d, "rows_igs_b11").select(F.lit("rows").alias("src"), F.col("row_id").cast("string").alias("id"), "name", "state")
    b = table(spark, d, "reviewed_grade_evidence").select(F.lit("reviewed").alias("src"), F.col("mine_id").alias("id"), "name", "state")
    c = table(spark, d, "mrds_sites").select(F.lit("sites").alias("src"), F.col("dep_id").cast("string").alias("id"), F.col("site_name").alias("name"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query("u03_set_equality", "(SELECT o_orderkey AS k, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)) UNION ALL (SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_quantity > 10 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def u03(spark, d):
    return R.missing_and_extra(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("k")), "k")


@query(
    "u04_disjoint_union_proof",
    """SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) AS shared,
              (SELECT count(*) FROM orders) AS whole, (SELECT count(DISTINCT o_orderkey) FROM orders) AS parts""",
)
def u04(spark, d):
    """One pass: ids in both parts, ids in all, ids in either part."""
    o = table(spark, d, "orders").groupBy("o_orderkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") != "F").alias("b"), F.count(F.lit(1)).alias("n"))
    return o.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.sum("n").alias("whole"), F.count_if(F.col("a") | F.col("b")).alias("parts"))


@query("u05_cross_status_exclusion", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u05(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("u06_difference_of_many", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def u06(spark, d):
    out = table(spark, d, "part").select("p_partkey")
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    for cond in ("l_returnflag = 'R'", "l_quantity > 48"):
        out = out.join(li.where(cond).select("p_partkey"), "p_partkey", "left_anti")
    return out


@query("u07_idempotent_splice", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'b' ELSE 'a' END AS owner FROM nation")
def u07(spark, d):
    """Replacing an owner's rows twice gives the same as once."""
    n = table(spark, d, "nation").select("n_nationkey")
    base = n.where("n_nationkey % 3 <> 0").withColumn("owner", F.lit("a"))
    fresh = n.where("n_nationkey % 3 = 0")
    return R.splice(R.splice(base, "owner", "b", fresh), "owner", "b", fresh)


@query("u08_first_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def u08(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return R.first_per_key(li, ["l_suppkey"], F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).drop("l_shipdate")


@query("u09_partition_split", "SELECT state IN ('ID', 'NV') AS side, count(*) AS n FROM rows_igs_b11 GROUP BY 1")
def u09(spark, d):
    return table(spark, d, "rows_igs_b11").groupBy(F.col("state").isin("ID", "NV").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("u10_identical_facts", "SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT name, district, county, state, quote, src_key, page FROM rows_igs_b11)) AS repeats FROM rows_igs_b11")
def u10(spark, d):
    facts = ["name", "district", "county", "state", "quote", "src_key", "page"]
    g = table(spark, d, "rows_igs_b11").groupBy(*facts).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("repeats"))


@query("v02_duplicate_identity", "SELECT name, district, count(*) AS n FROM reviewed_grade_evidence GROUP BY 1, 2 HAVING count(*) > 1")
def v02(spark, d):
    return table(spark, d, "reviewed_grade_evidence").groupBy("name", "district").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("v04_series_contiguity", "SELECT commodity, min(price_year) AS lo, max(price_year) AS hi, max(price_year) - min(price_year) + 1 - count(DISTINCT price_year) AS holes FROM metal_prices GROUP BY 1")
def v04(spark, d):
    lo, hi = F.min("price_year"), F.max("price_year")
    return table(spark, d, "metal_prices").groupBy("commodity").agg(lo.alias("lo"), hi.alias("hi"), (hi - lo + 1 - F.count_distinct("price_year")).alias("holes"))


@query("v11_exact_scope", "SELECT coalesce(a.s, b.s) AS state, CASE WHEN b.s IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT unnest(['ID', 'NV', 'UT', 'OR', 'HI']) AS s) a FULL JOIN (SELECT DISTINCT state AS s FROM districts) b ON a.s = b.s WHERE a.s IS NULL OR b.s IS NULL")
def v11(spark, d):
    want = spark.createDataFrame([(s,) for s in ("ID", "NV", "UT", "OR", "HI")], "state string")
    return R.missing_and_extra(want, table(spark, d, "districts").select("state"), "state")


@query("v15_typed_tri_state", "SELECT c_custkey, CASE WHEN n IS NOT NULL THEN 'measured' WHEN c_nationkey = 0 THEN 'not_applicable' ELSE 'unknown' END AS status, n AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) ON o_custkey = c_custkey")
def v15(spark, d):
    """measured / unknown / not applicable; unknown never becomes zero."""
    n = table(spark, d, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("value"))
    j = table(spark, d, "customer").join(n, "c_custkey", "left")
    status = F.when(F.col("value").isNotNull(), "measured").when(F.col("c_nationkey") == 0, "not_applicable").otherwise("unknown")
    return j.select("c_custkey", status.alias("status"), "value")


@query("v31_conflicting_repeats", "SELECT src_key || ':' || page AS id, count(*) AS n, count(DISTINCT quote) AS versions FROM rows_igs_b11 GROUP BY 1 HAVING count(DISTINCT quote) > 1")
def v31(spark, d):
    t = table(spark, d, "rows_igs_b11").select(F.concat("src_key", F.lit(":"), "page").alias("id"), "quote")
    return R.conflicting_ids(t, "id", ["quote"])


@query("v33_two_distinct_sources", "SELECT state, count(DISTINCT src_key) AS sources FROM rows_igs_b11 WHERE quote IS NOT NULL GROUP BY 1 HAVING count(DISTINCT src_key) >= 2")
def v33(spark, d):
    return table(spark, d, "rows_igs_b11").where("quote is not null").groupBy("state").agg(F.count_distinct("src_key").alias("sources")).where("sources >= 2")


@query(
    "j35_snapshot_diff",
    """WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
       SELECT coalesce(p.user_id, c.user_id) AS user_id, coalesce(p.event_type, c.event_type) AS event_type, CASE WHEN p.n IS NULL THEN 'added' WHEN c.n IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM p FULL JOIN c ON p.user_id = c.user_id AND p.event_type = c.event_type WHERE p.n IS NULL OR c.n IS NULL OR p.n <> c.n""",
)
def j35(spark, d):
    e = table(spark, d, "events")
    at = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    snap = lambda c: e.where(c).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.snapshot_diff(snap(at), snap(~at), ["user_id", "event_type"], ["n"])


@query("f04_case_insensitive_columns", "SELECT R_RegionKey AS k, R_NAME AS v FROM region")
def f04(spark, d):
    return table(spark, d, "region").select(F.col("R_REGIONKEY").alias("k"), F.col("r_Name").alias("v"))
