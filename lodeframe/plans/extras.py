"""Further record functions: coded legal texts, layer bindings, release lists, reports and hash chains."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import relational as R
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(
    "t03_coded_legal_sections",
    """SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 3, '0') || 'S' || lpad(CAST(p_partkey % 40 + 1 AS VARCHAR), 3, '0') || 'E' || lpad(CAST(p_partkey % 36 + 1 AS VARCHAR), 2, '0') AS section FROM part""",
)
def t03(spark, d):
    """Section keys of coded descriptions "08 0120S 0220E 014", townships and ranges in tenths."""
    code = F.format_string("08 %03d0S %03d0E %03d", "p_size", (F.col("p_partkey") % 40 + 1).cast("int"), (F.col("p_partkey") % 36 + 1).cast("int"))
    parts = F.regexp_extract_all(code, F.lit(r"\d{2} (\d{3})0([NS]) (\d{3})0([EW]) (\d{3})"), F.lit(0))
    key = F.transform(parts, lambda p: F.concat(F.substring(p, 4, 3), F.substring(p, 8, 1), F.substring(p, 10, 3), F.substring(p, 14, 1), F.substring(p, 17, 2)))
    return table(spark, d, "part").select("p_partkey", F.explode(key).alias("section"))


@query(
    "t05_bounded_parts",
    "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:3], '/') AS parts FROM orders GROUP BY 1",
)
def t05(spark, d):
    """Distinct parts in order, three at most."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("v"))
    return g.select("o_custkey", F.array_join(F.slice("v", 1, 3), "/").alias("parts"))


@query("t17_window_containment", "SELECT p_partkey, round(CASE WHEN p_size = 0 THEN 0 ELSE CAST(p_partkey % (p_size + 1) AS DOUBLE) / p_size END, 6) AS score FROM part")
def t17(spark, d):
    """Quotations of p_size words on pages that hold the first few of them, apart from other words."""
    words = lambda a, b, stem: F.array_join(F.transform(F.sequence(F.lit(a), b), lambda i: F.concat(F.lit(stem), i.cast("string"))), " ")
    size, held = F.col("p_size").cast("int"), (F.col("p_partkey") % (F.col("p_size") + 1)).cast("int")
    page = F.concat(words(1, F.lit(70), "x"), F.lit(" "), F.when(held > 0, words(1, F.greatest(held, F.lit(1)), "w")).otherwise(F.lit("")), F.lit(". "), words(1, F.lit(70), "y"))
    return table(spark, d, "part").select("p_partkey", F.round(T.quote_score(F.upper(words(1, F.greatest(size, F.lit(1)), "w")), page), 6).alias("score"))


@query("t29_type_decode", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'LODE' WHEN 1 THEN 'PLACER' WHEN 2 THEN 'MILL SITE' ELSE 'OTHER' END AS kind FROM nation")
def t29(spark, d):
    m = F.create_map(*[F.lit(x) for kv in {0: "LODE", 1: "PLACER", 2: "MILL SITE"}.items() for x in kv])
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(F.try_element_at(m, "n_regionkey"), F.lit("OTHER")).alias("kind"))


@query("t30_county_normal", r"SELECT DISTINCT county, nullif(trim(regexp_replace(lower(trim(county)), '\s+(county|co\.)$', '')), '') AS plain FROM rows_igs_b11")
def t30(spark, d):
    plain = F.nullif(F.trim(F.regexp_replace(F.lower(F.trim("county")), r"\s+(county|co\.)$", "")), F.lit(""))
    return table(spark, d, "rows_igs_b11").select("county", plain.alias("plain")).distinct()


@query("j37_layer_binding", "SELECT s_suppkey, n_name, s_acctbal BETWEEN 0 AND 5000 AS in_range FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 12")
def j37(spark, d):
    """A configured layer by id, with a check of its range."""
    n = table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey", "left").select("s_suppkey", "n_name", F.col("s_acctbal").between(0, 5000).alias("in_range"))


@query("k08_top_report", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def k08(spark, d):
    """The rows of a top-ten report."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 2).alias("mean")).orderBy(F.col("n").desc(), "p_brand").limit(10)


@query("k13_release_list", "SELECT DISTINCT state, 'rows' AS layer FROM rows_igs_b11 WHERE state NOT IN ('AK') UNION ALL SELECT DISTINCT state, 'districts' FROM districts WHERE state NOT IN ('AK')")
def k13(spark, d):
    """Layers of the enabled states only."""
    off = F.col("state").isin("AK")
    one = lambda t: table(spark, d, t[0]).where(~off).select("state").distinct().withColumn("layer", F.lit(t[1]))
    return one(("rows_igs_b11", "rows")).unionByName(one(("districts", "districts")))


@query("s09_first_row_and_merged_list", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS first_part, array_to_string(list_sort(list_distinct(list(l_suppkey)))[1:3], ',') AS suppliers FROM lineitem GROUP BY 1")
def s09(spark, d):
    """Repeated keys of a paged scan: the first row, and the merged, sorted, bounded list."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first_part"), F.array_sort(F.collect_set("l_suppkey")).alias("v"))
    return g.select("l_orderkey", "first_part", F.array_join(F.slice("v", 1, 3), ",").alias("suppliers"))


@query("s34_parsed_filtered_scan", "SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name) AND p_size BETWEEN 5 AND 20 ORDER BY p_size, p_partkey")
def s34(spark, d):
    """First of each key, filtered and sorted."""
    t = R.first_per_key(table(spark, d, "part").select("p_name", "p_partkey", "p_size"), ["p_name"], F.col("p_partkey"))
    return t.where("p_size between 5 and 20").orderBy("p_size", "p_partkey").select("p_partkey", "p_size")


@query("x07_month_window", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%m-%d') BETWEEN '08-25' AND '09-10'")
def x07(spark, d):
    """Rows within a yearly season."""
    return table(spark, d, "orders").where(F.date_format(F.col("o_orderdate").cast("timestamp"), "MM-dd").between("08-25", "09-10")).select("o_orderkey")


@query("z03_unknown_without_fees", "SELECT c_custkey, CASE WHEN o.n IS NULL THEN NULL ELSE o.n > 10 END AS paid FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def z03(spark, d):
    """A flag that is unknown where the report lacks the key."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", (F.col("n") > 10).alias("paid"))


@query("w15_multi_key_sort", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, value DESC, event_id) AS pos FROM events")
def w15(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_type", F.col("value").desc(), "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("pos"))


@query("v29_claim_counts_equal", "SELECT l_orderkey, count(*) AS n, count(*) = max(o_orderkey % 8) AS same FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def v29(spark, d):
    """Counted lines of an order against the number its own record declares (here one that is right now and then)."""
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 8).alias("c"))
    counted = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(declared, "l_orderkey").select("l_orderkey", "n", (F.col("n") == F.col("c")).alias("same"))
