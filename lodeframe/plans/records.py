"""Sources and sinks as round trips over the given tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import broadcast_if_small, materialize, shared_dir
from ..sources import files, paged, sinks, snapshot
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _tmp(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s16_delimited_aliases", "SELECT CAST(s_suppkey AS VARCHAR) AS serial, s_name AS name, CAST(NULL AS VARCHAR) AS status FROM supplier")
def s16(spark, d):
    """A pipe-delimited export with foreign headers, read under canonical names."""
    p = _tmp(spark, "delimited")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("Serial No."), F.col("s_name").alias("CLAIM NAME")).write.option("header", True).option("sep", "|").csv(p)
    return files.read_delimited(spark, p, {"serial": ["serial no"], "name": ["claim name", "nm"], "status": ["disposition"]}, "|")


@query("s26_strict_snapshot", "SELECT n_regionkey AS part, n_nationkey AS id, n_name AS nm FROM nation")
def s26(spark, d):
    """Columnar JSON snapshots written, then read with their counts checked."""
    p = _tmp(spark, "snapshot")
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("part"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("nm"))
    snapshot.pack_columns(n, [F.col("part")], ["id", "nm"], F.col("id")).repartition("part").write.json(p)
    lines = spark.read.schema("part int, n int, id array<int>, nm array<string>").json(p)
    return snapshot.unpack_columns(lines.where(~snapshot.ragged(["id", "nm"]) & (F.size("id") == F.col("n"))), ["id", "nm"]).select("part", "id", "nm")


@query("s27_feature_lines", "SELECT CAST(dep_id AS VARCHAR) AS id, site_name AS nm, longitude AS x FROM mrds_sites WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(longitude) AND NOT isnan(latitude)")
def s27(spark, d):
    """Point features written as lines and read back strictly."""
    p = _tmp(spark, "features")
    t = table(spark, d, "mrds_sites").where("longitude is not null and latitude is not null and not isnan(longitude) and not isnan(latitude)")
    sinks.write_feature_lines(t.withColumn("id", F.col("dep_id").cast("string")).withColumn("nm", F.col("site_name")), p, "id", "longitude", "latitude", ["nm"])
    f = files.read_geojson_seq(spark, p)
    return f.select("id", F.col("properties")["nm"].alias("nm"), F.col("geometry.coordinates")[0].alias("x"))


def _landed(spark, d):
    p = _tmp(spark, "pages")
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 nations stand for a landed service
    paged.write_pages([(r.n_nationkey, {"name": r.n_name, "x": r.n_nationkey % 7, "y": r.n_regionkey}) for r in rows], spark, p, 4)
    return p


@query("s02_paged_cursor_scan", "SELECT n_nationkey AS objectid, n_name AS name FROM nation WHERE n_nationkey > 7")
def s02(spark, d):
    """Landed pages above an id cursor; pages below it aren't opened."""
    return paged.read_pages(spark, _landed(spark, d), 7).select("objectid", F.get_json_object("attributes", "$.name").alias("name"))


@query("s03_box_scan", "SELECT n_nationkey AS objectid FROM nation WHERE n_nationkey % 7 BETWEEN 2 AND 4 AND n_regionkey BETWEEN 1 AND 3")
def s03(spark, d):
    return paged.read_box(paged.read_pages(spark, _landed(spark, d)), "x", "y", (2, 1, 4, 3)).select("objectid")


@query(
    "s06_chunk_reconciliation",
    """WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 997 = 5 THEN 100000000 ELSE 0 END AS k FROM orders WHERE o_orderkey % 1009 <> 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 1013 = 8),
            j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, n FROM (SELECT DISTINCT k FROM a) a FULL JOIN (SELECT k, count(*) AS n FROM b GROUP BY 1) b ON a.k = b.k)
       SELECT * FROM (SELECT k // 5000 AS chunk, count(ak) AS expected, count(*) FILTER (bk IS NULL) AS missing, count(*) FILTER (ak IS NULL) AS extra, count(*) FILTER (coalesce(n, 1) > 1) AS repeated FROM j GROUP BY 1) WHERE missing + extra + repeated > 0""",
)
def s06(spark, d):
    """Pinned ids against a scan that lost, moved and repeated records."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    seen = o.where("k % 1009 <> 3").select((F.col("k") + F.when(F.col("k") % 997 == 5, 100_000_000).otherwise(0)).alias("k")).unionAll(o.where("k % 1013 = 8"))
    return paged.reconciled_chunks(o, seen, "k", 5000)


@query("s08_resumable_scan", "SELECT n_nationkey AS objectid, CASE WHEN n_nationkey < 12 THEN 0 ELSE 1 END AS part FROM nation")
def s08(spark, d):
    """Two overlapping partitions taken two pages at a time, each step by a scan that begins anew."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 nations stand for a landed service
    parts = [_tmp(spark, "pages"), _tmp(spark, "pages")]
    for p, some in zip(parts, ([r for r in rows if r.n_nationkey < 12], [r for r in rows if r.n_nationkey >= 8])):
        paged.write_pages([(r.n_nationkey, {"name": r.n_name}) for r in some], spark, p, 3)
    folder = _tmp(spark, "scan")
    while paged.ResumableScan(spark, folder, parts).step(2):
        pass
    return paged.ResumableScan(spark, folder, parts).records().select("objectid", "part")


@query("s04_double_pass_scan", "SELECT o_orderkey AS id, 'changed' AS change FROM orders WHERE o_orderkey % 1000 = 7")
def s04(spark, d):
    """Two passes over a service that changed between them."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    b = a.withColumn("o_totalprice", F.when(F.col("id") % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return paged.scan_changes(a, b, "id")


@query("s05_order_check", "SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p >= ts")
def s05(spark, d):
    """Records of a page that don't come after the one before."""
    return paged.out_of_order(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts").select("event_id")


@query("s07_window_union", "SELECT row_id FROM rows_igs_b11 WHERE lat BETWEEN 40 AND 45 UNION SELECT row_id FROM rows_igs_b11 WHERE lon BETWEEN -120 AND -115")
def s07(spark, d):
    """Ids of several overlapping windows, each once, without a shuffle: the windows become one condition."""
    return table(spark, d, "rows_igs_b11").where(F.col("lat").between(40, 45) | F.col("lon").between(-120, -115)).select("row_id")


@query("s12_capped_newest", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def s12(spark, d):
    return paged.newest_capped(table(spark, d, "events").select("event_id"), "event_id", 500)[0]


@query("s14_member_parse", "SELECT n_nationkey AS id, n_name AS nm FROM nation")
def s14(spark, d):
    """Members of markup files, several to a line and to a file, by patterns."""
    p = _tmp(spark, "markup")
    t = table(spark, d, "nation").select("n_regionkey", F.format_string('<m id="%d"><nm>%s</nm></m>', "n_nationkey", "n_name").alias("m"))
    t.groupBy("n_regionkey").agg(F.concat(F.lit("<f>"), F.array_join(F.collect_list("m"), "  "), F.lit("</f>")).alias("value")).select("value").write.text(p)  # five regions
    m = spark.read.text(p).select(F.explode(F.regexp_extract_all("value", F.lit(r"(<m .*?</m>)"), F.lit(1))).alias("m"))
    return m.select(F.regexp_extract("m", r'id="(\d+)"', 1).cast("int").alias("id"), F.regexp_extract("m", "<nm>([^<]*)</nm>", 1).alias("nm"))


@query("s24_user_layers", "SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) AS lon, CAST(n_regionkey AS DOUBLE) AS lat FROM nation")
def s24(spark, d):
    """Placemarks written as KML and read back."""
    p = _tmp(spark, "kml")
    t = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.struct(F.concat_ws(",", F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"), F.lit("0")).alias("coordinates")).alias("Point"))
    t.write.format("xml").option("rootTag", "Document").option("rowTag", "Placemark").save(p)
    return files.kml_points(spark, p)


@query("s33_optional_left_join", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey")
def s33(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "o_orderdate")


@query("s37_pages_to_rows", "SELECT src_key, CAST(row_number() OVER (PARTITION BY src_key ORDER BY row_id) + 4 AS INTEGER) AS pdf_page, quote AS text FROM rows_igs_b11")
def s37(spark, d):
    """Page-indexed documents with an offset, written 64 pages to a line and read as rows; no line grows with the document."""
    p = _tmp(spark, "pagetext")
    t = R.dense_rank_where(table(spark, d, "rows_igs_b11").select(F.coalesce("src_key", F.lit("")).alias("k"), "src_key", "row_id", "quote"), F.lit(True), F.col("k"), F.col("src_key").isNull(), F.col("row_id"))
    t = materialize(t, "ranked")
    first = t.groupBy("k", F.col("src_key").isNull().alias("none")).agg(F.min("rank").alias("_first"))
    t = t.withColumn("none", F.col("src_key").isNull()).join(broadcast_if_small(materialize(first, "first")), ["k", "none"]).withColumn("_n", F.col("rank") - F.col("_first"))
    lines = t.groupBy(F.col("src_key").alias("key"), (F.floor(F.col("_n") / 64) * 64).cast("int").alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "quote"))), lambda x: x["quote"]).alias("pages"))
    lines.withColumn("offset", F.lit(4)).write.option("ignoreNullFields", "false").json(p)
    return files.read_pages(spark, p)


@query("k01_canonical_json", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def k01(spark, d):
    t = table(spark, d, "nation")
    return t.select(sinks.canonical_json(t.columns).alias("line"))


@query("k02_atomic_replace", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def k02(spark, d):
    p, t = _tmp(spark, "table"), table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.replace_table(t, p)
    sinks.replace_table(t.where("n_nationkey >= 10"), p)
    return sinks.read_table(spark, p)


@query("k03_content_addressed", "SELECT n_nationkey, n_name FROM nation")
def k03(spark, d):
    """Installed twice under one digest, in another order the second time."""
    p, t = _tmp(spark, "store"), table(spark, d, "nation").select("n_nationkey", "n_name")
    a = sinks.install(t, p)
    b = sinks.install(t.orderBy(F.col("n_name").desc()), p)
    return spark.read.parquet(a).where(F.lit(a == b))


@query("k04_pointer_merge", "SELECT * FROM (VALUES ('a', 1), ('b', 3)) v(entry, version)")
def k04(spark, d):
    p = f"{_tmp(spark, 'pointer')}/latest.json"
    for key, v in (("a", 1), ("b", 2), ("b", 3)):
        doc = sinks.move_pointer(spark, p, key, {"version": v})
    return spark.createDataFrame([(k, x["version"]) for k, x in doc.items()], "entry string, version int")


@query("k06_column_packing", "SELECT r_regionkey AS part, string_agg(n_name, '/' ORDER BY n_nationkey) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def k06(spark, d):
    p = snapshot.pack_columns(table(spark, d, "nation"), [F.col("n_regionkey").alias("part")], ["n_name"], F.col("n_nationkey"))
    return p.select("part", F.array_join("n_name", "/").alias("names"))


@query("d03_dictionary_decode", "SELECT dep_id, dev_stat FROM mrds_sites WHERE dev_stat IS NOT NULL")
def d03(spark, d):
    """Status values as indexes into a dictionary, and back."""
    t = table(spark, d, "mrds_sites").where("dev_stat is not null").select("dep_id", "dev_stat")
    words = t.agg(F.array_sort(F.collect_set("dev_stat")).alias("words"))  # a handful of statuses
    coded = t.join(F.broadcast(words)).select("dep_id", "words", (F.array_position("words", F.col("dev_stat")) - 1).alias("i"))
    return snapshot.decode_dictionary(coded, "i", F.col("words"), "dev_stat").select("dep_id", "dev_stat")

