"""Projections, filters, text, date and nested functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import matching as M
from ..operators import relational as R
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

# --- projections and filters (F) -------------------------------------------------------------


@query("f01_bbox_filter", "SELECT row_id, lat, lon FROM rows_igs_b11 WHERE lat BETWEEN 42 AND 45 AND lon BETWEEN -117 AND -111")
def f01(spark, d):
    return table(spark, d, "rows_igs_b11").where(F.col("lat").between(42, 45) & F.col("lon").between(-117, -111)).select("row_id", "lat", "lon")


@query("f02_finite_coordinates", "SELECT dep_id FROM mrds_sites WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND abs(latitude) <= 90 AND abs(longitude) <= 180")
def f02(spark, d):
    from ..functions.geo import valid_point

    return table(spark, d, "mrds_sites").where(valid_point(F.col("latitude"), F.col("longitude"))).select("dep_id")


@query("f03_null_dropping_json", "SELECT dep_id, '{' || array_to_string(list_filter([CASE WHEN dev_stat IS NOT NULL THEN '\"dev_stat\":\"' || dev_stat || '\"' END, CASE WHEN score IS NOT NULL THEN '\"score\":\"' || score || '\"' END], lambda x: x IS NOT NULL), ',') || '}' AS props FROM mrds_sites")
def f03(spark, d):
    return table(spark, d, "mrds_sites").select("dep_id", F.to_json(F.struct("dev_stat", "score")).alias("props"))


@query("f05_commodity_substring", "SELECT row_id FROM rows_igs_b11 WHERE lower(commodities) LIKE '%gold%'")
def f05(spark, d):
    return table(spark, d, "rows_igs_b11").where(F.lower("commodities").contains("gold")).select("row_id")


@query("f06_thresholds", "SELECT row_id, au_opt FROM rows_igs_b11 WHERE au_opt >= 0.3")
def f06(spark, d):
    return table(spark, d, "rows_igs_b11").where("au_opt >= 0.3").select("row_id", "au_opt")


@query("f09_junk_name_filter", "SELECT dep_id FROM mrds_sites WHERE NOT regexp_matches(lower(site_name), 'unnamed|unknown|group') AND length(site_name) >= 4")
def f09(spark, d):
    return table(spark, d, "mrds_sites").where(~F.lower("site_name").rlike("unnamed|unknown|group") & (F.length("site_name") >= 4)).select("dep_id")


@query("f10_any_window", "SELECT district_id FROM districts WHERE (lat BETWEEN 35 AND 38 AND lon BETWEEN -120 AND -115) OR (lat BETWEEN 44 AND 49 AND lon BETWEEN -125 AND -116)")
def f10(spark, d):
    """Rows in any of several windows given as data."""
    wins = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("y0", "y1", "x0", "x1"), w)]) for w in ((35, 38, -120, -115), (44, 49, -125, -116))])
    hit = F.exists(wins, lambda w: F.col("lat").between(w["y0"], w["y1"]) & F.col("lon").between(w["x0"], w["x1"]))
    return table(spark, d, "districts").where(hit).select("district_id")


@query("f11_allow_list", "SELECT dev_stat, count(*) AS n FROM mrds_sites WHERE lower(trim(dev_stat)) IN ('past producer', 'producer') GROUP BY 1")
def f11(spark, d):
    return table(spark, d, "mrds_sites").where(F.lower(F.trim("dev_stat")).isin("past producer", "producer")).groupBy("dev_stat").agg(F.count(F.lit(1)).alias("n"))


@query("f13_partial_flags", "SELECT src_key, bool_or(pdf_page IS NULL) OR count(*) > 200 AS partial FROM rows_igs_b11 GROUP BY 1")
def f13(spark, d):
    return table(spark, d, "rows_igs_b11").groupBy("src_key").agg((F.bool_or(F.col("pdf_page").isNull()) | (F.count(F.lit(1)) > 200)).alias("partial"))


@query("f14_status_pattern", "SELECT dep_id, coalesce(regexp_matches(lower(dev_stat), 'producer') AND NOT regexp_matches(lower(dev_stat), 'past'), false) AS existing FROM mrds_sites")
def f14(spark, d):
    s = F.lower("dev_stat")
    return table(spark, d, "mrds_sites").select("dep_id", F.coalesce(s.rlike("producer") & ~s.rlike("past"), F.lit(False)).alias("existing"))


@query("f15_sentinel_cleanup", "SELECT row_id, CASE WHEN au_gpt <> -9999 THEN au_gpt END AS au_gpt, nullif(trim(county), '') AS county FROM rows_igs_b11")
def f15(spark, d):
    return table(spark, d, "rows_igs_b11").select("row_id", T.sentinel_null(F.col("au_gpt"), -9999.0).alias("au_gpt"), T.clean(F.col("county")).alias("county"))


@query("f17_lookback", "SELECT doc_id FROM documents WHERE published_on BETWEEN DATE '1960-01-01' - INTERVAL 365 DAY AND DATE '1960-01-01'")
def f17(spark, d):
    return table(spark, d, "documents").where(F.datediff(F.lit("1960-01-01").cast("date"), "published_on").between(0, 365)).select("doc_id")


@query("f22_fuzzy_name_lookup", "SELECT district_id, name FROM districts WHERE levenshtein(lower(name), 'alkali creek') <= 3")
def f22(spark, d):
    return table(spark, d, "districts").where(F.levenshtein(F.lower("name"), F.lit("alkali creek"), 3) >= 0).select("district_id", "name")


@query(
    "f24_site_projection",
    "SELECT dep_id, left(site_name, 160) AS nm, left(concat_ws(', ', nullif(trim(commod1), ''), nullif(trim(commod2), ''), nullif(trim(commod3), '')), 220) AS commodities FROM mrds_sites",
)
def f24(spark, d):
    coms = F.concat_ws(", ", *[T.clean(F.col(c)) for c in ("commod1", "commod2", "commod3")])
    return table(spark, d, "mrds_sites").select("dep_id", F.substring("site_name", 1, 160).alias("nm"), F.substring(coms, 1, 220).alias("commodities"))


@query("f25_flag_projection", "SELECT dep_id, regexp_matches(lower(coalesce(commod1, '')), 'gravel|stone|sand') AS aggregate FROM mrds_sites")
def f25(spark, d):
    return table(spark, d, "mrds_sites").select("dep_id", F.lower(F.coalesce("commod1", F.lit(""))).rlike("gravel|stone|sand").alias("aggregate"))


@query("f29_excerpt_accounting", "SELECT doc_id, left(text, 300) AS excerpt, greatest(length(text) - 300, 0) AS cut FROM documents WHERE text IS NOT NULL")
def f29(spark, d):
    cut = F.greatest(F.length("text") - 300, F.lit(0))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 300).alias("excerpt"), cut.cast("bigint").alias("cut"))


@query("f30_disjoint_id_ranges", "SELECT s_suppkey AS id, 'supplier' AS src FROM supplier UNION ALL SELECT c_custkey + 2000000, 'customer' FROM customer")
def f30(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src"))
    return a.unionByName(table(spark, d, "customer").select((F.col("c_custkey") + 2_000_000).alias("id"), F.lit("customer").alias("src")))


# --- text (T) -----------------------------------------------------------------------------------


def _descriptions(spark, d):
    """Land descriptions made of keys."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.format_string("T%dS R%dE, Sec %d", (F.col("p_partkey") % 30 + 1).cast("int"), (F.col("p_size") % 45 + 1).cast("int"), (F.col("p_partkey") % 36 + 1).cast("int")).alias("legal"))


@query(
    "t01_land_description",
    """SELECT p_partkey, lpad(CAST(p_partkey % 30 + 1 AS VARCHAR), 3, '0') || 'S' || lpad(CAST(p_size % 45 + 1 AS VARCHAR), 3, '0') || 'E' || lpad(CAST(p_partkey % 36 + 1 AS VARCHAR), 2, '0') AS section FROM part""",
)
def t01(spark, d):
    return _descriptions(spark, d).select("p_partkey", T.section_key(T.section_parts(F.col("legal"))).alias("section"))


@query(
    "t02_listed_sections",
    """SELECT p_partkey, array_to_string(list_distinct_sorted, ',') AS secs FROM (SELECT p_partkey, CASE WHEN a = b THEN [a] ELSE [a, b] END AS list_distinct_sorted FROM (SELECT p_partkey, p_partkey % 36 + 1 AS a, p_size % 36 + 1 AS b FROM part))""",
)
def t02(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.format_string("lots in Sec %d and %d, lode", (F.col("p_partkey") % 36 + 1).cast("int"), (F.col("p_size") % 36 + 1).cast("int")).alias("legal"))
    return p.select("p_partkey", F.array_join(T.listed_sections(F.col("legal")), ",").alias("secs"))


@query(
    "t06_canonical_name",
    r"""SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(name, '\s*\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g'), '\b(the|mine|mines|lode|claim|group)\b', ' ', 'g'), '\s+', ' ', 'g')) AS canon FROM rows_igs_b11""",
)
def t06(spark, d):
    return table(spark, d, "rows_igs_b11").select("row_id", T.canonical_name(F.col("name"), ["the", "mine", "mines", "lode", "claim", "group"]).alias("canon"))


@query("t07_base_name", r"SELECT row_id, trim(regexp_replace(regexp_replace(name, '\s*\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS base FROM rows_igs_b11")
def t07(spark, d):
    return table(spark, d, "rows_igs_b11").select("row_id", T.strip_parens(F.col("name")).alias("base"))


@query("t08_trailing_number", r"SELECT c_custkey, CAST(CAST(regexp_extract(c_name, '(\d+)\s*$', 1) AS BIGINT) AS VARCHAR) AS num FROM customer")
def t08(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.trailing_number(F.col("c_name")).alias("num"))


@query("t09_name_similarity")
def t09(spark, d):
    """Similarity of reviewed names and row names of one county that share a word (tested against difflib)."""
    from ..operators.linking import canon

    def words(name, side):
        t = table(spark, d, name).where("state is not null and county is not null").select("state", "county", F.col("name").alias(side)).distinct()
        return t.withColumn("w", F.explode(F.array_distinct(F.split(canon(F.col(side)), " "))))

    pairs = words("reviewed_grade_evidence", "a").join(words("rows_igs_b11", "b"), ["state", "county", "w"]).select("a", "b").distinct()
    return pairs.select("a", "b", F.round(T.name_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("t09_jaccard", """SELECT row_id, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS j FROM (SELECT row_id, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(quote), '[^a-z0-9]+'), lambda w: w <> '')) AS b FROM rows_igs_b11)""")
def t09b(spark, d):
    return table(spark, d, "rows_igs_b11").select("row_id", F.round(T.jaccard(T.words(F.col("name")), T.words(F.col("quote"))), 6).alias("j"))


@query("t10_first_of_patterns", "SELECT row_id, coalesce(nullif(regexp_extract(name, '“([^”]+)”', 1), ''), nullif(regexp_extract(name, '^([^,(]+),', 1), ''), trim(regexp_extract(name, '^([^(]*)', 1))) AS nm FROM rows_igs_b11")
def t10(spark, d):
    """Quoted name, else the part before a comma, else the part before a bracket."""
    g = lambda p: F.nullif(F.regexp_extract("name", p, 1), F.lit(""))
    return table(spark, d, "rows_igs_b11").select("row_id", F.coalesce(g("“([^”]+)”"), g("^([^,(]+),"), F.trim(F.regexp_extract("name", r"^([^(]*)", 1))).alias("nm"))


@query("t11_ordered_rules", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'assay') THEN 'assay' WHEN regexp_matches(lower(text), 'notice of intent|lease') THEN 'title' WHEN regexp_matches(lower(text), 'mill|plant') THEN 'works' ELSE 'other' END AS kind FROM documents")
def t11(spark, d):
    rules = [("assay", "assay"), ("title", "notice of intent|lease"), ("works", "mill|plant")]
    return table(spark, d, "documents").select("doc_id", T.first_rule(F.lower("text"), rules, "other").alias("kind"))


@query("t12_matched_terms", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), 'andesite|granite|schist|limestone|quartz'))), ',') AS terms FROM documents WHERE text IS NOT NULL")
def t12(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.matched_terms(F.col("text"), "andesite|granite|schist|limestone|quartz"), ",").alias("terms"))


@query("t13_group_code", "SELECT dep_id, CASE WHEN regexp_matches(lower(commod1), 'gold|silver') THEN 0 WHEN regexp_matches(lower(commod1), 'copper|lead|zinc') THEN 1 WHEN regexp_matches(lower(commod1), 'uranium|vanadium') THEN 2 ELSE 5 END AS g FROM mrds_sites")
def t13(spark, d):
    rules = [("0", "gold|silver"), ("1", "copper|lead|zinc"), ("2", "uranium|vanadium")]
    return table(spark, d, "mrds_sites").select("dep_id", T.first_rule(F.lower("commod1"), rules, "5").cast("int").alias("g"))


@query("t14_status_code", "SELECT dep_id, CASE lower(trim(dev_stat)) WHEN 'producer' THEN 'PR' WHEN 'past producer' THEN 'PP' WHEN 'prospect' THEN 'PS' WHEN 'occurrence' THEN 'OC' ELSE 'U' END AS code FROM mrds_sites")
def t14(spark, d):
    m = {"producer": "PR", "past producer": "PP", "prospect": "PS", "occurrence": "OC"}
    lookup = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return table(spark, d, "mrds_sites").select("dep_id", F.coalesce(F.try_element_at(lookup, F.lower(F.trim("dev_stat"))), F.lit("U")).alias("code"))


@query("t15_max_token_weight", "SELECT dep_id, CAST(greatest(CASE WHEN regexp_matches(lower(commod1), '(^|[^a-z])gold($|[^a-z])') THEN 3.0 ELSE 0.0 END, CASE WHEN regexp_matches(lower(commod1), '(^|[^a-z])silver($|[^a-z])') THEN 2.0 ELSE 0.0 END, CASE WHEN regexp_matches(lower(commod1), '(^|[^a-z])lead($|[^a-z])') THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS w FROM mrds_sites WHERE commod1 IS NOT NULL")
def t15(spark, d):
    return table(spark, d, "mrds_sites").where("commod1 is not null").select("dep_id", T.max_token_weight(F.col("commod1"), {"gold": 3.0, "silver": 2.0, "lead": 1.0}).alias("w"))


@query("t16_quote_on_page")
def t16(spark, d):
    """Score of each eval item on the documents that share any run of four words with it (tested against brute force)."""
    return M.quotes_in_texts(table(spark, d, "eval_items"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text")


@query("t18_weighted_terms", "SELECT doc_id, CAST(2.0 * len(regexp_extract_all(text, 'assay')) + 1.5 * len(regexp_extract_all(text, 'ounces')) + 1.0 * len(regexp_extract_all(text, 'per cent')) AS DOUBLE) AS score FROM documents WHERE text IS NOT NULL")
def t18(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.weighted_count(F.col("text"), {"assay": 2.0, "ounces": 1.5, "per cent": 1.0}).alias("score"))


@query("t19_scale_parse", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 1000 + 10000 END AS scale FROM part")
def t19(spark, d):
    n = F.format_number(F.col("p_size") * 1000 + 10_000, 0)
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "Map, scale not given").otherwise(F.concat(F.lit("Geologic map, scale 1:"), n, F.lit(", in colour"))).alias("ref"))
    return p.select("p_partkey", T.scale_denominator(F.col("ref")).alias("scale"))


@query("t22_tonnage_text", r"SELECT row_id, CAST(replace(nullif(regexp_extract(tonnage, '(\d[\d,]*)\s*(?:-ton|tons?\b|t\.)', 1), ''), ',', '') AS DOUBLE) AS tons FROM rows_igs_b11")
def t22(spark, d):
    s = F.nullif(F.regexp_extract("tonnage", r"(\d[\d,]*)\s*(?:-ton|tons?\b|t\.)", 1), F.lit(""))
    return table(spark, d, "rows_igs_b11").select("row_id", F.regexp_replace(s, ",", "").cast("double").alias("tons"))


@query("t23_slug", r"SELECT mine_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM reviewed_grade_evidence")
def t23(spark, d):
    return table(spark, d, "reviewed_grade_evidence").select("mine_id", T.slug(F.col("name")).alias("slug"))


@query("t25_url_prefill", "SELECT n_nationkey, 'https://example.org/find?q=' || replace(n_name, ' ', '%20') AS url FROM nation")
def t25(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("https://example.org/find?q="), T.encode_url(F.col("n_name"))).alias("url"))


@query("t27_source_hash", "SELECT src_key, left(sha256(title), 16) AS h FROM source_list")
def t27(spark, d):
    return table(spark, d, "source_list").select("src_key", F.substring(F.sha2("title", 256), 1, 16).alias("h"))


@query("t28_serial_normal", r"SELECT DISTINCT upper(regexp_replace(src_key, '\s+', '', 'g')) AS s FROM rows_igs_b11")
def t28(spark, d):
    return table(spark, d, "rows_igs_b11").select(F.upper(F.regexp_replace("src_key", r"\s+", "")).alias("s")).distinct()


@query("t31_explanation", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN n >= 5 THEN n || ' orders' END, CASE WHEN t >= 500000 THEN 'over half a million' END], lambda x: x IS NOT NULL), '; ') AS why FROM (SELECT o_custkey AS c_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1)")
def t31(spark, d):
    """Sentences for the terms that count, the others left out."""
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    why = F.array_compact(F.array(F.when(F.col("n") >= 5, F.concat("n", F.lit(" orders"))), F.when(F.col("t") >= 500_000, "over half a million")))
    return g.select("c_custkey", F.array_join(why, "; ").alias("why"))


@query("v10_safe_ids")
def v10(spark, d):
    """53-bit ids of source keys, and whether another key has the same one (ids tested against hashlib)."""
    t = table(spark, d, "rows_igs_b11").where("src_key is not null").select("src_key").distinct().withColumn("id", T.safe_id(F.col("src_key")))
    return t.join(t.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("collides")), "id").select("src_key", "id", "collides")


# --- dates (X) ---------------------------------------------------------------------------------------


@query("x01_multi_format_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders")
def x01(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, F.date_format("t", "yyyy-MM-dd")).when(k == 1, F.date_format("t", "M/d/yyyy")).when(k == 2, F.date_format("t", "d MMM yyyy")).when(k == 3, F.date_format("t", "MMMM d, yyyy")).otherwise(F.concat(F.lit("recorded "), F.date_format("t", "yyyy-MM-dd"), F.lit(" in book 2")))
    return o.select("o_orderkey", D.parse_date(s).cast("string").alias("d"))


@query("x02_epoch_millis", "SELECT o_orderkey, CAST(CAST(make_timestamp_ms(epoch_ms(CAST(o_orderdate AS TIMESTAMP)) - o_orderkey * 123456789) AS DATE) AS VARCHAR) AS d FROM orders")
def x02(spark, d):
    """Milliseconds before and after 1970 to dates."""
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) - F.col("o_orderkey") * 123_456_789
    return table(spark, d, "orders").select("o_orderkey", D.epoch_date(ms).cast("string").alias("d"))


@query("x05_deadline_window", "SELECT o_orderkey FROM orders WHERE date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE) + INTERVAL 45 DAY) BETWEEN -5 AND 45")
def x05(spark, d):
    due = F.date_add(F.col("o_orderdate").cast("date"), 45)
    return table(spark, d, "orders").where(D.within_days(due, F.lit("1998-01-01").cast("date"), 5, 45)).select("o_orderkey")


@query("x06_last_year", r"SELECT row_id, CAST(list_last(regexp_extract_all(years, '(1[5-9]\d\d|20\d\d)')) AS INTEGER) AS y FROM rows_igs_b11 WHERE years IS NOT NULL")
def x06(spark, d):
    return table(spark, d, "rows_igs_b11").where("years is not null").select("row_id", D.last_year(F.col("years")).alias("y"))


@query("x08_as_of", "SELECT greatest((SELECT max(extracted_at) FROM rows_igs_b11), (SELECT max(ingested_at) FROM documents)) AS as_of")
def x08(spark, d):
    a = table(spark, d, "rows_igs_b11").agg(F.max("extracted_at").alias("t"))
    return a.unionByName(table(spark, d, "documents").agg(F.max("ingested_at").alias("t"))).agg(F.max("t").alias("as_of"))


# --- nested values (N) --------------------------------------------------------------------------------


@query("n01_columns_to_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def n01(spark, d):
    """Rows packed column-wise, one record for each thousand keys, and unpacked again."""
    from ..sources.snapshot import pack_columns, unpack_columns

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return unpack_columns(pack_columns(o, [(F.col("o_orderkey") / 1000).cast("bigint").alias("part")], ["o_orderkey", "o_custkey", "o_totalprice"], F.col("o_orderkey")), ["o_orderkey", "o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("n04_canonical_hash", """SELECT n_nationkey, sha256('{"k":' || n_nationkey || ',"n":"' || n_name || '"}') AS h FROM nation""")
def n04(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))), 256).alias("h"))


@query("n05_nested_rounding", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE), 2) AS DECIMAL(8, 2))), ',') AS v FROM embeddings")
def n05(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 2).cast("decimal(8,2)").cast("string")), ",").alias("v"))


@query("n06_typed_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def n06(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "n07_bounded_references",
    """WITH r AS (SELECT src_key, row_id, row_number() OVER (PARTITION BY src_key ORDER BY row_id) AS r, CAST('0x' || substr(sha256(CAST(row_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM rows_igs_b11)
       SELECT src_key, count(*) AS n, string_agg(row_id, ',' ORDER BY row_id) FILTER (r <= 19) AS head, CASE WHEN count(*) > 19 THEN CAST(sum(h) AS VARCHAR) END AS rest FROM r GROUP BY 1""",
)
def n07(spark, d):
    """The first 19 ids of each source and a sum of hashes for all of them: no list grows with the source."""
    t = table(spark, d, "rows_igs_b11").select(F.coalesce("src_key", F.lit("\x00")).alias("src_key"), "row_id")
    h = F.conv(F.substring(F.sha2(F.col("row_id").cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    all_ = t.groupBy("src_key").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("h"))
    head = R.capped_list(t, ["src_key"], F.col("row_id"), F.col("row_id"), 19, "head")
    out = all_.join(head, "src_key").select(F.nullif("src_key", F.lit("\x00")).alias("src_key"), "n", F.array_join("head", ",").alias("head"), F.when(F.col("n") > 19, F.col("h")).alias("rest"))
    return out


@query("n08_tagged_append_remove", "SELECT district_id, len(list_filter(coalesce(commodities, []), lambda x: x <> 'Gold')) + 1 AS n FROM districts")
def n08(spark, d):
    c = F.filter(F.coalesce("commodities", F.array().cast("array<string>")), lambda x: x != "Gold")
    return table(spark, d, "districts").select("district_id", F.size(F.array_append(c, F.lit("tag"))).cast("bigint").alias("n"))


@query("n09_sequence_equality", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING list_sort(list(l_linenumber)) = list_transform(range(1, count(*) + 1), lambda x: CAST(x AS INTEGER))")
def n09(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    return g.where(F.col("v") == F.sequence(F.lit(1), F.size("v"))).select("l_orderkey")


@query("n10_fill_gaps_merge", "SELECT dep_id, coalesce(nullif(trim(county), ''), 'unknown') AS county, coalesce(dev_stat, score, '-') AS s FROM mrds_sites")
def n10(spark, d):
    return table(spark, d, "mrds_sites").select("dep_id", F.coalesce(T.clean(F.col("county")), F.lit("unknown")).alias("county"), F.coalesce("dev_stat", "score", F.lit("-")).alias("s"))


@query("n12_overlay_by_id", "SELECT c_custkey, coalesce(s.s_acctbal, c.c_acctbal) AS bal FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def n12(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return table(spark, d, "customer").join(s, "c_custkey", "left").select("c_custkey", F.coalesce("s_acctbal", "c_acctbal").alias("bal"))
