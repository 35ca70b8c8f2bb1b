"""Problem 4: typed commodities mapped to commodity_ref."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canonical

# Trade names that the reference list lacks.
MORE_NAMES = {"chrome": "CR", "heavy spar": "BA", "pumicite": "PUM", "s & g": "SDG", "moly": "MO", "gyp": "GYP"}


#: Most entries of a reference list that is held as a trie by every task.
REFERENCE_ROWS = 100_000


def reference_names(spark: SparkSession, d: str, more: dict[str, str] = MORE_NAMES) -> list[tuple[str, int]]:
    """(name, commodity_id) of all names, codes and aliases, and of ``more`` names by code. A list beyond REFERENCE_ROWS is refused."""
    ref = spark.read.parquet(f"{d}/commodity_ref.parquet")
    if (n := ref.count()) > REFERENCE_ROWS:
        raise ValueError(f"a reference list of {n} entries is too long to be held by every task")
    names = ref.select("commodity_id", "code", F.explode(F.concat(F.array("canonical_name", "code"), F.coalesce("also_known_as", F.array()))).alias("name"))
    rows = names.where("name is not null").collect()
    by_code = {r.code: r.commodity_id for r in rows}
    return [(r.name, r.commodity_id) for r in rows] + [(n, by_code[c]) for n, c in more.items() if c in by_code]


def _lists(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/rows_igs_b11.parquet").select(F.lit("rows_igs_b11").alias("source_table"), F.col("row_id").alias("record_id"), "commodities")
    dist = spark.read.parquet(f"{d}/districts.parquet").select(
        F.lit("districts").alias("source_table"), F.col("district_id").cast("bigint").alias("record_id"), F.array_join("commodities", "\n").alias("commodities")
    )
    return rows.unionByName(dist)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with the commodities they list; 0 for entries without a match."""
    ids = canonical.typed_ids(F.col("commodities"), reference_names(spark, d))
    return _lists(spark, d).select("source_table", "record_id", F.explode(ids).alias("commodity_id"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Entries that match nothing, with the number of times they are typed."""
    bad = canonical.unmatched_entries(F.col("commodities"), reference_names(spark, d))
    return _lists(spark, d).select(F.explode(bad).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p4_found": p4_found, "p4_unmatched": p4_unmatched}

_PLAIN = "regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({0})), '\\([^)]*\\)?', ' ', 'g'), '\\s*[&/]\\s*', ' and ', 'g'), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')), '^[\\s.?*!:''\"-]+', ''), '[\\s.?*!:''\"-]+$', '')"

_WITH = f"""WITH raw AS (
          SELECT 'rows_igs_b11' AS source_table, row_id AS record_id,
                 unnest(string_split_regex(replace(replace(commodities, ' / ', ' , '), ' + ', ' , '), '[,;|\\n\\r\\t]')) AS e FROM rows_igs_b11
          UNION ALL
          SELECT 'districts', CAST(district_id AS BIGINT), unnest(commodities) FROM districts),
        entries AS (SELECT source_table, record_id, {_PLAIN.format('e')} AS w, trim(e) AS e FROM raw WHERE trim(e, ' \\n\\t') <> '' AND e IS NOT NULL),
        names AS (
          SELECT DISTINCT commodity_id, {_PLAIN.format('n')} AS n FROM (
            SELECT commodity_id, unnest(list_concat([canonical_name, code], coalesce(also_known_as, []))) AS n FROM commodity_ref
            UNION ALL SELECT c.commodity_id, v.n FROM (VALUES {", ".join(f"('{n}', '{c}')" for n, c in MORE_NAMES.items())}) v(n, c) JOIN commodity_ref c ON c.code = v.c)),
        words AS (SELECT DISTINCT w FROM entries),
        dist AS (SELECT w, commodity_id, min(damerau_levenshtein(w, n)) AS k FROM words, names
                 WHERE w <> '' AND damerau_levenshtein(w, n) <= CASE WHEN length(n) <= 3 THEN 0 WHEN length(n) <= 8 THEN 1 ELSE 2 END GROUP BY 1, 2),
        near AS (SELECT w, commodity_id FROM (SELECT *, min(k) OVER (PARTITION BY w) AS m FROM dist) WHERE k = m),
        starts AS (SELECT w, min(commodity_id) AS commodity_id FROM words, names
                   WHERE length(w) >= 3 AND starts_with(n, w) AND w NOT IN (SELECT w FROM dist) GROUP BY 1 HAVING count(DISTINCT commodity_id) = 1),
        hit AS (SELECT * FROM near UNION ALL SELECT * FROM starts)"""

ORACLE = {
    "p4_found": f"""{_WITH}
        SELECT DISTINCT source_table, record_id, coalesce(commodity_id, 0) AS commodity_id FROM entries LEFT JOIN hit USING (w)""",
    "p4_unmatched": f"""{_WITH}
        SELECT CASE WHEN w = '' THEN e ELSE w END AS entry, count(*) AS n FROM entries WHERE w NOT IN (SELECT w FROM hit) GROUP BY 1""",
}
