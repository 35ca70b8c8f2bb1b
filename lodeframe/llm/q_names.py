"""Problems 1 and 3: records of the same mine across sources, and typed variants of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.states import state_code
from ..session import at_once, broadcast_if_small, materialize
from . import entities, matching, names

def rows_part(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    return spark.read.parquet(f"{d}/rows_igs_b11.parquet").select(
        F.lit("rows").alias("src"), F.col("row_id").cast("string").alias("id"), "name", F.col("keys").alias("further"), "state", "county", "district", "lat", "lon", *more
    )


def reviewed_part(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    return spark.read.parquet(f"{d}/reviewed_grade_evidence.parquet").select(
        F.lit("reviewed").alias("src"), F.col("mine_id").alias("id"), "name", none.cast("array<string>").alias("further"), "state", "county", "district",
        none.cast("double").alias("lat"), none.cast("double").alias("lon"),
    )


def sites_part(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    return spark.read.parquet(f"{d}/mrds_sites.parquet").select(
        F.lit("sites").alias("src"), F.col("dep_id").cast("string").alias("id"), F.col("site_name").alias("name"), none.cast("array<string>").alias("further"),
        F.coalesce(state_code(F.col("state")), F.upper(F.trim("state"))).alias("state"), "county", none.cast("string").alias("district"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the reviewed records of the same mine."""
    rec = entities.resolve_records([rows_part(spark, d), reviewed_part(spark, d)])
    rows = rec.where("src = 'rows'").select("entity", F.col("id").cast("bigint").alias("row_id"))
    reviewed = rec.where("src = 'reviewed'").select("entity", F.col("id").alias("mine_id"))
    return rows.join(reviewed, "entity").select("row_id", "mine_id")


#: Log-odds of a pair of equal names in one state, and what another name, counties, points and districts add.
PRIOR, NAME_SLIP, SAME_COUNTY, OTHER_COUNTY, NEAR, FAR = -0.5, -6.0, 4.0, -3.0, 6.0, -2.5
#: What the middle of the entity's district adds where its own records have no point: within 30 km, beyond 90 km.
IN_DISTRICT, OUT_OF_DISTRICT = 1.0, -1.0


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every row with every site that may be the same mine, and the marginal probability.

    Candidates are sites of the state with the row's name, unless both the county and
    the place say otherwise, and those with a name a letter away in one county or spot;
    all come out, whatever the probability. Rows or sites without a name or state have none.
    """
    rec = entities.resolve_records([rows_part(spark, d), sites_part(spark, d)])
    rec = materialize(rec.select("src", "id", "county", "district", "lat", "lon", "entity"), "records")
    # an entity is "state|county or ?|name"
    state, place, main = (F.split_part("entity", F.lit("|"), F.lit(i)).alias(n) for i, n in ((1, "state"), (2, "place"), (3, "main")))
    rows, sites = rec.where("src = 'rows'"), rec.where("src = 'sites'").select("id", "county", "lat", "lon", state, main)
    y, x = F.round("lat", 2).alias("_y"), F.round("lon", 2).alias("_x")
    spots = rows.groupBy("entity", "district", y, x).agg(F.count("lat").alias("_n"), F.count(F.lit(1)).alias("_all"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
    spots = materialize(spots.withColumn("state", state), "spots")
    left = _fullest(spots, ["entity"]).select("entity", F.col("clat").alias("ulat"), F.col("clon").alias("ulon"), state, F.nullif(place, F.lit("?")).alias("place"), main)
    named = spots.where("district is not null")
    mostly = named.groupBy("entity", "district").agg(F.sum("_all").alias("_n")).groupBy("entity").agg(F.max_by("district", F.struct("_n", "district")).alias("district"))
    middle = _fullest(named, ["state", "district"]).select("state", "district", F.col("clat").alias("dlat"), F.col("clon").alias("dlon"))
    left_ = left.join(mostly, "entity", "left").join(broadcast_if_small(materialize(middle, "middle"), limit=1 << 20), ["state", "district"], "left")
    # entries of one site: of a county, or of a spot where none is given
    spot = F.concat_ws(",", F.round("lat", 1), F.round("lon", 1))
    sites = sites.withColumn("vkey", F.concat_ws("|", "state", "main", F.coalesce("county", F.when(F.col("lat").isNotNull(), F.concat(F.lit("@"), spot)), F.concat(F.lit("#"), F.col("id")))))
    right_ = entities.centres(sites, ["vkey", "state", "main", "county"]).withColumnsRenamed({"clat": "vlat", "clon": "vlon"})
    left, right = at_once(lambda: materialize(left_, "left"), lambda: materialize(right_, "right"))
    # spots without a county that lie at a site of a county are entries of that site
    host = right.where("county is not null").select("state", "main", F.col("vkey").alias("_host"), F.col("vlat").alias("_hlat"), F.col("vlon").alias("_hlon"))
    bare = right.where("county is null and vlat is not null").select("vkey", "state", "main", "vlat", "vlon").join(host, ["state", "main"])
    near = geo.haversine_m(F.col("vlat"), F.col("vlon"), F.col("_hlat"), F.col("_hlon"))
    hosts = bare.where(near <= 3000).groupBy("vkey").agg(F.min_by("_host", near).alias("_host"))
    lone, twins = at_once(lambda: materialize(hosts, "lone"), lambda: _twins(left.select("main"), right.select("main")))
    pairs = left.join(right, ["state", "main"]).withColumn("_name", F.lit(0.0))
    close = left.join(broadcast_if_small(twins, limit=1 << 20), "main").drop("main").withColumnRenamed("twin", "main").join(right, ["state", "main"]).withColumn("_name", F.lit(NAME_SLIP))
    km = geo.haversine_m(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon")) / 1000
    off = geo.haversine_m(F.col("dlat"), F.col("dlon"), F.col("vlat"), F.col("vlon")) / 1000
    logit = (
        PRIOR
        + F.col("_name")
        + F.when(F.col("county").isNull() | F.col("place").isNull(), 0.0).when(F.col("county") == F.col("place"), SAME_COUNTY).otherwise(OTHER_COUNTY)
        + F.coalesce(F.when(km <= 3, NEAR).when(km >= 20, FAR).when(km.isNotNull(), 0.0).when(off <= 30, IN_DISTRICT).when(off >= 90, OUT_OF_DISTRICT), F.lit(0.0))
    )
    hosted = lambda df: df.join(broadcast_if_small(lone, limit=1 << 20), "vkey", "left").withColumn("site", F.coalesce("_host", "vkey"))
    # no candidates: counties that differ and centres a district apart; of names a letter apart, all without the county or the spot in common
    apart = F.coalesce((F.col("county") != F.col("place")) & (km >= 20), F.lit(False))
    shared = F.coalesce(F.col("county") == F.col("place"), F.lit(False)) | F.coalesce(km <= 3, F.lit(False))
    both = pairs.where(~apart).unionByName(close.where(shared))
    edges = hosted(both.select("entity", "vkey", logit.alias("logit"))).groupBy("entity", "site").agg(F.max("logit").alias("logit"))
    found = matching.belief_propagation(edges, "entity", "site", "logit")
    members = hosted(sites.select("vkey", F.col("id").cast("bigint").alias("dep_id")))
    # entities with their sites: rows meet them by a size-checked broadcast, else by a shuffle
    linked = materialize(found.join(members.select("site", "dep_id"), "site").select("entity", "dep_id", "p"), "linked")
    return _rows_of(rows, linked).select("row_id", "dep_id", "p")


def _rows_of(rows: DataFrame, linked: DataFrame) -> DataFrame:
    return rows.select("entity", F.col("id").cast("bigint").alias("row_id")).join(broadcast_if_small(linked, limit=2 << 20), "entity")


def _fullest(spots: DataFrame, keys: list[str]) -> DataFrame:
    """Centre of the fullest spot of each key, from counted spots."""
    s = spots.groupBy(*keys, "_y", "_x").agg(F.sum("_n").alias("_n"), F.max("_lat").alias("_lat"), F.max("_lon").alias("_lon"))
    most = F.struct("_n", "_y", "_x")
    return s.groupBy(*keys).agg(F.max_by("_lat", most).alias("clat"), F.max_by("_lon", most).alias("clon"))


def _twins(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different names of the two sides a letter apart, of one number: (main, twin)."""
    part = lambda df: df.distinct().select(F.split_part("main", F.lit("#"), F.lit(1)).alias("w"), F.split_part("main", F.lit("#"), F.lit(2)).alias("num"))
    near = lambda df, typed: names._long_rows(part(df).where(F.length("w") >= 4), "w", lambda s: names.near_keys(s, 1, typed), "_k")
    pairs = near(left, True).join(near(right, False).withColumnRenamed("w", "w2"), ["num", "_k"]).where("w <> w2").select("w", "w2", "num").distinct()
    pairs = pairs.where((F.levenshtein("w", "w2", 1) >= 0) | (F.length("w") == F.length("w2")) & (F.array_sort(F.split("w", "")) == F.array_sort(F.split("w2", ""))) & (F.levenshtein("w", "w2", 2) >= 0))
    return materialize(pairs.select(F.concat_ws("#", "w", "num").alias("main"), F.concat_ws("#", "w2", "num").alias("twin")), "twins")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows and sites of the same mine, at a marginal probability of one half or more."""
    return p1_matches(spark, d).where("p >= 0.5").select("row_id", "dep_id")


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p3_found": p3_found}
ORACLE: dict[str, str] = {}
