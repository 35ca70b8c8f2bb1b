"""Records placed and matched by canonical name, in stages: county, further names, district, distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_point

# Words that a mine's canonical name leaves out.
STOP = "the mine mines mining claim claims group lode placer prospect property tunnel shaft".split()


def canon(c: Column) -> Column:
    """A mine's name in lower-case letters: notes in brackets, numbers and words of its kind left out."""
    s = F.regexp_replace(F.lower(c), r"\s*\([^)]*\)", "")
    s = F.regexp_replace(s, rf"\b({'|'.join(STOP)}|no\.?\s*\d+|#\s*\d+|\d+)\b", " ")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z ]+", " "), " +", " ")), F.lit(""))


def place(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _clustered(hits: DataFrame, keys: list[str], span: float) -> DataFrame:
    """Sites of each key as one place if they lie within ``span`` degrees: the point and id of the least id."""
    first = F.struct("dep")
    near = (F.max("sy") - F.min("sy") < span) & (F.max("sx") - F.min("sx") < span)
    return hits.groupBy(*keys).agg(near.alias("_ok"), F.min_by("sx", first).alias("x"), F.min_by("sy", first).alias("y"), F.min("dep").alias("dep")).where("_ok").drop("_ok")


def word_runs(c: Column, most: int) -> Column:
    """All runs of up to ``most`` words of a text, as texts."""
    w = F.split(c, " ")

    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(of, range(1, most + 1)))))


def locate_by_name(rows: DataFrame, sites: DataFrame, anchors: DataFrame, span: float = 0.05, most_words: int = 5) -> DataFrame:
    """Points for rows without one, from named sites: (row, x, y, dep, stage).

    ``rows``: row, state, county, district, name, further, excl, x, y; ``sites``: dep, state, county, name,
    sx, sy; ``anchors``: state, county, district, ax, ay. Stages: 0 the row's own point; 1 sites with its canonical name in
    its county (or with no county on either side) if they lie together; 2 sites whose name has
    a further name of the row as whole words of up to ``most_words``, none of the excluded ones; 3 the middle of
    two anchors or more of its district. Nothing is made up: what no stage places comes out with nulls.
    Names are joined once each, not once a row, so a name on a third of the rows costs no more than others.
    """
    r = rows.select("row", "state", place(F.col("county")).alias("county"), canon(F.col("name")).alias("k"), canon(F.regexp_replace("district", r"\(.*$", "")).alias("dk"), "further", "excl", "x", "y")
    s = sites.where(valid_point(F.col("sy"), F.col("sx"))).select("dep", "state", place(F.col("county")).alias("sc"), canon(F.col("name")).alias("k"), "sx", "sy").where("k is not null")
    open_ = r.where("x is null or y is null")
    same = F.col("county").isNull() | F.col("sc").isNull() | (F.col("county") == F.col("sc"))
    asked = open_.where("k is not null").select("state", "county", "k").distinct()
    one = _clustered(asked.join(s, ["state", "k"]).where(same).withColumn("_c", F.coalesce("county", F.lit(""))), ["state", "_c", "k"], span)
    far = open_.select("row", "state", F.coalesce("county", F.lit("")).alias("_c"), "county", "k", F.posexplode("further").alias("pos", "key"), "excl").withColumn("key", canon(F.col("key"))).where("key is not null")
    bars = F.coalesce(F.array_sort(F.array_distinct(F.filter("excl", lambda e: e.isNotNull() & (e != "")))), F.array().cast("array<string>"))
    far = far.withColumn("_bars", F.transform(bars, lambda e: F.lower(e)))
    posted = s.select("state", "sc", "sx", "sy", "dep", F.col("k").alias("nm"), F.explode(word_runs(F.col("k"), most_words)).alias("key"))
    wanted = far.select("state", "_c", "county", "key", "_bars").distinct()
    free = ~F.exists("_bars", lambda e: F.col("nm").contains(e))
    two = _clustered(wanted.join(posted, ["state", "key"]).where(same & free), ["state", "_c", "key", "_bars"], span)
    two = far.join(two, ["state", "_c", "key", "_bars"]).groupBy("row").agg(F.min_by(F.struct("x", "y", "dep"), "pos").alias("_two"))
    a = anchors.select("state", place(F.col("county")).alias("sc"), canon(F.regexp_replace("district", r"\(.*$", "")).alias("dk"), "ax", "ay").where(valid_point(F.col("ay"), F.col("ax")) & F.col("dk").isNotNull())
    homes = open_.where("dk is not null").select("state", "county", "dk").distinct().join(a, ["state", "dk"]).where(same).withColumn("_c", F.coalesce("county", F.lit("")))
    middle = lambda c: F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})")  # noqa: E731 - the upper of two middle ones
    three = homes.groupBy("state", "_c", "dk").agg(middle("ax").alias("_tx"), middle("ay").alias("_ty"), F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    out = r.withColumn("_c", F.coalesce("county", F.lit(""))).withColumnsRenamed({"x": "_x", "y": "_y"})
    out = out.join(one, ["state", "_c", "k"], "left").join(two, "row", "left").join(three, ["state", "_c", "dk"], "left")
    stage = F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), 0).when(F.col("x").isNotNull(), 1).when(F.col("_two").isNotNull(), 2).when(F.col("_tx").isNotNull(), 3)
    by = lambda own, a1, a2, a3: F.when(stage == 0, own).when(stage == 1, a1).when(stage == 2, a2).when(stage == 3, a3)
    nothing = F.lit(None)
    return out.select("row", by(F.col("_x"), F.col("x"), F.col("_two.x"), F.col("_tx")).alias("x"), by(F.col("_y"), F.col("y"), F.col("_two.y"), F.col("_ty")).alias("y"), by(nothing, F.col("dep"), F.col("_two.dep"), nothing).alias("dep"), stage.alias("stage"))


def match_existing(new: DataFrame, existing: DataFrame, km: float = 15.0) -> DataFrame:
    """The first existing record of each new one: (id, match, by), by 'name' or 'alias'.

    ``new``: id, state, county, name, further, x, y; ``existing``: eid, state, county, name, ex, ey. Names are compared in canonical
    form. Counties must not differ; where one is unknown and both have points, they must
    lie within ``km`` in the plane. Where no name matches, further names are tried by turns, by county alone. The
    least id is first. Records with one name, county and point are matched once for all.
    """
    e = existing.select("eid", "state", place(F.col("county")).alias("ec"), canon(F.col("name")).alias("k"), "ex", "ey").where("k is not null")
    e = e.groupBy("state", "ec", "k", "ex", "ey").agg(F.min("eid").alias("eid"))
    n = new.select("id", "state", place(F.col("county")).alias("c"), canon(F.col("name")).alias("k"), "further", "x", "y")
    asked = n.where("k is not null").select("state", "c", "k", "x", "y").distinct()
    agree = F.col("c").isNull() | F.col("ec").isNull() | (F.col("c") == F.col("ec"))
    off = F.hypot((F.col("ex") - F.col("x")) * 111.32 * F.cos(F.radians("y")), (F.col("ey") - F.col("y")) * 111.32)
    near = (F.col("c").isNotNull() & F.col("ec").isNotNull()) | F.coalesce(off <= km, F.lit(True))
    named = asked.join(e, ["state", "k"]).where(agree & near).groupBy("state", "c", "k", "x", "y").agg(F.min("eid").alias("_m"))
    safe = lambda df: df.withColumns({"_c": F.coalesce("c", F.lit("")), "_xy": F.concat_ws(",", "x", "y")})
    n = safe(n).join(safe(named).select("state", "_c", "k", "_xy", "_m"), ["state", "_c", "k", "_xy"], "left")
    tried = n.where("_m is null").select("id", "state", "c", "_c", F.col("k").alias("_own"), F.posexplode("further").alias("pos", "alias")).withColumn("k", canon(F.col("alias"))).where(F.col("k").isNotNull() & ~F.col("k").eqNullSafe(F.col("_own")))
    least = e.groupBy("state", "ec", "k").agg(F.min("eid").alias("eid"))
    other = tried.select("state", "c", "_c", "k").distinct().join(least, ["state", "k"]).where(agree).groupBy("state", "_c", "k").agg(F.min("eid").alias("_a"))
    other = tried.join(other, ["state", "_c", "k"]).groupBy("id").agg(F.min_by("_a", "pos").alias("_a"))
    out = n.join(other, "id", "left")
    return out.select("id", F.coalesce("_m", "_a").alias("match"), F.when(F.col("_m").isNotNull(), "name").when(F.col("_a").isNotNull(), "alias").alias("by"))


def merge_districts(items: DataFrame, span: float = 0.35) -> DataFrame:
    """Near-duplicate districts merged: (state, name, n, lon, lat), ``n`` summed and the centre weighted by it.

    ``items``: state, name, n, lon, lat, one row a district. By falling n (ties by name), an item joins
    the one of its canonical name, else the first so far whose name contains its own or is contained in it, within
    ``span`` degrees on both axes. The order matters, so a state's districts, of which there are thousands at most, are taken in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, list] = {}
        for r in pdf.sort_values(["n", "name"], ascending=[False, True]).itertuples(index=False):
            key = r.k or ""
            home = key if key in kept else next((k for k, m in kept.items() if k and key and (k in key or key in k) and abs(m[2] - r.lon) < span and abs(m[3] - r.lat) < span), None)
            if home is None:
                kept[key] = [r.name, r.n, r.lon, r.lat]
            else:
                m = kept[home]
                total = m[1] + r.n
                m[1:] = [total, round((m[2] * m[1] + r.lon * r.n) / total, 4), round((m[3] * m[1] + r.lat * r.n) / total, 4)]
        return pd.DataFrame([(pdf["state"].iloc[0], *m) for m in kept.values()], columns=["state", "name", "n", "lon", "lat"])

    src = items.where("state is not null and n > 0 and lon is not null and lat is not null").select("state", "name", canon(F.col("name")).alias("k"), F.col("n").cast("bigint").alias("n"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    return src.groupBy("state").applyInPandas(run, "state string, name string, n bigint, lon double, lat double")
