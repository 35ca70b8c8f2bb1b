"""Records of several sources, known by typed names and places, resolved to entities.

An entity is a name (tokens and number) in one county of one state. The names
and places that the data supports are learnt from all records (counts by equi-join
on delete keys); typed ones are resolved to them. A record whose county is absent
or mistaken is placed by its district, its point and the weight of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import at_once, broadcast_if_small, materialize
from . import names as N

#: Names travel to Python and back as one string a record: lists of strings would be converted row by row.
_SEP, _PART = "\x1f", "\x1e"


def _text(words: tuple[str, ...], num: int) -> str:
    return " ".join(words) + f"#{num}"


def parse_names(name: Column, further: Column) -> Column:
    """Column of parsed names: alternatives of a name, then of an array of further names, as "tokens#number".

    A further name that is an earlier one without its spaces is dropped.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[str, str] = {}

        def one(s: str) -> str:
            m = memo.get(s)
            if m is None:
                if len(memo) > 100_000:
                    memo.clear()
                m = memo[s] = _SEP.join(_text(*x) for x in N.parse(s))
            return m

        def also(ks: str) -> str:
            out = memo.get(_PART + ks)
            if out is None:
                got: dict[str, str] = {}
                for k in ks.split(_SEP):
                    if k:
                        for y in one(k).split(_SEP):
                            got.setdefault(y.replace(" ", ""), y)
                out = memo[_PART + ks] = _SEP.join(y for y in got.values() if y)
            return out

        for a, b in parts:
            yield pd.Series([(one(x) if x else "") + _PART + (also(ks) if ks else "") for x, ks in zip(a, b)])

    return run(name, F.array_join(further, _SEP))


def _listed(parsed: DataFrame) -> DataFrame:
    """The parsed names of distinct ``names`` one by one: (names, part, pos, words, num, stems, n).

    ``part`` is 0 for alternatives of the name and 1 for further names; ``n`` counts
    the records, once for each spelling.
    """

    kinds = {"names": pa.string(), "part": pa.int32(), "pos": pa.int32(), "words": pa.string(), "num": pa.string(), "stems": pa.string(), "n": pa.int64()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = []
            for names, n in zip(*(batch.column(c).to_pylist() for c in ("names", "n"))):
                seen = set()
                for part, text in enumerate(names.split(_PART)):
                    for pos, p in enumerate(text.split(_SEP)):
                        if p:
                            words, _, num = p.rpartition("#")
                            out.append((names, part, pos, words, num, " ".join(sorted(map(N.stem, words.split(" ")))), 0 if p in seen else n))
                            seen.add(p)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * len(kinds), kinds.values())], list(kinds))

    counted = parsed.where(F.length("names") > 1).groupBy("names").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(run, "names string, part int, pos int, words string, num string, stems string, n bigint")


def lexicon(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (sorted stems) that the records support, with counts: (words, n); and rare slips with what they stand for: (words, target).

    Left out are clipped names, names that are a much rarer slip of another, and
    names that are another one written without spaces.
    """
    counts = listed.where(~F.col("words").contains(".")).groupBy(F.col("stems").alias("words")).agg(F.sum("n").alias("n"))
    counts = materialize(counts, "names")
    # whole names one slip apart
    slips = materialize(N.slip_map(counts, "words", "n", ratio=4.0, two_from=None), "slips")
    two = F.size(F.split("words", " "))
    plain = F.regexp_replace("words", " ", "")
    joined = counts.where(two == 2).select(F.explode(F.array(plain, F.concat(F.split_part("words", F.lit(" "), F.lit(2)), F.split_part("words", F.lit(" "), F.lit(1))))).alias("q")).distinct()
    spelled = counts.where(two != 2).withColumn("q", plain).join(joined, "q", "left_semi").select("words")
    return counts.join(slips.select("words").union(spelled), "words", "left_anti"), slips


def known_names(parsed: DataFrame) -> DataFrame:
    """For each distinct ``names``: ``main``, the name a record goes by, and ``others``, its further ones in one string, as "words#number".

    Further names come with the main one first; a record without them goes by its own
    name. A name out of reach stays as typed. Each distinct name is resolved once.
    """
    listed = materialize(_listed(parsed), "listed")
    typed = listed.select("words").distinct()
    target = materialize(N.resolve_words(typed, *lexicon(listed)), "targets")
    hits = listed.select("names", "part", "pos", "words", "num", "stems").join(broadcast_if_small(target, limit=4 << 20), "words", "left")
    entry = F.struct("part", "pos", F.concat_ws("#", "target", "num").alias("hit"), F.concat_ws("#", "stems", "num").alias("typed"), F.col("target").isNotNull().alias("ok"))
    one = hits.groupBy("names").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # the alternatives of one typed record
    part = lambda k, ok: F.filter("e", lambda x: (x["part"] == k) & x["ok"] if ok else x["part"] == k)
    own = F.when(F.exists("e", lambda x: (x["part"] == 0) & x["ok"]), F.transform(part(0, True), lambda x: x["hit"])).otherwise(F.transform(part(0, False), lambda x: x["typed"]))
    known = F.array_distinct(F.concat(F.transform(part(1, True), lambda x: x["hit"]), own))
    one = one.select("names", known.alias("_known")).where(F.size("_known") > 0)
    one = one.select("names", F.element_at("_known", 1).alias("main"), F.array_join(F.slice("_known", F.lit(2), F.size("_known")), _SEP).alias("others"))
    return materialize(one, "known")


def plain_place(c: Column) -> Column:
    """A county or district in plain form; null where blank. Patterns run only on texts they can change."""
    flat = F.translate(c, "\t\n\r\u00a0", "    ")
    s = F.lower(F.trim(F.when(flat.contains("("), F.regexp_replace(flat, r"\([^)]*\)?", " ")).otherwise(flat)))
    kind = F.trim(F.regexp_replace(s, r" +(co|county|parish|borough|mining district|mng\.? dist|district|dist)\.? *$", ""))
    kind = F.when(kind.contains("  "), F.regexp_replace(kind, " +", " ")).otherwise(kind)
    return F.nullif(F.translate(F.when(s.contains(" "), kind).otherwise(s), "|", "/"), F.lit(""))  # a bar parts an entity's key


def place_map(records: DataFrame, place: str) -> DataFrame:
    """Typed places of a state with the supported spelling they stand for: (state, place, target)."""
    counts = materialize(records.where(F.col(place).isNotNull()).groupBy("state", F.col(place).alias("place")).agg(F.count(F.lit(1)).alias("n")), "places")
    full = counts.where(~F.col("place").endswith("."))
    slips = materialize(N.slip_map(full, "place", "n", ["state"], ratio=3.0), "slips")
    kept = full.join(slips, ["state", "place"], "left_anti")
    # a clipped place stands for the most frequent one that begins so; under three letters only if there is one
    cut = counts.where(F.col("place").endswith(".")).select("state", "place", F.regexp_replace("place", r"\.$", "").alias("_p")).where(F.length("_p") >= 1)
    heads = kept.select("state", F.col("place").alias("_full"), F.col("n").alias("_m"), F.substring("place", 1, 1).alias("_h"))
    cut = cut.withColumn("_h", F.substring("_p", 1, 1)).join(heads, ["state", "_h"]).where(F.col("_full").startswith(F.col("_p")))
    cut = cut.groupBy("state", "place").agg(F.max_by("_full", F.struct("_m", "_full")).alias("target"), F.count(F.lit(1)).alias("_c")).where((F.length("place") > 3) | (F.col("_c") == 1)).drop("_c")
    return slips.select("state", "place", "target").unionByName(cut)


def place_targets(records: DataFrame, place: str) -> DataFrame:
    """place_map() as a written table, for a join on the state and the place."""
    return materialize(place_map(records, place).select("state", F.col("place").alias(place), F.col("target").alias("_t")), "map")


def with_places(records: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Replaces typed counties and districts by the spellings the records support."""
    for c, m in maps.items():
        records = records.join(broadcast_if_small(m, limit=1 << 20), ["state", c], "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
    return records


def _km2(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Square of the distance in km in the plane, good enough to tell near from far."""
    dx = F.abs(lon - lon2)
    dx = F.least(dx, 360.0 - dx) * F.cos(F.radians(lat)) * 111.2
    dy = (lat - lat2) * 111.2
    return dx * dx + dy * dy


def _close(lat: Column, lon: Column, mlat: Column, mlon: Column) -> Column:
    """Evidence of a point for an entity's centre: near, far, or nothing."""
    d = _km2(lat, lon, mlat, mlon)
    return F.coalesce(F.when(d <= 9, 4.0).when(d <= 144, 1.0).when(d >= 2025, -2.5), F.lit(0.0))


def resolve_records(parts: list[DataFrame], carry: list[str] | None = None) -> DataFrame:
    """One table of all records with resolved names and places and their entity.

    Each part has columns src, id (string), name, further (array<string>), state,
    county, district, lat, lon. Adds ``main`` (the name the record goes by),
    ``others`` (its further names in one string), ``place`` (county of the entity,
    null if undecided) and ``entity``. Records without a name or state have no entity. Extra columns are
    dropped but for those to ``carry``.
    """
    carry = carry or []
    cols = ["src", "id", "name", "further", "state", "county", "district", "lat", "lon", *carry]
    rec = reduce(lambda a, b: a.unionByName(b), [p.select(*cols) for p in parts])
    ok = geo.valid_point(F.col("lat"), F.col("lon")) & ~((F.abs("lat") < 0.01) & (F.abs("lon") < 0.01))
    rec = rec.select(
        "src", "id", *carry, F.upper(F.trim("state")).alias("state"), plain_place(F.col("county")).alias("county"), plain_place(F.col("district")).alias("district"),
        F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lon")).alias("lon"), parse_names(F.col("name"), F.coalesce("further", F.array().cast("array<string>"))).alias("names"),
    )
    parsed = materialize(rec, "parsed")
    known, county, district = at_once(lambda: known_names(parsed), lambda: place_targets(parsed, "county"), lambda: place_targets(parsed, "district"))
    rec = with_places(parsed, {"county": county, "district": district}).join(broadcast_if_small(known, limit=6 << 20), "names", "left").drop("names")
    rec = materialize(rec.where("main is not null and state is not null"), "resolved")

    # a further name of a county's working stands for the name that its records put first
    pairs = rec.where((F.col("others") != "") & F.col("county").isNotNull()).select("state", "county", "main", F.explode(F.split("others", _SEP)).alias("alias"))
    alias = pairs.groupBy("state", "county", "alias", "main").agg(F.count(F.lit(1)).alias("n"))
    alias = alias.groupBy("state", "county", "alias").agg(F.max_by("main", F.struct("n", "main")).alias("_to"), F.max("n").alias("_as"))
    by_main = rec.where("county is not null").groupBy("state", "county", "main").agg(F.count(F.lit(1)).alias("_own"))
    alias = alias.join(by_main.withColumnRenamed("main", "alias"), ["state", "county", "alias"], "left").where("_own is null or _own < 3 * _as + 3")
    alias = materialize(alias.select("state", "county", F.col("alias").alias("main"), "_to"), "alias")
    rec = rec.join(broadcast_if_small(alias, limit=1 << 20), ["state", "county", "main"], "left").withColumn("main", F.coalesce("_to", "main")).drop("_to")

    # entities with their weight, district and centre; a record does not vouch for itself
    placed = rec.where("county is not null")
    # counted by spot and district first: what follows sees a row for each, not for each record
    spots = placed.groupBy("state", "main", "county", "district", F.round("lat", 2).alias("_y"), F.round("lon", 2).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"), F.max((F.col("src") == "reviewed").cast("int")).alias("sure")
    )
    spots = materialize(spots, "spots")
    # a record without a county that goes by a further name alone: the name it stands for, if there is one in the state
    lone = alias.groupBy("state", "main").agg(F.min("_to").alias("_one"), F.max("_to").alias("_max")).where("_one = _max")
    lone = materialize(lone.select("state", "main", "_one").join(spots.select("state", "main").distinct(), ["state", "main"], "left_anti"), "lone")
    rec = rec.withColumn("_bare", F.when(F.col("county").isNull(), F.col("main"))).join(broadcast_if_small(lone.withColumnRenamed("main", "_bare"), limit=1 << 20), ["state", "_bare"], "left")
    rec = rec.withColumn("main", F.coalesce("_one", "main")).drop("_one", "_bare")
    key = ["state", "main", "county"]
    centre = spots.groupBy(*key).agg(F.sum("_n").alias("n"), F.max("sure").alias("sure"))
    most = F.struct("_n", "_y", "_x")
    place = spots.where("_lat is not null").groupBy(*key, "_y", "_x").agg(F.sum("_n").alias("_n"), F.max("_lat").alias("_lat"), F.max("_lon").alias("_lon"))
    place = place.groupBy(*key).agg(F.max_by("_lat", most).alias("mlat"), F.max_by("_lon", most).alias("mlon"))
    dist = spots.where("district is not null").groupBy(*key, "district").agg(F.sum("_n").alias("_n"))
    dist = dist.groupBy(*key).agg(F.max_by("district", F.struct("_n", "district")).alias("mdist"))
    centre = centre.join(place, key, "left").join(dist, key, "left")
    options = centre.groupBy("state", "main").agg(F.collect_list(F.struct("county", "n", "mdist", "mlat", "mlon", "sure")).alias("opts"))  # at most the counties of a state
    # one name at one spot in two counties is one working under a mistaken county
    near = lambda o: F.filter("opts", lambda q: (q["county"] == o["county"]) | F.coalesce(_km2(q["mlat"], q["mlon"], o["mlat"], o["mlon"]) <= 9, F.lit(False)))
    best = lambda o: F.array_max(F.transform(near(o), lambda q: F.struct(q["sure"], q["n"], q["county"])))["county"]
    options = options.withColumn("opts", F.transform("opts", lambda o: o.withField("to", best(o))))
    options = materialize(options, "options")
    weigh = lambda n, sure: F.log(n + 0.3) + 2.0 * sure
    rival = lambda o: F.array_max(F.transform(F.filter("opts", lambda q: q["county"] != o["county"]), lambda q: weigh(q["n"], q["sure"])))
    own = options.select("state", "main", F.inline(F.transform("opts", lambda o: o.withField("rival", rival(o)))))
    own = own.select("state", "main", "county", *[F.col(c).alias(f"_{c}") for c in ("n", "mdist", "mlat", "mlon", "sure", "to", "rival")])
    rec = rec.join(broadcast_if_small(materialize(own, "own"), limit=4 << 20), ["state", "main", "county"], "left")
    placed, spotted = F.col("district").isNotNull(), F.col("lat").isNotNull()
    fits = F.when(~placed | F.col("_mdist").isNull(), 0.0).when(F.col("_mdist") == F.col("district"), 3.0).otherwise(-1.5) + _close(F.col("lat"), F.col("lon"), F.col("_mlat"), F.col("_mlon"))
    mine = 3.5 + weigh(F.col("_n") - 1, F.col("_sure")) + F.when(F.col("_n") == 1, 0.0).otherwise(fits)
    most = -2.0 + F.col("_rival") + F.when(placed, 3.0).otherwise(0.0) + F.when(spotted, 4.0).otherwise(0.0)
    # its county stands where others confirm it and the district agrees, or where no other county of the name can weigh more
    agreed = F.coalesce((F.col("_n") > 1) & (F.col("_mdist") == F.col("district")), F.lit(False)) | F.coalesce(mine > most, F.lit(False))
    # the options of a name come only to records that have to be weighed
    options = options.select(F.col("state").alias("_state"), F.col("main").alias("_main"), "opts")
    rec = rec.join(broadcast_if_small(options, limit=4 << 20), (F.col("state") == F.col("_state")) & (F.col("main") == F.col("_main")) & ~agreed, "left")

    def score(o: Column) -> Column:
        self = (o["county"] == F.col("county")).cast("int")
        self = F.coalesce(self, F.lit(0))
        weight = weigh(F.greatest(o["n"] - self, F.lit(0)), o["sure"])
        county = F.when(F.col("county").isNull(), 0.0).when(o["county"] == F.col("county"), 3.5).otherwise(-2.0)
        alone = (self == 1) & (o["n"] == 1)
        district = F.when(F.col("district").isNull() | o["mdist"].isNull() | alone, 0.0).when(o["mdist"] == F.col("district"), 3.0).otherwise(-1.5)
        return weight + county + district + F.when(alone, 0.0).otherwise(_close(F.col("lat"), F.col("lon"), o["mlat"], o["mlon"]))

    ranked = F.array_max(F.transform("opts", lambda o: F.struct(score(o).alias("s"), o["to"].alias("county"))))["county"]
    # nothing to weigh where others confirm the county and the district agrees, or where there is one candidate
    only = F.when(agreed, F.col("_to")).when(F.size("opts") == 1, F.col("opts")[0]["to"]).otherwise(ranked)
    rec = rec.withColumn("place", F.coalesce(only, F.col("county"))).drop("opts", "_n", "_mdist", "_mlat", "_mlon", "_sure", "_to", "_rival", "_state", "_main")
    # a record placed now may go by a further name of its county
    late = alias.withColumnsRenamed({"county": "place"})
    rec = rec.join(broadcast_if_small(late, limit=1 << 20), ["state", "place", "main"], "left").withColumn("main", F.coalesce("_to", "main")).drop("_to")
    return rec.withColumn("entity", F.concat_ws("|", "state", F.coalesce("place", F.lit("?")), "main"))


def centres(records: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Centre of the fullest spot (a hundredth of a degree) of each key: keys, ``clat``, ``clon``; null without a point.

    Bad points lie elsewhere and don't move it. Counted by spot first, in hash aggregates.
    """
    s = records.groupBy(*keys, F.round(lat, 2).alias("_y"), F.round(lon, 2).alias("_x")).agg(F.count(lat).alias("_n"), F.avg(lat).alias("_lat"), F.avg(lon).alias("_lon"))
    most = F.struct("_n", "_y", "_x")
    return s.groupBy(*keys).agg(F.max_by("_lat", most).alias("clat"), F.max_by("_lon", most).alias("clon"))
