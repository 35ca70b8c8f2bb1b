"""Rows and sites of planted mines: which pairs come out, and with what probability."""

import random

from pyspark.sql import functions as F

from lodeframe.llm import q_names
from lodeframe.session import at_once

ROWS = "row_id long, name string, keys array<string>, state string, county string, district string, lat double, lon double"
SITES = "dep_id long, site_name string, state string, county string, latitude double, longitude double"


def _matches(spark, folder, rows, sites):
    spark.createDataFrame(rows, ROWS).write.mode("overwrite").parquet(f"{folder}/rows_igs_b11.parquet")
    spark.createDataFrame(sites, SITES).write.mode("overwrite").parquet(f"{folder}/mrds_sites.parquet")
    return {(r.row_id, r.dep_id): r.p for r in q_names.p1_matches(spark, str(folder)).collect()}


def test_candidates_and_evidence(spark, tmp_path):
    rows = [(i, "Golden Shovel mine", None, "ID", "Ada", "Elk Creek", 44.0, -114.0) for i in range(10)]
    rows += [(20 + i, "Lucky Peach", None, "ID", "Boise", "Bear Gulch", None, None) for i in range(6)]
    rows += [(40 + i, "Other Wager", None, "ID", "Boise", "Bear Gulch", 43.0, -115.0) for i in range(6)]
    rows += [(60, None, None, "ID", "Ada", None, None, None), (61, "Golden Shovel", None, None, "Ada", None, None, None)]
    sites = [
        (1, "Golden Shovel", "Idaho", "Ada", 44.001, -114.001), (2, "Golden Shovel", "Idaho", "Bonner", 48.0, -116.5), (3, "Golden Shovel", "Nevada", "Ada", 44.0, -114.0),
        (4, "Golden Shovels claim", "Idaho", "Ada", None, None), (5, "Lucky Peach", "Idaho", None, 43.01, -115.01), (6, "Lucky Peach", "Idaho", None, 47.9, -116.9), (7, None, "Idaho", "Ada", None, None),
        (8, "Golden Shovell", "Idaho", "Elmore", 44.002, -114.002), (9, "Golden Shovelx", "Idaho", "Elmore", 47.0, -116.0),
    ]
    sites += [(100 + i, "Golden Shovell", "Idaho", "Elmore", 44.002, -114.002) for i in range(9)]  # as frequent as the other name: no slip of it
    got = _matches(spark, tmp_path, rows, sites)
    assert got[0, 1] > 0.9 and (0, 3) not in got and not any(d in (7,) or r in (60, 61) for r, d in got)
    assert got[0, 4] == got[0, 1]  # entries of one county are one site
    assert got.get((0, 2), 0) < 0.5  # another county, far away
    # no point of its own: the district's middle tells near from far
    assert got[20, 5] > got[20, 6]
    # one row a pair
    assert len(got) == len(set(got))


def test_probabilities_fit_the_share_of_true_pairs(spark, tmp_path):
    """Of pairs given a high probability most are true, of those given a low one few."""
    rnd = random.Random(7)
    words = ["amber", "beaver", "cedar", "dynamo", "eagle", "falcon", "garnet", "harvest", "indigo", "juniper", "kettle", "lantern"]
    names = [f"{a} {b}" for a in words for b in words if a < b]
    counties = ["Ada", "Boise", "Blaine", "Custer"]
    rows, sites, mine_of_row, mine_of_site = [], [], {}, {}
    mines = rnd.sample([(n, c) for n in names for c in counties], 150)  # a mine is one name in one county
    for m, (name, county) in enumerate(mines):
        lat, lon = 43 + 3 * rnd.random(), -116 + 3 * rnd.random()
        for _ in range(rnd.randint(1, 5)):
            k = len(rows)
            at = (lat + rnd.gauss(0, 0.004), lon + rnd.gauss(0, 0.004)) if rnd.random() < 0.6 else (None, None)
            rows.append((k, name, None, "ID", county if rnd.random() < 0.8 else None, None, *at))
            mine_of_row[k] = m
        if rnd.random() < 0.8:
            k = len(sites)
            at = (lat + rnd.gauss(0, 0.004), lon + rnd.gauss(0, 0.004)) if rnd.random() < 0.8 else (None, None)
            sites.append((k, name, "Idaho", county if rnd.random() < 0.8 else None, *at))
            mine_of_site[k] = m
    got = _matches(spark, tmp_path, rows, sites)
    share = lambda lo, hi: [mine_of_row[r] == mine_of_site[s] for (r, s), p in got.items() if lo <= p < hi]
    for lo, hi in ((0.0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):
        x = share(lo, hi)
        print(f"p in [{lo}, {hi}): {len(x)} pairs, {sum(x) / max(1, len(x)):.2f} true")
    high, low = share(0.9, 1.01), share(0.0, 0.1)
    assert len(high) > 100 and sum(high) / len(high) > 0.9 and sum(low) / max(1, len(low)) < 0.3


def test_jobs_at_once(spark):
    assert at_once(lambda: spark.range(5).count(), lambda: spark.range(7).agg(F.sum("id")).first()[0]) == [5, 21]
    try:
        at_once(lambda: 1, lambda: 1 / 0)
    except ZeroDivisionError:
        pass
    else:
        raise AssertionError("a failure must be raised")
